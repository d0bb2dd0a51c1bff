"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.llm import bpe, brown_lm, chaining, packing, prefix_hash, simhash, sstable, toxicity
from lemmary.llm.common import fold_of, text_of
from lemmary.llm.exact_dedup import exact_dedup
from lemmary.llm.secrets import scan_secrets


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold_of("doc_id", 7) == 2
    model = brown_lm.train(docs.filter(~held_out).select(text_of().alias("t")))
    scored = brown_lm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op4_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edit_likeness(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("rid")


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op7_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    both = bpe.decode_documents(bpe.encode_documents(documents(spark, sf_dir), path), path)
    line = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(line.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write_shards(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return sstable.read_shards(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        "toxic_by_lang",
    )


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(documents(spark, sf_dir))


QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_prefix_hash": op4_prefix_hash,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_rank_bpe": op7_rank_bpe,
    "op8_sstable": op8_sstable,
    "op9_toxicity": op9_toxicity,
    "op10_chaining": op10_chaining,
}
ORACLES = {"op6_exact_dedup": OP6_SQL}
