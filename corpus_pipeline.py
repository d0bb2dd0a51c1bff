"""A training-corpus pipeline of five operators; each stage reads what the one before it wrote.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.llm import packing, toxicity
from lemmary.llm.common import fresh_name, made, release, written
from lemmary.llm.exact_dedup import keep_one
from lemmary.llm.queries import vocabulary
from lemmary.llm.secrets import redact_secrets
from lemmary.llm.simhash import keep_one_of_near


#: Folders that earlier stages wrote for themselves.
_LEFT: list[str] = []


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """What earlier stages wrote for themselves goes when the next one begins, except what its documents are read from."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _LEFT, keep=docs)
        before = made()
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [p for p in made() if p in _LEFT or p not in before]
        return out

    return run


@tidy
def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above their language's threshold go; the model learns from the labels of ``sf_dir``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, flag = fresh_name(docs, "toxicity"), fresh_name(docs, "toxic")
    return toxicity.score_documents(docs, model, score=score, flag=flag).filter(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


@tidy
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest id stays."""
    return keep_one(docs)


@tidy
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by SimHash over five-word shingles at a similarity of 0.8 or more."""
    return keep_one_of_near(docs, width=5, similarity=0.8)


@tidy
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark and n_chars follows."""
    return redact_secrets(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 tokens, with their ids."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", filter_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot train the classifier, fingerprint shingles or encode tokens; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
