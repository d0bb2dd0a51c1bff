"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of code points. Equal blocks get
one integer name, given by sorting; then names of adjacent blocks are paired
and each distinct pair is named again, until one name stands for the document.
Two texts have the same name exactly if they are identical: names come from
comparing contents, a hash only decides which task compares them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.llm.common import fresh_name, numbered, text_of, written

#: Tasks compare blocks within a bucket; the bucket is the upper part of a name.
BUCKETS = 1 << 20
RANK_BITS = 40


def _blocks(docs: DataFrame, id_column: str, text_column: str, block_chars: int, rid: Column, hash_bits: int) -> DataFrame:
    """(rid, doc_id, text_sha256, blocks, pos, block, h, h2): one row for each block of each document."""
    whole = docs.select(rid.alias("rid"), F.col(f"`{id_column}`").alias("doc_id"), text_of(text_column).alias("t"))
    cut = F.when(F.length("t") <= block_chars, F.array("t")).otherwise(
        F.regexp_extract_all("t", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    )
    low = F.lit(-1 if hash_bits == 64 else (1 << hash_bits) - 1)
    return (
        whole.select("rid", "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), cut.alias("cut"))
        .select("rid", "doc_id", "text_sha256", F.size("cut").alias("blocks"), F.posexplode("cut").alias("pos", "block"))
        .withColumn("h", F.xxhash64("block").bitwiseAND(low))
        .withColumn("h2", F.xxhash64(F.lit(1), "block").bitwiseAND(low))
    )


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(h, h2, block, name): an integer for each distinct block, by sorting. Copies are one row before the shuffle."""
    distinct = blocks.select("h", "h2", "block").distinct().withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("block")).cast("long")
    return distinct.select("h", "h2", "block", (F.shiftleft(F.col("bucket").cast("long"), RANK_BITS) + rank).alias("name"))


def identities(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_chars: int = 4096, rid: Column | None = None, hash_bits: int = 64
) -> DataFrame:
    """(rid, doc_id, text_sha256, long, name): equal (long, name) exactly for identical texts.

    ``rid`` numbers the input rows, so repeated rows and null ids stay apart.
    ``long`` says whether the text took more than one block. Names go back to
    the blocks by two hashes; if any two blocks share both, by their contents.
    """
    blocks = _blocks(docs, id_column, text_column, block_chars, F.monotonically_increasing_id() if rid is None else rid, hash_bits)
    key = ["h", "h2"]
    names = written(_name_blocks(blocks).select(*key, "name"), "block-names")
    if names.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        key = ["h", "h2", "block"]
        names = written(_name_blocks(blocks).select(*key, "name"), "block-names")
    # Read from tables, both sides of the join are plain exchanges: a frequent block's partition can be split.
    places = written(blocks.select("rid", "doc_id", "text_sha256", "blocks", "pos", *key), "block-places")
    joined = places.join(names, key)
    named = written(joined.select("rid", "doc_id", "text_sha256", "blocks", "pos", "name"), "named-blocks")

    most = named.agg(F.max("blocks").alias("m")).first().m or 0
    one = named.filter("blocks = 1").select("rid", "doc_id", "text_sha256", F.lit(False).alias("long"), "name")
    if most <= 1:
        return one
    cur = named.filter("blocks > 1").select("rid", "pos", "name")
    while most > 1:
        cur = _pair_names(cur)
        most = (most + 1) // 2
    heads = named.filter("blocks > 1 AND pos = 0").select("rid", "doc_id", "text_sha256")
    return one.unionByName(heads.join(cur.select("rid", "name"), "rid").withColumn("long", F.lit(True)))


def _pair_names(cur: DataFrame) -> DataFrame:
    """Names of adjacent pairs. Only distinct pairs are sorted, so a frequent pair is one row there."""
    even = F.col("pos") % 2 == 0
    pairs = cur.groupBy("rid", F.expr("CAST(pos DIV 2 AS INT)").alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-(1 << 62))).alias("b"),
    )
    pairs = written(pairs, "block-pairs")
    bucket = F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)).alias("bucket")
    distinct = pairs.select("a", "b").distinct().select("a", "b", bucket)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("a", "b")).cast("long")
    names = distinct.select("a", "b", (F.shiftleft(F.col("bucket").cast("long"), RANK_BITS) + rank).alias("name"))
    return written(pairs.join(names, ["a", "b"]).select("rid", "pos", "name"), "pair-names")


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_chars: int = 4096, rid: Column | None = None
) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, rid.

    Of identical texts the row with the largest id stays; among repeated rows of
    that id the first row read. A null text is the empty text. A null id sorts
    below any other; a group of null ids has keep_id null and keeps one row. An
    empty table gives an empty result. Other columns of the input are ignored.
    ``rid`` is a column that numbers the rows, or None to number them here.
    """
    ids = identities(docs, id_column, text_column, block_chars, rid)
    groups = (
        ids.groupBy("long", "name")
        .agg(F.max(F.struct("doc_id", (-F.col("rid")).alias("r"))).alias("k"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("long", "name", F.col("k.doc_id").alias("keep_id"), (-F.col("k.r")).alias("keep_rid"), "group_size")
    )
    groups = written(groups, "copy-groups")
    alone = F.col("group_size").isNull()
    return ids.join(groups, ["long", "name"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
        "rid",
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns."""
    rows, rid = numbered(docs)
    gone = fresh_name(rows, "gone")
    dropped = exact_dedup(rows, id_column, text_column, rid=F.col(rid)).filter(~F.col("kept")).select(F.col("rid").alias(gone))
    return rows.join(dropped, F.col(rid) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
