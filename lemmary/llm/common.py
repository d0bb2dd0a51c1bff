"""Helpers the operators share: row numbers, written tables, ordered slices, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key under which a cluster names the folder that driver and executors share.
SHARED_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only a local session may go without one: it gets a temporary folder (tests)."""
    at = spark.conf.get(SHARED_KEY, None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"set {SHARED_KEY} to a folder that the driver and all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="lemmary-")
        spark.conf.set(SHARED_KEY, at)
    return at.rstrip("/")


#: Folders that this process made below the shared folder, and has not removed again.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the frame to the shared folder and read it back.

    The files survive the loss of any executor, and values that depend on the
    order of rows in a task (row numbers) are fixed from here on.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The folders that this process has written and not removed."""
    return list(_MADE)


def release(spark: SparkSession, folders: list[str], keep: DataFrame | None = None) -> int:
    """Remove folders of ``made`` but for those that ``keep`` reads; other frames that read them are void. Returns how many."""
    used = keep.inputFiles() if keep is not None else []
    conf, removed = spark._jsc.hadoopConfiguration(), 0
    for path in [p for p in folders if p in _MADE]:
        folder = f"/{path.rpartition('/')[2]}/"  # the name is unique
        if not any(folder in f for f in used):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _MADE.remove(path)
            removed += 1
    return removed


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, or one with underscores in front, that no column of the frame has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str = "rid") -> tuple[DataFrame, str]:
    """The frame with a number for each row, written to the shared folder, and the name of the number's column.

    Numbers given in two scans need not agree, as splits depend on the cluster's
    cores at that time; whoever reads this table twice sees the same rows.
    """
    rid = fresh_name(df, name)
    return written(df.withColumn(rid, F.monotonically_increasing_id()), "rows"), rid


def long_id(docs: DataFrame, id_column: str) -> Column:
    """The identifier as a long. Identifiers that are not integers are refused before anything runs."""
    kind = docs.schema[id_column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"column {id_column} is {kind}; this operator orders documents by integer identifiers")
    return F.col(f"`{id_column}`").cast("long")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def slice_bounds(docs: DataFrame, key: str, slices: int) -> list:
    """At most ``slices - 1`` ascending cut points that deal rows out evenly by ``key``.

    Reads the key column only. The list is bounded by ``slices``.
    """
    if slices < 2:
        return []
    at = [i / slices for i in range(1, slices)]
    row = docs.select(F.percentile_approx(key, at, 20 * slices).alias("q")).first()
    return sorted({x for x in (row.q or []) if x is not None})


def slice_of(key: str, bounds: list) -> Column:
    """Number of cut points below or at the key: 0 for nulls and the lowest keys."""
    if not bounds:
        return F.lit(0)
    # A binary search over a literal array, as nested comparisons of depth log2(n).
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node's smallest reachable node; only nodes with an edge appear.

    Alternating large-star and small-star rounds. A round is two aggregations
    with partial sums and two joins, so a hub never gathers in one task; the
    edge list shrinks to a star for each component and is written to the shared
    folder after each round. Rounds go on until nothing changes, about the
    square of the logarithm of the longest path at most.
    """
    cur = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = None
    while True:
        mark = cur.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")
        ).first()
        if mark.n == 0 or (mark.n, mark.h) == before:
            break
        before = (mark.n, mark.h)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        cur = written(small.filter("u <> v").distinct(), "edges")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def running(partition: str, *order: Column) -> "Window":
    """Rows before the current one, in the given order."""
    return Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
