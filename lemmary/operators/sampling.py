"""Reproducible samples and splits: every choice is ordered by the md5 of a seed and a key."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def stratified(frame: DataFrame, strata: Sequence[str], key: Sequence[str], target: int, seed: int = 42) -> DataFrame:
    """max(1, target // strata) rows of each stratum, then a fill of the rest up to ``target``; more than that with many strata.

    The share is known before the window runs, so Spark trims each stratum
    before the shuffle; the fill is a top-k.
    """
    n = frame.select(*strata).distinct().count()
    if not n:
        return frame.limit(0)
    keyed = frame.withColumn("_o", order_key(seed, *key))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", *key)))
    first = ranked.filter(F.col("_r") <= max(1, target // n)).drop("_r")
    taken = first.count()
    if taken >= target:
        return first.drop("_o")
    rest = keyed.join(first.select(*key), list(key), "left_anti").orderBy("_o", *key).limit(target - taken)
    return first.unionByName(rest).drop("_o")


def per_group(frame: DataFrame, groups: Sequence[str], sub: str, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """max(1, k // levels of ``sub`` in the group) rows for each group and level."""
    levels = frame.select(*groups, sub).distinct().groupBy(*groups).agg(F.count(F.lit(1)).alias("_l"))
    ranked = frame.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, sub).orderBy(order_key(seed, *key), *key)))
    share = F.greatest(F.lit(1), F.floor(F.lit(k) / F.col("_l")))
    return ranked.filter(F.col("_r") <= k).join(levels, list(groups)).filter(F.col("_r") <= share).drop("_r", "_l")


def inconsistent_first(frame: DataFrame, groups: Sequence[str], verdict: str, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """For each group up to k // 2 inconsistent rows, filled to k with consistent ones."""
    w = Window.partitionBy(*groups, verdict).orderBy(order_key(seed, *key), *key)
    ranked = frame.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    bad = F.sum(F.when(~F.col(verdict) & (F.col("_r") <= k // 2), 1).otherwise(0)).over(Window.partitionBy(*groups))
    return ranked.withColumn("_b", bad).filter(
        F.when(~F.col(verdict), F.col("_r") <= k // 2).otherwise(F.col("_r") <= F.lit(k) - F.col("_b"))
    ).drop("_r", "_b")


def split(frame: DataFrame, strata: Sequence[str], key: Sequence[str], shares: tuple[float, float] = (0.7, 0.15), seed: int = 42, piece: int = 1_000_000) -> DataFrame:
    """Add ``split``: train and validation take the floor of their share of each stratum, test the rest.

    Ranks are made of two parts: rows of the stratum with lower first digits of
    the hash, and the rank among those with the same ones. There are as many
    digits as cut all rows into pieces of ``piece`` rows or fewer on average, so
    no task sorts more of a stratum, however large its share; the result is the
    same for any number. Shares count as the decimals that they are written as:
    0.7 of 90 rows are 63, as a binary fraction 62. Null is a stratum too.
    """
    by = list(strata)
    digits = 1
    rows = frame.count()
    while 16**digits * piece < rows:
        digits += 1
    keyed = frame.withColumn("_o", order_key(seed, *key)).withColumn("_b", F.substring("_o", 1, digits))
    counts = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    lower = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"_f": F.coalesce(F.sum("_k").over(lower), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy(*by))}).drop("_k")
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_o", *key))
    sizes = offsets.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate([*by, "_b"])], "_f", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate([*by, "_b"])]
    placed = keyed.withColumn("_i", inside).join(sizes, same).withColumn("_r", F.col("_f") + F.col("_i"))
    a, b = (F.floor(F.col("_n") * F.lit(Decimal(str(x)))) for x in shares)
    name = F.when(F.col("_r") <= a, F.lit("train")).when(F.col("_r") <= a + b, F.lit("validation")).otherwise(F.lit("test"))
    return placed.withColumn("split", name).select(*frame.columns, "split")


def chunk_numbers(frame: DataFrame, order: str, size: int, out: str = "chunk") -> DataFrame:
    """Add the number of the chunk of ``size`` rows in the order of a unique column.

    Rows are sorted in ranges; each range's first number comes from the sizes of
    the ranges before it, so no task sorts the whole table.
    """
    from lemmary.sources.scratch import scratch_path

    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "chunks")
    frame.select(order).repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    keys = spark.read.parquet(path)
    total, before = 0, []
    for r in sorted(keys.groupBy("_p").count().collect(), key=lambda r: r._p):
        before.append((r._p, total))
        total += r["count"]
    offsets = spark.createDataFrame(before, "_p int, _before long")
    n = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_before")
    numbered = keys.join(F.broadcast(offsets), "_p").select(order, F.floor(n / size).cast("long").alias(out))
    return frame.join(numbered, order)
