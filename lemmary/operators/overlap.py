"""Overlap of the row sets that several methods flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged(frame: DataFrame, key: Sequence[str], *verdicts: str) -> DataFrame:
    """Distinct keys with any row that the first non-null verdict flags."""
    return frame.filter(F.coalesce(*verdicts)).select(*key).distinct()


def memberships(frame: DataFrame, key: Sequence[str], method: str) -> DataFrame:
    """(key, members): the sorted methods that flag each key; bounded by the number of methods."""
    return frame.groupBy(*key).agg(F.sort_array(F.collect_set(method)).alias("members"))


def regions(frame: DataFrame, key: Sequence[str], method: str, methods: Sequence[str]) -> DataFrame:
    """(mask, n): exact regions of a Venn diagram; bit i stands for methods[i]."""
    bits = [F.max(F.when(F.col(method) == m, F.lit(1 << i)).otherwise(F.lit(0))) for i, m in enumerate(methods)]
    mask = bits[0]
    for x in bits[1:]:
        mask = mask + x
    return frame.groupBy(*key).agg(mask.alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def exact_intersections(frame: DataFrame, key: Sequence[str], method: str) -> DataFrame:
    """(members, degree, n): keys flagged by exactly this set of methods."""
    sets = memberships(frame, key, method).groupBy("members").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.array_join("members", "&").alias("members"), F.size("members").alias("degree"), "n")


def jaccard(frame: DataFrame, key: Sequence[str], method: str, methods: Sequence[str]) -> DataFrame:
    """(a, b, shared, either, jaccard) of all pairs of methods, 0 for an empty union.

    One grouped pass gives every key's mask; pairs are sums over the few masks.
    """
    masks = regions(frame, key, method, methods)
    pairs = [(i, j) for i in range(len(methods)) for j in range(i + 1, len(methods))]
    has = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    row = masks.agg(*[
        F.struct(F.lit(methods[i]).alias("a"), F.lit(methods[j]).alias("b"), total(has(i) & has(j)).alias("shared"), total(has(i) | has(j)).alias("either")).alias(f"p{i}_{j}")
        for i, j in pairs
    ])
    out = row.select(F.explode(F.array(*[f"p{i}_{j}" for i, j in pairs])).alias("x")).select("x.*")
    return out.withColumn("jaccard", F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(F.lit(0.0)))
