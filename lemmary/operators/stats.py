"""Grouped rates, intervals, effect sizes, correlations and bins."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.sources.scratch import scratch_path

Z = 1.96
Z_EXACT = 1.959963984540054


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds; null counts as not."""
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, held to 0..1; null for no rows."""
    p = successes / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def overall(frame: DataFrame, verdict: str) -> DataFrame:
    """total, consistent, inconsistent, consistency_rate in one pass; rows without a verdict are left out."""
    return frame.filter(F.col(verdict).isNotNull()).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col(verdict)).alias("consistent")
    ).withColumns({"inconsistent": F.col("total") - F.col("consistent"), "consistency_rate": F.col("consistent") / F.col("total")})


def rate_by(frame: DataFrame, factor: str | Sequence[str], verdict: str, z: float = Z) -> DataFrame:
    """n, consistent, inconsistent, rate of inconsistency and its Wilson bounds for each level."""
    by = [factor] if isinstance(factor, str) else list(factor)
    base = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(F.col(verdict)).alias("consistent"))
    base = base.withColumn("inconsistent", F.col("n") - F.col("consistent"))
    low, high = wilson(F.col("inconsistent"), F.col("n"), z)
    return base.withColumns({"rate": F.col("inconsistent") / F.col("n"), "ci_low": low, "ci_high": high})


def matrix(frame: DataFrame, rows: str, columns: str, levels: Sequence[str], verdict: str) -> DataFrame:
    """Rate and count of two factors as columns; levels are given, so nothing is collected to find them. Absent cells are null."""
    cell = [
        c
        for v in levels
        for c in (
            F.avg(F.when(F.col(columns) == v, (~F.col(verdict)).cast("double"))).alias(f"{v}_rate"),
            F.count(F.when(F.col(columns) == v, 1)).alias(f"{v}_n"),
        )
    ]
    return frame.groupBy(rows).agg(*cell)


def keep_latest(frame: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, "0.00"), F.lit("%"))


def crosstab(frame: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, row, col, total, rows, cols): observed cells with their margins, empty cells included.

    Both factors' levels are few; counting comes first, so products are of levels.
    """
    cells = frame.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    row = cells.groupBy("a").agg(F.sum("n").alias("row"))
    col = cells.groupBy("b").agg(F.sum("n").alias("col"))
    total = cells.agg(F.sum("n").alias("total"), F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"))
    full = row.crossJoin(col).crossJoin(total)
    return full.join(cells, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def chi_square(frame: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (with Yates' correction for one degree of freedom), dof, Cramer's V of the corrected chi2, and n."""
    t = crosstab(frame, a, b).withColumns({
        "expected": F.col("row") * F.col("col") / F.col("total"),
        "dof": (F.col("rows") - 1) * (F.col("cols") - 1),
    })
    off = F.abs(F.col("n") - F.col("expected"))
    off = F.when(F.col("dof") == 1, off - F.least(F.lit(0.5), off)).otherwise(off)
    out = t.agg(
        F.sum(off * off / F.col("expected")).alias("chi2"), F.max("dof").alias("dof"), F.max("total").alias("n"),
        F.least(F.max("rows"), F.max("cols")).alias("k"),
    )
    v = F.when((F.col("k") > 1) & (F.col("n") > 0), F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1)))).otherwise(F.lit(0.0))
    return out.select("chi2", "dof", v.alias("cramers_v"), "n")


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function Q(dof/2, chi2/2)."""
    if dof <= 0 or chi2 <= 0:
        return 1.0
    a, x = dof / 2, chi2 / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series for the lower tail
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300  # continued fraction for the upper tail
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def tied_rank(by: str, partition: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    ordered = Window.partitionBy(*partition).orderBy(by)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, by)) - 1) / 2


def sliced_values(frame: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[tuple[str, int], int]]:
    """(_c, _v, _k, _p) and rows by (column, slice): distinct values of columns with their counts, in slices of their range numbered in order.

    One pass for all columns. Written to the scratch folder, so the slices stay
    as they are; the driver gets a number for each column and slice.
    """
    spark = frame.sparkSession
    each = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    rows = frame.select(F.explode(each).alias("x")).select("x._c", "x._v").filter("_v IS NOT NULL")
    counts = rows.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_k"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "slices")
    counts.repartitionByRange(parts, "_c", "_v").withColumn("_p", F.spark_partition_id()).write.parquet(path)
    sliced = spark.read.parquet(path)
    return sliced, {(r._c, r._p): r.n for r in sliced.groupBy("_c", "_p").agg(F.sum("_k").alias("n")).collect()}


def tied_ranks(frame: DataFrame, column: str, out: str) -> DataFrame:
    """Add the mean-tie rank of a numeric column over all rows; only slices of distinct values are sorted."""
    return all_tied_ranks(frame, {column: out})


def all_tied_ranks(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the mean-tie rank of each column under the name given for it; the values of all columns are counted in one pass."""
    sliced, sizes = sliced_values(frame, list(columns))
    before, total = [], dict.fromkeys(columns, 0)
    for c, p in sorted(sizes):
        before.append((c, p, total[c]))
        total[c] += sizes[c, p]
    offsets = frame.sparkSession.createDataFrame(before, "_c string, _p int, _before long")
    within = F.coalesce(F.sum("_k").over(Window.partitionBy("_c", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sliced.join(F.broadcast(offsets), ["_c", "_p"]).select(  # as many offsets as slices
        "_c", "_v", (F.col("_before") + within + (F.col("_k") + 1) / 2).alias("_rank")
    )
    for c, out in columns.items():
        one = ranked.filter(F.col("_c") == c).select("_v", F.col("_rank").alias(out))
        frame = frame.withColumn("_v", F.col(c).cast("double")).join(one, "_v", "left").drop("_v")
    return frame


def quantiles(frame: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, interpolated between neighbours; nulls without rows.

    The order statistics that are needed lie in a few slices of the values'
    range, and only those are summed up, so no task holds all values.
    """
    sliced, sizes = sliced_values(frame, columns)
    totals = {c: sum(n for (d, _), n in sizes.items() if d == c) for c in columns}
    places: dict[tuple[str, int], tuple[int, int]] = {}
    for c in columns:
        before = 0
        wanted = sorted({f(q * (totals[c] - 1)) for q in probabilities for f in (math.floor, math.ceil)}) if totals[c] else []
        for _, p in sorted(k for k in sizes if k[0] == c):
            places |= {(c, rank): (p, rank - before) for rank in wanted if before <= rank < before + sizes[c, p]}
            before += sizes[c, p]
    upto = F.sum("_k").over(Window.partitionBy("_c", "_p").orderBy("_v"))
    some = sliced.filter(F.col("_p").isin(sorted({p for p, _ in places.values()}))).withColumn("_u", upto)
    hit = F.lit(False)
    for (c, _), (p, at) in places.items():
        hit = hit | ((F.col("_c") == c) & (F.col("_p") == p) & (F.col("_u") > at) & (F.col("_u") - F.col("_k") <= at))
    rows = some.filter(hit).collect() if places else []  # a row for each statistic
    value = {k: next(r._v for r in rows if (r._c, r._p) == (k[0], p) and r._u - r._k <= at < r._u) for k, (p, at) in places.items()}

    def at(c: str, q: float) -> float | None:
        if not totals[c]:
            return None
        h = q * (totals[c] - 1)
        low, high = value[c, math.floor(h)], value[c, math.ceil(h)]
        return low + (high - low) * (h - math.floor(h))

    return {c: [at(c, q) for q in probabilities] for c in columns}


def pearson(frame: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r, n) of all features in one aggregation; null pairs dropped, null below ten rows or without spread."""
    aggs = []
    for f in features:
        both = F.col(f).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(f).cast("double")), F.when(both, F.col(target).cast("double"))
        ok = (F.count(x) >= 10) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
        aggs.append(F.struct(F.lit(f).alias("feature"), F.when(ok, F.corr(x, y)).alias("r"), F.count(x).alias("n")).alias(f))
    row = frame.agg(*aggs)
    return row.select(F.explode(F.array(*features)).alias("x")).select("x.feature", "x.r", "x.n")


def effect_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < 0.1, F.lit("negligible")).when(a < 0.3, F.lit("small")).when(a < 0.5, F.lit("medium")).otherwise(F.lit("large"))


def cohens_d(frame: DataFrame, feature: str, verdict: str) -> DataFrame:
    """Difference of means over the pooled sample deviation; 0 without spread."""
    a, b = F.when(~F.col(verdict), F.col(feature)), F.when(F.col(verdict), F.col(feature))
    row = frame.agg(
        F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n1"), F.count(b).alias("n2")
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return row.select("n1", "n2", F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(F.lit(0.0)).alias("d"))


def eta_squared(frame: DataFrame, group: str, value: str) -> DataFrame:
    """Sum of squares between groups over the total; sums come from one grouped pass."""
    g = frame.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2))
    within = F.sum(F.col("n") * F.col("v"))
    return g.crossJoin(mean).agg(between.alias("b"), within.alias("w")).select(
        F.when(F.col("b") + F.col("w") > 0, F.col("b") / (F.col("b") + F.col("w"))).otherwise(F.lit(0.0)).alias("eta_squared")
    )


def bucket(x: Column, edges: Column) -> Column:
    """Number of the right-closed interval between sorted edges that holds x; the lowest edge belongs to the first."""
    inner = F.slice(edges, 2, F.size(edges) - 2)
    return F.size(F.filter(inner, lambda e: e < x))


def quantile_bins(frame: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Add ``bin``: intervals between exact quantiles, equal edges merged; the edges are literals."""
    edges = [e for e in dict.fromkeys(quantiles(frame, [column], [i / bins for i in range(bins + 1)])[column]) if e is not None]
    array = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    return frame.filter(F.col(column).isNotNull()).withColumn("bin", bucket(F.col(column), array) if len(edges) > 2 else F.lit(0))


def equal_width(frame: DataFrame, column: str, most: int = 20) -> DataFrame:
    """Add ``bin``: min(most, distinct values) intervals of equal width, right-closed, the lowest value in the first."""
    span = frame.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.least(F.lit(most), F.countDistinct(column)).alias("_k"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_k")
    at = F.greatest(F.lit(0), F.ceil((F.col(column) - F.col("_lo")) / width) - 1)
    return frame.filter(F.col(column).isNotNull()).crossJoin(span).withColumn("bin", F.when(width > 0, F.least(at, F.col("_k") - 1)).otherwise(F.lit(0)).cast("int"))


def kappa(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters with its parts; 1 if both always agree by chance too."""
    cells = frame.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))) / F.sum("n")).alias("po"))
    left = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("x"))
    right = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    pe = F.col("xy") / (F.col("n") * F.col("n"))
    po = F.coalesce("po", F.lit(0.0))
    return total.crossJoin(chance).select("n", po.alias("po"), pe.alias("pe"), F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))
