"""Operators over a frame of triples (s, p, o) with set semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = ("s", "p", "o")


def scan(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, limit: int | None = None) -> DataFrame:
    """Triples that match a pattern; None or an empty string matches anything, a limit of 0 or None is no limit.

    A limited result is the first rows by (s, p, o).
    """
    for name, value in zip(POSITIONS, (s, p, o), strict=True):
        if value:
            triples = triples.filter(F.col(name) == value)
    return triples.orderBy(*POSITIONS).limit(limit) if limit else triples


def upsert(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new triples, each once."""
    return triples.unionByName(new_only(triples, new))


def new_only(triples: DataFrame, new: DataFrame) -> DataFrame:
    """The triples of ``new`` that are not there yet, each once; the stored side is not shuffled twice."""
    return new.select(*POSITIONS).dropDuplicates().join(triples, list(POSITIONS), "left_anti")


def contains(triples: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that exist."""
    return candidates.join(triples.select(*POSITIONS), list(POSITIONS), "left_semi")


def predicate_counts(triples: DataFrame) -> DataFrame:
    """(p, n): pattern counts of all predicates in one pass."""
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def top_predicates(triples: DataFrame, limit: int = 100) -> DataFrame:
    return predicate_counts(triples).orderBy(F.col("n").desc(), "p").limit(limit)


def distinct_counts(triples: DataFrame) -> DataFrame:
    """(p, subjects, objects, pairs) of every predicate.

    Counting through two-step grouping keeps a frequent predicate from
    gathering in one task: the first step deals out by (p, value).
    """
    subjects = triples.groupBy("p", "s").agg(F.count(F.lit(1)).alias("k")).groupBy("p").agg(F.count(F.lit(1)).alias("subjects"), F.sum("k").alias("pairs"))
    objects = triples.groupBy("p", "o").agg(F.count(F.lit(1)).alias("k")).groupBy("p").agg(F.count(F.lit(1)).alias("objects"))
    return subjects.join(objects, "p").select("p", "subjects", "objects", "pairs")


def functionality(triples: DataFrame) -> DataFrame:
    """(p, functionality, inverse_functionality): mean over subjects of 1 / objects, and the same with roles swapped.

    Triples are distinct, so counting rows of (p, s) counts objects.
    """
    one = lambda key, out: triples.groupBy("p", key).agg(F.count(F.lit(1)).alias("k")).groupBy("p").agg(F.avg(1 / F.col("k")).alias(out))
    return one("s", "functionality").join(one("o", "inverse_functionality"), "p")


def relation_overlap(triples: DataFrame, position: str = "s") -> DataFrame:
    """(p1, p2, shared): how many distinct entities two predicates share at a position, for all pairs that share any.

    The predicates of an entity are gathered as a set bounded by the number of
    predicates and paired there, so no join multiplies triples.
    """
    sets = triples.groupBy(position).agg(F.sort_array(F.collect_set("p")).alias("ps")).filter(F.size("ps") > 1)
    pairs = sets.select(F.explode("ps").alias("p1"), "ps").select("p1", F.explode("ps").alias("p2")).filter("p1 < p2")
    return pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("shared"))


def distinct_entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("id")).distinct()


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: triples, predicates, entities, labels, descriptions."""
    n = lambda name: F.count(F.lit(1)).alias(name)
    parts = [
        triples.agg(n("triples")),
        triples.select("p").distinct().agg(n("predicates")),
        distinct_entities(triples).agg(n("entities")),
        entities.agg(F.count("label").alias("labels"), F.count("description").alias("descriptions")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # single rows


def label(frame: DataFrame, entities: DataFrame, id_column: str, out: str) -> DataFrame:
    """Add an entity's label; its id where it has none. Catalyst broadcasts the dimension if it is small."""
    names = entities.select(F.col("id").alias(id_column), F.col("label").alias("_label"))
    return frame.join(names, id_column, "left").withColumn(out, F.coalesce("_label", id_column)).drop("_label")


def label_entries(frame: DataFrame, entities: DataFrame, id_column: str, out: str = "entry") -> DataFrame:
    """Add "id: label | description" with placeholders where either is missing."""
    names = entities.select(F.col("id").alias(id_column), "label", "description")
    text = F.concat(
        F.col(id_column), F.lit(": "), F.coalesce("label", F.lit("[No label]")), F.lit(" | "), F.coalesce("description", F.lit("[No description]"))
    )
    return frame.join(names, id_column, "left").withColumn(out, text).drop("label", "description")


def ancestors(triples: DataFrame, predicate: str, depth: int = 3) -> DataFrame:
    """(node, ancestor, steps): ancestors over one predicate up to ``depth`` steps, by the fewest steps.

    Depth is a small constant, so the walk is unrolled into that many joins.
    """
    edge = triples.filter(F.col("p") == predicate).select(F.col("s").alias("node"), F.col("o").alias("ancestor"))
    levels, cur = [edge.withColumn("steps", F.lit(1))], edge
    for step in range(2, depth + 1):
        nxt = edge.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        cur = cur.join(nxt, "ancestor").select("node", F.col("further").alias("ancestor")).distinct()
        levels.append(cur.withColumn("steps", F.lit(step)))
    walked = reduce(DataFrame.unionByName, levels)
    return walked.groupBy("node", "ancestor").agg(F.min("steps").alias("steps"))


def compatible_types(pairs: DataFrame, types: DataFrame, generic: list[str]) -> DataFrame:
    """Pairs (a, b) of types with ``compatible``: one is an ancestor of the other, or both share an ancestor that is not generic."""
    up = types.groupBy("node").agg(F.collect_set("ancestor").alias("up"))
    left = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
    right = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
    none = F.array().cast("array<string>")
    joined = pairs.join(left, "a", "left").join(right, "b", "left").withColumns({"ua": F.coalesce("ua", none), "ub": F.coalesce("ub", none)})
    shared = F.size(F.array_except(F.array_intersect("ua", "ub"), F.array(*[F.lit(g) for g in generic]))) > 0
    direct = F.array_contains("ua", F.col("b")) | F.array_contains("ub", F.col("a")) | (F.col("a") == F.col("b"))
    return joined.select("a", "b", (direct | shared).alias("compatible"))


def facts_of(instances: DataFrame, triples: DataFrame, entity: str = "entity") -> DataFrame:
    """Out-edges of each row's entity."""
    return instances.join(triples, F.col(entity) == F.col("s"))


def first_k(frame: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark trims groups before the shuffle."""
    return frame.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
