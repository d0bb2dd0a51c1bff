"""Plausible but false triples beside a true conclusion.

Rows need head and body as in mutants, and the entity and relation ids of their
context. Candidates come from nine strategies in a fixed order as one array per
row; validation is a chain of ordered reasons, the last one a join with the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmary.functions import grammar
from lemmary.operators import questions

#: Relations that hold in both directions, and relations with their inverses.
SYMMETRIC = ["P3373", "P451", "P1327", "P2350"]
INVERSES = {
    "P22": "P40", "P40": "P22", "P25": "P40", "P7": "P26", "P26": "P7", "P3373": "P3373", "P2673": "P2674", "P2674": "P2673",
    "P3729": "P3730", "P3730": "P3729", "P155": "P156", "P156": "P155", "P1365": "P1366", "P1366": "P1365",
}
#: Inverse pairs whose negation is unsafe.
UNSAFE_PAIRS = [("P2673", "P2674"), ("P3729", "P3730"), ("P22", "P40"), ("P25", "P40"), ("P131", "P150"), ("P155", "P156"), ("P361", "P527")]

#: Relations with a wording of their own when negated, and the one for labels that name a border.
NEGATED_RELATIONS = {
    "P2673": "not the next crossing downstream from", "P2674": "not the next crossing upstream from", "P22": "not the father of", "P25": "not the mother of",
}
NEGATED_BORDER = "not connected to"


def triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


def seed(kind: str, t: Column) -> Column:
    """A number from the md5 of a strategy's name and the triple."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(kind), t["s"], t["p"], t["o"]).cast("binary")), 1, 8), 16, 10).cast("long")


def inverse_of(p: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in INVERSES.values()]), F.array_position(F.array(*[F.lit(k) for k in INVERSES]), p).cast("int") - 1)


def _rotate(values: Column, start: Column, most: int) -> Column:
    """Up to ``most`` values from a place on, around the end."""
    n = F.size(values)
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(0), F.least(F.lit(most), n) - 1), lambda i: F.get(values, ((start + i) % n).cast("int")))
    ).otherwise(F.array().cast("array<string>"))


def candidates(head: Column, body: Column, entities: Column, relations: Column, functional: Column, most: int = 10) -> Column:
    """Distinct candidates in the order of their strategies, without the conclusion, cut to ``most``."""
    s, p, o = head["s"], head["p"], head["o"]
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")
    if_ = lambda c, a: F.when(c, a).otherwise(none)
    other_relations = F.array_sort(F.filter(relations, lambda r: r != p))
    other_entities = F.array_sort(F.filter(entities, lambda e: (e != s) & (e != o)))
    nodes = F.array_sort(F.array_distinct(F.flatten(F.transform(body, lambda t: F.array(t["s"], t["o"])))))
    between = F.filter(nodes, lambda e: (e != s) & (e != o))
    swapped = triple(o, p, s)
    pairs = F.flatten(F.transform(nodes, lambda a: F.transform(F.filter(nodes, lambda c: c != a), lambda c: F.struct(a.alias("a"), c.alias("c")))))
    two = F.transform(
        F.slice(pairs, 1, 2), lambda x, i: triple(x["a"], F.get(other_relations, ((seed("body", head) + i) % F.size(other_relations)).cast("int")), x["c"])
    )
    chain = F.concat(F.flatten(F.transform(between, lambda e: F.array(triple(s, p, e), triple(e, p, o)))), F.array(swapped))
    premises = F.flatten(
        F.transform(
            F.filter(body, lambda t: t != head),
            lambda t: F.transform(F.slice(F.filter(relations, lambda r: r != t["p"]), 1, 2), lambda r: triple(t["s"], r, t["o"])),
        )
    )
    inverse = inverse_of(p)
    parts = [
        if_(s != o, F.array(swapped)),
        F.transform(_rotate(other_relations, seed("rel", head), 3), lambda r: triple(s, r, o)),
        F.transform(_rotate(other_entities, seed("obj", head), 3), lambda e: triple(s, p, e)),
        F.transform(_rotate(other_entities, seed("subj", head), 2), lambda e: triple(e, p, o)),
        if_((F.size(other_relations) > 0) & (F.size(nodes) >= 2), two),
        if_(functional, F.transform(_rotate(other_entities, seed("func", head), 2), lambda e: triple(s, p, e))),
        if_(~p.isin(SYMMETRIC), F.array(swapped)),
        if_(inverse.isNotNull() & (inverse != p), F.array(triple(s, inverse, o))),
        if_(F.size(body) >= 2, F.slice(chain, 1, 3)),
        F.slice(premises, 1, 3),
    ]
    found = F.array_distinct(F.concat(*parts))
    return F.slice(F.filter(found, lambda t: t != head), 1, most)


def validate(frame: DataFrame, triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows with candidate, head and body get ``reason``: why it is rejected, or 'valid'.

    In order: equal to the conclusion, a premise, subject and object of one
    label (parentheses aside), a triple of the graph.
    """
    label = lambda k, out: entities.select(F.col("id").alias(k), F.lower(F.trim(F.regexp_replace("label", r"\s*\([^)]*\)\s*", ""))).alias(out))
    known = triples.select("s", "p", "o").withColumn("_known", F.lit(True))
    rows = frame.select("*", "candidate.s", "candidate.p", "candidate.o")
    rows = rows.join(label("s", "_sl"), "s", "left").join(label("o", "_ol"), "o", "left").join(known, ["s", "p", "o"], "left")
    same = F.coalesce("_sl", F.lower("s")) == F.coalesce("_ol", F.lower("o"))
    reason = (
        F.when(F.col("candidate") == F.col("head"), F.lit("equals conclusion"))
        .when(F.array_contains("body", F.col("candidate")), F.lit("duplicates premise"))
        .when(same, F.lit("self-referential"))
        .when(F.col("_known"), F.lit("in graph"))
        .otherwise(F.lit("valid"))
    )
    return rows.withColumn("reason", reason).drop("s", "p", "o", "_sl", "_ol", "_known")


def negation_safe(head_p: Column, body_ps: Column) -> Column:
    """Unsafe if the inverse of the conclusion's relation is among the premises'."""
    unsafe = F.lit(False)
    pairs = dict(UNSAFE_PAIRS) | {b: a for a, b in UNSAFE_PAIRS}
    for a, b in pairs.items():
        unsafe = F.when(head_p == a, F.array_contains(body_ps, b)).otherwise(unsafe)
    return ~unsafe


def negated_conclusion(p: Column, subject: Column, label: Column, obj: Column, premises: Column) -> Column:
    """A false statement from a conclusion: relation p, labels of its three parts, relations of the premises.

    With the inverse relation among the premises a negation would hold, so the
    positive statement has its ends swapped; then come relations with a wording
    of their own, then labels that name a border, then the grammatical negation.
    Null labels give null.
    """
    special = F.lit(None).cast("string")
    for relation, words in NEGATED_RELATIONS.items():
        special = F.when(p == relation, F.lit(words)).otherwise(special)
    special = F.coalesce(special, F.when(F.contains(F.lower(label), F.lit("border")), F.lit(NEGATED_BORDER)))
    return (
        F.when(~negation_safe(p, premises), questions.statement(obj, label, subject))
        .when(special.isNotNull(), questions.statement(subject, special, obj))
        .otherwise(grammar.negate(questions.statement(subject, label, obj)))
    )
