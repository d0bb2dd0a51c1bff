"""Mutants of rule instances: each operator is a projection that gives 0..k rows for one.

An instance has columns instance_id, body array<struct<s,p,o>>, head
struct<s,p,o>. Operators return (instance_id, idx, mutated_body, expected_head).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.text import UNSUITABLE, any_of, entity_kind
from lemmary.operators.sampling import order_key

JOIN = "   "
LIMIT = 10
#: Placeholders for a renamed entity of each kind.
PLACEHOLDERS = {
    "person": ["Person1", "Person2", "Person3"],
    "place": ["Place1", "Place2", "Place3", "City1", "City2", "Town1"],
    "organization": ["Organization1", "Organization2", "Company1", "Company2", "Institute1"],
    "object": ["Object1", "Object2", "Thing1", "Thing2", "Entity1", "Entity2"],
}


def atom(x: Column) -> Column:
    return F.concat_ws(" ", x["s"], x["p"], x["o"])


def atoms(body: Column, between: str = JOIN) -> Column:
    return F.array_join(F.transform(body, atom), between)


def _expanded(instances: DataFrame, bodies: Column, head: Column | None = None) -> DataFrame:
    head = atom(F.col("head")) if head is None else head
    return instances.select("instance_id", F.posexplode(bodies).alias("idx", "mutated_body"), head.alias("expected_head"))


def _table(rows: Iterable[tuple[int, ...]]) -> Column:
    """A literal table of index lists; as JSON it folds to one constant instead of a large expression."""
    return F.from_json(F.lit(json.dumps([list(r) for r in rows])), "array<array<int>>")


def permute(instances: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Other orders of the body, lexicographic by position, the first ten that differ in value. Bodies of any length.

    The first orders move the last four atoms only, and of four atoms that are
    not all equal 18 orders at least differ from the body. If more than three
    equal atoms end the body, the first orders that differ have one of them in
    the place of the atom before them; the last four then take all their orders.
    Orders are exploded as places in the last four atoms, and written out after.
    """
    if limit > 18:
        raise ValueError("the last four atoms have 18 other orders for certain")
    n = F.size("body")
    alike = (n > 4) & (F.size(F.array_distinct(F.slice("body", n - 3, 4))) == 1)
    other = F.array_max(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(~F.get("body", i).eqNullSafe(F.get("body", n - 1)), i)))
    marked = instances.filter(n > 1).select("instance_id", "body", atom(F.col("head")).alias("expected_head"), F.when(alike, other).alias("_at"))
    at = F.col("_at")
    traded = F.concat(F.slice("body", F.lit(1), at), F.array(F.get("body", at + 1), F.get("body", at)), F.slice("body", at + 3, n))
    body = marked.withColumn("body", F.when(at.isNull(), F.col("body")).otherwise(traded))
    k = F.least(n, F.lit(4))
    parts = body.select(
        "instance_id", "expected_head", at.isNotNull().alias("_all"), F.slice("body", n - k + 1, k).alias("_tail"),
        F.when(n > 4, atoms(F.slice("body", F.lit(1), n - 4))).alias("_front"),
    )
    k = F.size("_tail")
    table = F.when(k == 2, _table(permutations(range(2)))).when(k == 3, _table(permutations(range(3)))).otherwise(_table(permutations(range(4))))
    differs = lambda p: F.transform(p, lambda i: F.get("_tail", i)) != F.col("_tail")
    plain = F.size(F.array_distinct("_tail")) == k
    orders = F.when(F.col("_all"), table).when(plain, F.slice(table, 2, limit)).otherwise(F.filter(table, differs))
    said = parts.select("instance_id", "expected_head", "_front", F.transform("_tail", atom).alias("_said"), F.posexplode(F.slice(orders, 1, limit)).alias("idx", "_order"))
    words = [F.get("_said", F.get("_order", F.lit(j))) for j in range(4)]  # null beyond a shorter body, and skipped
    return said.select("instance_id", "idx", F.concat_ws(JOIN, "_front", *words).alias("mutated_body"), "expected_head")


def reduce_body(instances: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The body without each atom, and without each pair of atoms if it has over three; the first ten. Bodies of any length from two."""
    body, n = F.col("body"), F.size("body")
    single = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.array(i))
    out = F.when(n >= limit, single).otherwise(F.array().cast("array<array<int>>"))  # a longer body has enough single atoms
    for k in range(2, limit):
        out = F.when(n == k, _table([(i,) for i in range(k)] + (list(combinations(range(k), 2)) if k > 3 else []))).otherwise(out)
    texts = F.transform(F.slice(out, 1, limit), lambda d: atoms(F.filter(body, lambda x, i: ~F.array_contains(d, i))))
    return _expanded(instances, texts)


def suitable(p: Column) -> Column:
    """Not a label, link or identifier."""
    return ~any_of(F.lower(p), UNSUITABLE)


def entity_samples(triples: DataFrame, seed: int = 42, first: int = 20, kept: int = 15, sampled: int = 3) -> DataFrame:
    """(entity, rank, p, o): few facts of each entity: 20 by hash, the suitable ones up to 15, of which 3 by another hash.

    Both cuts are windows over the entity that Spark trims before the shuffle,
    so an entity with many facts costs no more than others.
    """
    drawn = Window.partitionBy("s").orderBy(order_key(seed, "s", "p", "o"))
    again = Window.partitionBy("s").orderBy(order_key(seed + 1, "s", "p", "o"))
    t = triples.withColumn("_a", F.row_number().over(drawn)).filter(F.col("_a") <= first).filter(suitable(F.col("p")))
    t = t.withColumn("_b", F.row_number().over(Window.partitionBy("s").orderBy("_a"))).filter(F.col("_b") <= kept)
    t = t.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= sampled)
    return t.select(F.col("s").alias("entity"), "rank", "p", "o")


def augment(instances: DataFrame, triples: DataFrame, limit: int = 5, seed: int = 42) -> DataFrame:
    """The body with one more true fact about an entity of the instance; at most five, facts of the body skipped.

    Instances need a column entities, in the order of the rule's variables.
    """
    rows = instances.select("instance_id", "body", "head", F.posexplode("entities").alias("at", "entity"))
    wanted = rows.select(F.col("entity").alias("s")).distinct()
    facts = entity_samples(triples.join(wanted, "s", "left_semi"), seed)  # windows over the entities in use only
    joined = rows.join(facts, "entity").withColumn("fact", F.struct(F.col("entity").alias("s"), F.col("p").alias("p"), F.col("o").alias("o")))
    fresh = joined.filter(~F.array_contains("body", F.col("fact")))
    n = F.row_number().over(Window.partitionBy("instance_id").orderBy("at", "rank"))
    return fresh.withColumn("idx", n - 1).filter(F.col("idx") < limit).select(
        "instance_id", "idx", F.concat_ws(" ", atoms(F.col("body"), " "), atom(F.col("fact"))).alias("mutated_body"), atom(F.col("head")).alias("expected_head")
    )


def placeholder(entity: Column, label: Column) -> Column:
    """A name for the label's kind, chosen by the entity's hash."""
    kind = entity_kind(label)
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (F.conv(F.substring(F.md5(entity.cast("binary")), 1, 8), 16, 10).cast("long") % len(names)).cast("int"))
    out = pick(PLACEHOLDERS["object"])
    for k in ("person", "place", "organization"):
        out = F.when(kind == k, pick(PLACEHOLDERS[k])).otherwise(out)
    return out


def rename(instances: DataFrame, entities: DataFrame, first: int = 2) -> DataFrame:
    """Each of the first entities replaced, as a part of subjects and objects, by a placeholder of its kind."""
    rows = instances.select("instance_id", "body", "head", F.posexplode(F.slice("entities", 1, first)).alias("idx", "entity"))
    named = rows.join(entities.select(F.col("id").alias("entity"), "label"), "entity", "left")
    new = placeholder(F.col("entity"), F.coalesce("label", "entity"))
    swap = lambda x: F.struct(F.replace(x["s"], F.col("entity"), F.col("new")).alias("s"), x["p"].alias("p"), F.replace(x["o"], F.col("entity"), F.col("new")).alias("o"))
    return named.withColumn("new", new).select(
        "instance_id", "idx", atoms(F.transform("body", swap), " ").alias("mutated_body"), atom(swap(F.col("head"))).alias("expected_head")
    )


def merge_halves(instances: DataFrame) -> DataFrame:
    """Without other rules: the body's halves as alternatives."""
    half = F.floor(F.size("body") / 2).cast("int")
    left, right = F.slice("body", F.lit(1), half), F.slice("body", half + 1, F.size("body") - half)
    text = F.concat(F.lit("("), atoms(left, " AND "), F.lit(") OR ("), atoms(right, " AND "), F.lit(")"))
    return _expanded(instances.filter(F.size("body") >= 2), F.array(text))


def merge_pool(instances: DataFrame, pool: DataFrame, first: int = 3) -> DataFrame:
    """Alternatives with each of the first instances of a pool, by their id; the pool is a handful of rows."""
    some = pool.orderBy("instance_id").limit(first)
    n = F.row_number().over(Window.orderBy("instance_id")) - 1  # over at most ``first`` rows
    some = some.select(n.alias("idx"), F.col("body").alias("body2"), F.col("head").alias("head2"))
    both = instances.crossJoin(F.broadcast(some))
    side = lambda b: F.concat(F.lit("("), atoms(F.col(b), " AND "), F.lit(")"))
    head = F.concat(F.lit("("), atom(F.col("head")), F.lit(") OR ("), atom(F.col("head2")), F.lit(")"))
    return both.select("instance_id", "idx", F.concat(side("body"), F.lit(" OR "), side("body2")).alias("mutated_body"), head.alias("expected_head"))


def run_operators(operators: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The union of operators' mutants with their names."""
    frames = [f().withColumn("operator", F.lit(name)) for name, f in operators.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def classify(original: Column, mutated: Column) -> Column:
    """What kind of change a mutant is."""
    n, m = F.size(F.split(F.trim(original), r"\s+")), F.size(F.split(F.trim(mutated), r"\s+"))
    has = lambda x, p: F.contains(x, F.lit(p))
    return (
        F.when(has(mutated, "P31") & ~has(original, "P31"), F.lit("type_addition"))
        .when(m > n * 1.3, F.lit("complexity_increase"))
        .when(m < n * 0.8, F.lit("complexity_decrease"))
        .when(any_of(mutated, ["P580", "P582", "P571"]), F.lit("temporal_constraint"))
        .when(has(mutated, "P279"), F.lit("hierarchy_relation"))
        .otherwise(F.lit("semantic_variation"))
    )
