"""Queries that derive mutants, distractors and questions from rule instances."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions import text
from lemmary.operators import distract, graph, mutate, questions
from lemmary.plans import bindings as b
from lemmary.plans import rules
from lemmary.plans.bindings import with_views as w
from lemmary.plans.graph_queries import _REGION_SQL, CHAIN_RULE, REGION_RULE
from lemmary.plans.registry import query


def instances_of(spark: SparkSession, sf: str, rule_text: str, verified: bool) -> DataFrame:
    """Instances of a rule as (instance_id, entities, body, head)."""
    t = b.triples(spark, sf)
    rule = rules.parse_horn(rule_text)
    found = rules.match(t, list(rule.body))
    if verified:
        found = rules.verified(found, t, rule)
    cell = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    part = lambda a: F.struct(cell(a.s).alias("s"), cell(a.p).alias("p"), cell(a.o).alias("o"))
    entities = F.array(*[cell(v) for v in rule.variables])
    return found.select(F.array_join(entities, "|").alias("instance_id"), entities.alias("entities"), F.array(*[part(a) for a in rule.body]).alias("body"), part(rule.head).alias("head"))


def region(spark: SparkSession, sf: str) -> DataFrame:
    return instances_of(spark, sf, REGION_RULE, True)


def chain(spark: SparkSession, sf: str) -> DataFrame:
    return instances_of(spark, sf, CHAIN_RULE, False)


_REGION = f"(SELECT a, b, c, concat(a, '|', b, '|', c) AS instance_id, concat(a, ' P17 ', b) AS x, concat(b, ' P361 ', c) AS y, concat(a, ' P30 ', c) AS head FROM ({_REGION_SQL}) WHERE EXISTS (SELECT 1 FROM triples h WHERE h.s = a AND h.p = 'P30' AND h.o = c))"
_CHAIN = """(SELECT concat(t.s, '|', t.o, '|', u.o, '|', v.o) AS instance_id, concat(t.s, ' P98 ', t.o) AS a0, concat(u.s, ' P17 ', u.o) AS a1, concat(v.s, ' P361 ', v.o) AS a2, concat(t.s, ' P30 ', v.o) AS head
FROM triples t JOIN triples u ON t.o = u.s JOIN triples v ON u.o = v.s WHERE t.p = 'P98' AND u.p = 'P17' AND v.p = 'P361')"""


@query(
    "M1_body_permutation",
    w("SELECT instance_id, k AS idx, body AS mutated_body, head AS expected_head FROM (SELECT instance_id, head, unnest([0, 1, 2, 3, 4]) AS k, unnest([" + ", ".join("concat(" + ", '   ', ".join(f"a{i}" for i in p) + ")" for p in list(permutations(range(3)))[1:]) + f"]) AS body FROM {_CHAIN})", "triples"),
)
def body_permutation(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.permute(chain(spark, sf))


@query("M1_body_permutation_pairs", w(f"SELECT instance_id, 0 AS idx, concat(y, '   ', x) AS mutated_body, head AS expected_head FROM {_REGION}", "triples"))
def body_permutation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.permute(region(spark, sf))


@query(
    "M3_body_reduction",
    w(f"SELECT instance_id, k AS idx, body AS mutated_body, head AS expected_head FROM (SELECT instance_id, head, unnest([0, 1, 2]) AS k, unnest([concat(a1, '   ', a2), concat(a0, '   ', a2), concat(a0, '   ', a1)]) AS body FROM {_CHAIN})", "triples"),
)
def body_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.reduce_body(chain(spark, sf))


def long_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """An instance with a body of 2 to 14 atoms for each part; dealt anew, as parts are few bytes in few pieces and their mutants many."""
    n, id_ = F.expr("CAST(2 + p_partkey % 13 AS INT)"), F.col("p_partkey").cast("string")
    atom = lambda i: F.struct(F.concat(F.lit("?v"), i.cast("string")).alias("s"), F.concat(F.lit("P"), (i * 7 % 5).cast("string")).alias("p"), F.concat(F.lit("Q"), id_).alias("o"))
    part = b.table(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select(id_.alias("instance_id"), F.transform(F.sequence(F.lit(0), n - 1), atom).alias("body"), F.struct(F.lit("?v0").alias("s"), F.lit("P9").alias("p"), F.lit("?v1").alias("o")).alias("head"))


_LONG = "(SELECT CAST(p_partkey AS VARCHAR) AS instance_id, 2 + p_partkey % 13 AS n, [concat('?v', i, ' P', i * 7 % 5, ' Q', p_partkey) for i in range(2 + p_partkey % 13)] AS body FROM part)"
_ORDERS = ", ".join(f"({k}, {i}, {[x + 1 for x in p]})" for k in (2, 3, 4) for i, p in enumerate(list(permutations(range(k)))[1:11]))
_DROPS = ", ".join(f"({n}, {i}, {[x + 1 for x in d]})" for n in range(2, 15) for i, d in enumerate(([(i,) for i in range(n)] + (list(combinations(range(n), 2)) if n > 3 else []))[:10]))


@query(
    "M1_long_bodies",
    f"SELECT instance_id, idx, array_to_string(list_concat(body[1:n - k], [body[n - k + x] for x in p]), '   ') AS mutated_body, '?v0 P9 ?v1' AS expected_head FROM {_LONG} JOIN (VALUES {_ORDERS}) o(k, idx, p) ON k = least(n, 4)",
)
def long_permutations(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.permute(long_bodies(spark, sf))


@query(
    "M3_long_bodies",
    f"SELECT instance_id, idx, array_to_string([body[x] for x in range(1, n + 1) if NOT list_contains(d, x)], '   ') AS mutated_body, '?v0 P9 ?v1' AS expected_head FROM {_LONG} JOIN (VALUES {_DROPS}) o(m, idx, d) ON m = n",
)
def long_reductions(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.reduce_body(long_bodies(spark, sf))


def _md5(seed: int) -> str:
    return f"md5(concat_ws('|', '{seed}', s, p, o))"


_SAMPLES = f"""samples AS (SELECT s AS entity, p, o, row_number() OVER (PARTITION BY s ORDER BY {_md5(43)}) AS rank FROM (
SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY k) AS j FROM (SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY {_md5(42)}) AS k FROM triples) WHERE k <= 20) WHERE j <= 15)"""


@query("J13_entity_samples", w(f"WITH {_SAMPLES} SELECT entity, rank, p, o FROM samples WHERE rank <= 3", "triples"))
def entity_samples(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.entity_samples(b.triples(spark, sf))


@query(
    "M2_body_augmentation",
    w(
        f"""WITH {_SAMPLES}, e AS (SELECT instance_id, a, b, x, y, head, c, unnest([0, 1, 2]) AS place, unnest([a, b, c]) AS entity FROM {_REGION}),
f AS (SELECT e.*, s.rank, concat(s.entity, ' ', s.p, ' ', s.o) AS fact FROM e JOIN samples s ON s.entity = e.entity AND s.rank <= 3 WHERE concat(s.entity, ' ', s.p, ' ', s.o) NOT IN (x, y)),
n AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY place, rank) - 1 AS idx FROM f)
SELECT instance_id, idx, concat(x, ' ', y, ' ', fact) AS mutated_body, head AS expected_head FROM n WHERE idx < 5""",
        "triples",
    ),
)
def body_augmentation(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.augment(region(spark, sf), b.triples(spark, sf))


def _kind_sql(x: str) -> str:
    place, group = "|".join(text.PLACE_WORDS), "|".join(text.GROUP_WORDS)
    return f"""CASE WHEN regexp_matches(lower({x}), '{place}') THEN 'place' WHEN regexp_matches(lower({x}), '{group}') THEN 'organization'
WHEN regexp_matches({x}, '\\S\\s+\\S') AND NOT regexp_matches({x}, '(^|\\s)[^A-Z\\s]') THEN 'person' ELSE 'object' END"""


@query("M5_entity_kinds", w(f"SELECT id, {_kind_sql('label')} AS kind FROM entities", "entities"))
def entity_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return b.entities(spark, sf).select("id", text.entity_kind("label").alias("kind"))


def _placeholder_sql(entity: str, label: str) -> str:
    number = f"CAST(concat('0x', substr(md5({entity}), 1, 8)) AS BIGINT)"
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(n) for n in names)}][{number} % {len(names)} + 1]" for k, names in mutate.PLACEHOLDERS.items())
    return f"CASE {_kind_sql(label)} {cases} END"


@query(
    "M4_entity_rename",
    w(
        f"""WITH e AS (SELECT instance_id, x, y, head, unnest([0, 1]) AS idx, unnest([a, b]) AS entity FROM {_REGION}),
n AS (SELECT e.*, {_placeholder_sql("e.entity", "coalesce(label, e.entity)")} AS new FROM e LEFT JOIN entities ON id = e.entity)
SELECT instance_id, idx, concat(replace(x, entity, new), ' ', replace(y, entity, new)) AS mutated_body, replace(head, entity, new) AS expected_head FROM n""",
        "triples",
        "entities",
    ),
)
def entity_rename(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.rename(region(spark, sf), b.entities(spark, sf))


@query("M6_merge_halves", w(f"SELECT instance_id, 0 AS idx, concat('(', a0, ') OR (', a1, ' AND ', a2, ')') AS mutated_body, head AS expected_head FROM {_CHAIN}", "triples"))
def merge_halves(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.merge_halves(chain(spark, sf))


@query(
    "M6_merge_pool",
    w(
        f"""WITH r AS (SELECT * FROM {_REGION}), pool AS (SELECT row_number() OVER (ORDER BY instance_id) - 1 AS idx, x, y, head FROM (SELECT * FROM r ORDER BY instance_id LIMIT 3))
SELECT r.instance_id, pool.idx, concat('(', r.x, ' AND ', r.y, ') OR (', pool.x, ' AND ', pool.y, ')') AS mutated_body, concat('(', r.head, ') OR (', pool.head, ')') AS expected_head FROM r CROSS JOIN pool""",
        "triples",
    ),
)
def merge_pool(spark: SparkSession, sf: str) -> DataFrame:
    r = region(spark, sf)
    return mutate.merge_pool(r, r)


@query(
    "M7_mutation_engine",
    w(
        f"""SELECT operator, count(*) AS n FROM (
SELECT 'body_permutation' AS operator FROM {_REGION} UNION ALL SELECT unnest(['body_reduction', 'body_reduction']) FROM {_REGION} UNION ALL SELECT 'rule_merging' FROM {_REGION}) GROUP BY operator""",
        "triples",
    ),
)
def mutation_engine(spark: SparkSession, sf: str) -> DataFrame:
    r = region(spark, sf)
    ops = {"body_permutation": lambda: mutate.permute(r), "body_reduction": lambda: mutate.reduce_body(r), "rule_merging": lambda: mutate.merge_halves(r)}
    return mutate.run_operators(ops).groupBy("operator").agg(F.count(F.lit(1)).alias("n"))


@query(
    "M8_mutation_classes",
    w(
        f"""SELECT instance_id, original, body, CASE WHEN contains(body, 'P31') AND NOT contains(original, 'P31') THEN 'type_addition' WHEN m > n * 1.3 THEN 'complexity_increase' WHEN m < n * 0.8 THEN 'complexity_decrease'
WHEN contains(body, 'P580') OR contains(body, 'P582') OR contains(body, 'P571') THEN 'temporal_constraint' WHEN contains(body, 'P279') THEN 'hierarchy_relation' ELSE 'semantic_variation' END AS class FROM (
SELECT instance_id, original, body, len(regexp_split_to_array(original, '\\s+')) AS n, len(regexp_split_to_array(body, '\\s+')) AS m FROM (
SELECT instance_id, concat(a0, ' ', a1, ' ', a2) AS original, unnest([concat(a0, ' ', a1), concat(a0, ' ', a1, ' ', a2, ' ', a0), concat(a0, ' ', a1, ' ', a2), concat(a0, ' P279 x'), concat(a0, ' ', a1, ' x P31 y')]) AS body FROM {_CHAIN}))""",
        "triples",
    ),
)
def mutation_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = chain(spark, sf).select("instance_id", *[mutate.atom(F.get("body", F.lit(i))).alias(f"a{i}") for i in range(3)])
    original = F.concat_ws(" ", "a0", "a1", "a2")
    bodies = F.array(F.concat_ws(" ", "a0", "a1"), F.concat_ws(" ", "a0", "a1", "a2", "a0"), original, F.concat_ws(" ", "a0", F.lit("P279 x")), F.concat_ws(" ", "a0", "a1", F.lit("x P31 y")))
    rows = c.select("instance_id", original.alias("original"), F.explode(bodies).alias("body"))
    return rows.withColumn("class", mutate.classify(F.col("original"), F.col("body")))


# ---- distractors


def _seed_sql(kind: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('_', '{kind}', a, 'P30', c)), 1, 8)) AS BIGINT)"


def _rotated(kind: str, i: int) -> str:
    return f"(CASE ({_seed_sql(kind)} + {i}) % 2 WHEN 0 THEN 'P17' ELSE 'P361' END)"


#: All candidates of the region rule in the order of the strategies; those that repeat an earlier one are dropped below.
_CANDIDATE_ROWS = [
    ("c", "'P30'", "a"), ("a", _rotated("rel", 0), "c"), ("a", _rotated("rel", 1), "c"), ("a", "'P30'", "b"), ("b", "'P30'", "c"),
    ("a", _rotated("body", 0), "b"), ("a", _rotated("body", 1), "c"), ("a", "'P30'", "b"), ("b", "'P30'", "c"), ("c", "'P30'", "a"),
    ("a", "'P30'", "b"), ("a", "'P361'", "b"), ("b", "'P17'", "c"),
]
_CANDIDATES = (
    "(SELECT instance_id, x, y, head, s, p, o, row_number() OVER (PARTITION BY instance_id ORDER BY k) - 1 AS pos FROM (SELECT instance_id, x, y, head, s, p, o, min(k) AS k FROM (SELECT instance_id, a, b, c, x, y, head, unnest(["
    + ", ".join(str(i) for i in range(len(_CANDIDATE_ROWS)))
    + "]) AS k, "
    + ", ".join(f"unnest([{', '.join(r[i] for r in _CANDIDATE_ROWS)}]) AS {n}" for i, n in enumerate("spo"))
    + f" FROM {_REGION}) WHERE NOT (s = a AND p = 'P30' AND o = c) GROUP BY ALL HAVING true))"
).replace("min(k) AS k FROM", "min(k) AS k FROM").replace(" GROUP BY ALL HAVING true", " GROUP BY instance_id, x, y, head, s, p, o")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    r = region(spark, sf)
    relations = F.array(*[F.lit(p) for p in ("P17", "P30", "P361")])
    found = distract.candidates(F.col("head"), F.col("body"), F.col("entities"), relations, F.lit(True), most=10)
    return r.select("instance_id", "head", "body", F.posexplode(found).alias("pos", "candidate"))


@query("D1_distractor_candidates", w(f"SELECT instance_id, pos, s, p, o FROM {_CANDIDATES} WHERE pos < 10", "triples"))
def distractor_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select("instance_id", "pos", "candidate.s", "candidate.p", "candidate.o")


_VALIDATED = f"""(SELECT q.instance_id, q.pos, q.s, q.p, q.o, q.head, CASE WHEN concat(q.s, ' ', q.p, ' ', q.o) IN (x, y) THEN 'duplicates premise'
WHEN coalesce(lower(es.label), lower(q.s)) = coalesce(lower(eo.label), lower(q.o)) THEN 'self-referential' WHEN t.s IS NOT NULL THEN 'in graph' ELSE 'valid' END AS reason
FROM {_CANDIDATES} q LEFT JOIN entities es ON es.id = q.s LEFT JOIN entities eo ON eo.id = q.o LEFT JOIN triples t ON t.s = q.s AND t.p = q.p AND t.o = q.o WHERE q.pos < 10)"""


@query("F12_candidate_validation", w(f"SELECT instance_id, pos, reason FROM {_VALIDATED}", "triples", "entities"))
def candidate_validation(spark: SparkSession, sf: str) -> DataFrame:
    return distract.validate(candidates(spark, sf), b.triples(spark, sf), b.entities(spark, sf)).select("instance_id", "pos", "reason")


@query(
    "D2_distractors",
    w(f"SELECT instance_id, rank, s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY pos) AS rank FROM {_VALIDATED} WHERE reason = 'valid') WHERE rank <= 3", "triples", "entities"),
)
def distractors(spark: SparkSession, sf: str) -> DataFrame:
    v = distract.validate(candidates(spark, sf), b.triples(spark, sf), b.entities(spark, sf)).filter("reason = 'valid'")
    return graph.first_k(v, ["instance_id"], ["pos"], 3).select("instance_id", "rank", "candidate.s", "candidate.p", "candidate.o")


_RULE_ROWS = "(VALUES ('region', 'P30', ['P17', 'P361']), ('inverse', 'P527', ['P361']), ('order', 'P800', ['P98']), ('chain', 'P30', ['P98', 'P17', 'P361'])) AS t(rule_id, head_p, body_ps)"


def _rule_rows(spark: SparkSession) -> DataFrame:
    rows = [("region", "P30", ["P17", "P361"]), ("inverse", "P527", ["P361"]), ("order", "P800", ["P98"]), ("chain", "P30", ["P98", "P17", "P361"])]
    return spark.createDataFrame(rows, "rule_id string, head_p string, body_ps array<string>")


@query("F15_negation_safety", "SELECT rule_id, NOT (head_p = 'P527' AND list_contains(body_ps, 'P361')) AS safe FROM " + _RULE_ROWS)
def negation_safety(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_rows(spark).select("rule_id", distract.negation_safe(F.col("head_p"), F.col("body_ps")).alias("safe"))


@query(
    "F14_inverse_lookup",
    w("SELECT p, CASE p WHEN 'P361' THEN 'P527' WHEN 'P527' THEN 'P361' END AS inverse, false AS symmetric FROM (SELECT DISTINCT p FROM triples)", "triples"),
)
def inverse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse and symmetry of every predicate, from a dimension of a few rows."""
    pairs = dict(distract.UNSAFE_PAIRS) | {c: a for a, c in distract.UNSAFE_PAIRS} | distract.INVERSES
    table = spark.createDataFrame(sorted(pairs.items()), "p string, inverse string")
    found = b.triples(spark, sf).select("p").distinct().join(table, "p", "left")
    return found.select("p", "inverse", F.col("p").isin(distract.SYMMETRIC).alias("symmetric"))


@query("F7_suitable_predicates", w("SELECT p, true AS suitable FROM (SELECT DISTINCT p FROM triples)", "triples"))
def suitable_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return b.triples(spark, sf).select("p").distinct().select("p", mutate.suitable(F.col("p")).alias("suitable"))


# ---- questions

_LABELLED = f"(SELECT r.*, coalesce(ea.label, a) AS la, coalesce(eb.label, b) AS lb, coalesce(ec.label, c) AS lc FROM {_REGION} r LEFT JOIN entities ea ON ea.id = a LEFT JOIN entities eb ON eb.id = b LEFT JOIN entities ec ON ec.id = c)"
_PREMISES = "concat(la, ' country ', lb, ', and that ', lb, ' part of ', lc)"
_CONCLUSION = "concat(la, ' continent ', lc)"
#: Labels of the relations that the questions use.
RELATION_LABELS = {"P17": "country", "P361": "part of", "P30": "continent"}


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Region instances with premises and conclusion as statements of labels."""
    r = region(spark, sf).select("instance_id", *[F.get("entities", F.lit(i)).alias(n) for i, n in enumerate("abc")])
    e = b.entities(spark, sf)
    for n in "abc":
        r = graph.label(r, e, n, f"l{n}")
    say = lambda s, p, o: questions.statement(F.col(s), F.lit(RELATION_LABELS[p]), F.col(o))
    return r.withColumns({"premises": F.array(say("la", "P17", "lb"), say("lb", "P361", "lc")), "conclusion": say("la", "P30", "lc")})


@query("Q1_yes_no", w(f"SELECT instance_id, concat('Given that ', {_PREMISES}, ', is it true that ', {_CONCLUSION}, '?') AS question, true AS answer FROM {_LABELLED}", "triples", "entities"))
def yes_no(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("instance_id", questions.yes_no(F.col("premises"), F.col("conclusion")).alias("question"), F.lit(True).alias("answer"))


@query("Q2_true_false", w(f"SELECT instance_id, concat('Based on the premises that ', {_PREMISES}, ', is it true that ', {_CONCLUSION}, '?') AS question FROM {_LABELLED}", "triples", "entities"))
def true_false(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("instance_id", questions.true_false(F.col("premises"), F.col("conclusion")).alias("question"))


_POSITION = "CAST(CAST(concat('0x', substr(md5(head), 1, 8)) AS BIGINT) % 4 AS INT)"


@query("D4_answer_position", w(f"SELECT instance_id, {_POSITION} AS hashed, CAST(length(instance_id) % 4 AS INT) AS seeded FROM {_REGION}", "triples"))
def answer_position(spark: SparkSession, sf: str) -> DataFrame:
    r = region(spark, sf)
    head = mutate.atom(F.col("head"))
    return r.select("instance_id", questions.correct_position(4, head).alias("hashed"), questions.correct_position(4, head, F.length("instance_id")).alias("seeded"))


_FOUR = "[concat(lc, ' continent ', la), concat(la, ' continent ', lb), concat(lb, ' continent ', lc)]"


@query(
    "Q3_multiple_choice",
    w(
        f"""SELECT instance_id, chr(65 + pos) AS letter, concat('Given that ', {_PREMISES}, ', which of the following conclusions is logically valid?', chr(10), chr(10),
'A. ', o[1], chr(10), 'B. ', o[2], chr(10), 'C. ', o[3], chr(10), 'D. ', o[4]) AS question FROM (
SELECT *, list_concat(list_concat(d[1:pos], [{_CONCLUSION}]), d[pos + 1:3]) AS o FROM (SELECT *, {_POSITION} AS pos, {_FOUR} AS d FROM {_LABELLED})) WHERE len(list_distinct(o)) = 4""",
        "triples",
        "entities",
    ),
)
def multiple_choice(spark: SparkSession, sf: str) -> DataFrame:
    say = lambda s, o: questions.statement(F.col(s), F.lit("continent"), F.col(o))
    r = labelled(spark, sf).withColumn("wrong", F.array(say("lc", "la"), say("la", "lb"), say("lb", "lc")))
    r = r.withColumn("pos", questions.correct_position(4, F.concat_ws(" ", "a", F.lit("P30"), "c")))
    r = r.withColumn("options", questions.options(F.col("wrong"), F.col("conclusion"), F.col("pos"), 4)).filter("options IS NOT NULL")
    return r.select("instance_id", questions.letter(F.col("pos")).alias("letter"), questions.multiple_choice(F.col("premises"), F.col("options")).alias("question"))


@query(
    "Q4_wh_direction",
    w(
        """WITH f AS (SELECT p, avg(1.0 / k) AS f FROM (SELECT p, s, count(*) AS k FROM triples GROUP BY p, s) GROUP BY p),
g AS (SELECT p, avg(1.0 / k) AS g FROM (SELECT p, o, count(*) AS k FROM triples GROUP BY p, o) GROUP BY p)
SELECT p, CASE WHEN f >= g THEN 'object' ELSE 'subject' END AS asks_for FROM f JOIN g USING (p)""",
        "triples",
    ),
)
def wh_direction(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.functionality(b.triples(spark, sf))
    return f.select("p", questions.wh_direction(F.col("functionality"), F.col("inverse_functionality")).alias("asks_for"))


@query(
    "Q5_premise_joiner",
    """SELECT o_orderkey, n, CASE n WHEN 1 THEN ps[1] ELSE concat(array_to_string(ps[1:n - 1], ', '), ', and that ', ps[n]) END AS premises FROM (
SELECT l_orderkey AS o_orderkey, count(*) AS n, list(concat('part ', l_partkey) ORDER BY l_linenumber, l_partkey, l_suppkey) AS ps FROM lineitem GROUP BY l_orderkey)""",
)
def premise_joiner(spark: SparkSession, sf: str) -> DataFrame:
    item = b.table(spark, sf, "lineitem")
    g = item.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x")
    )
    parts = F.transform("x", lambda v: F.concat(F.lit("part "), v["l_partkey"].cast("string")))
    return g.select("o_orderkey", "n", text.join_premises(parts).alias("premises"))


@query("Q7_statements", w("SELECT s, o, concat(coalesce(e.label, s), ' is owned by ', coalesce(f.label, o)) AS statement FROM triples LEFT JOIN entities e ON e.id = s LEFT JOIN entities f ON f.id = o WHERE p = 'P98'", "triples", "entities"))
def statements(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf).filter("p = 'P98'")
    e = b.entities(spark, sf)
    named = graph.label(graph.label(t, e, "s", "ls"), e, "o", "lo")
    said = questions.statement(F.col("ls"), F.col("p"), F.col("lo"), F.lit("{subject} is owned by {object}"))
    return named.select("s", "o", said.alias("statement"))


@query(
    "D3_conclusion_negation",
    w(
        """SELECT s, p, o, CASE p WHEN 'P361' THEN concat(lo, ' part of ', ls) WHEN 'P17' THEN concat(ls, ' not connected to ', lo) WHEN 'P98' THEN concat(ls, ' not the father of ', lo)
ELSE concat('It is not true that ', lower(concat(ls, ' continent ', lo))) END AS negated FROM (SELECT t.*, coalesce(es.label, s) AS ls, coalesce(eo.label, o) AS lo
FROM triples t LEFT JOIN entities es ON es.id = s LEFT JOIN entities eo ON eo.id = o WHERE p IN ('P361', 'P17', 'P98', 'P30'))""",
        "triples",
        "entities",
    ),
)
def conclusion_negation(spark: SparkSession, sf: str) -> DataFrame:
    """Each way to negate a conclusion: P361 beside its inverse P527, a border's label on P17, a relation with its own wording (P22 for P98), the others."""
    t, e = b.triples(spark, sf).filter(F.col("p").isin("P361", "P17", "P98", "P30")), b.entities(spark, sf)
    t = graph.label(graph.label(t, e, "s", "ls"), e, "o", "lo")
    label = F.when(F.col("p") == "P361", F.lit("part of")).when(F.col("p") == "P17", F.lit("shares Border with")).when(F.col("p") == "P98", F.lit("father")).otherwise(F.lit("continent"))
    relation = F.when(F.col("p") == "P98", F.lit("P22")).otherwise(F.col("p"))
    premises = F.array(F.lit("P527"), F.lit("P131"))
    return t.select("s", "p", "o", distract.negated_conclusion(relation, F.col("ls"), label, F.col("lo"), premises).alias("negated"))


@query("D3_negated_conclusions", w(f"SELECT instance_id, concat('It is not true that ', lower({_CONCLUSION})) AS negated FROM {_LABELLED}", "triples", "entities"))
def negated_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.functions import grammar

    return labelled(spark, sf).select("instance_id", grammar.negate(F.col("conclusion")).alias("negated"))


@query(
    "J11_question_pairing",
    "SELECT coalesce(o.k, m.k) AS k, coalesce(o.pos, m.pos) AS pos, coalesce(original, '') AS original, coalesce(mutated, '') AS mutated FROM (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, concat('part ', l_partkey) AS original FROM lineitem WHERE l_returnflag = 'R') o "
    "FULL JOIN (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, concat('part ', l_partkey) AS mutated FROM lineitem WHERE l_returnflag = 'A') m ON o.k = m.k AND o.pos = m.pos",
)
def question_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of each key side by side, the shorter one padded with empty texts."""
    item = b.table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    side = lambda flag: F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, order)))
    named = lambda c: F.transform(c, lambda v: F.concat(F.lit("part "), v["l_partkey"].cast("string")))
    g = item.groupBy(F.col("l_orderkey").alias("k")).agg(side("R").alias("x"), side("A").alias("y"))
    zipped = F.arrays_zip(named("x").alias("original"), named("y").alias("mutated"))
    return g.select("k", F.posexplode(zipped).alias("pos", "z")).select("k", "pos", F.coalesce("z.original", F.lit("")).alias("original"), F.coalesce("z.mutated", F.lit("")).alias("mutated"))
