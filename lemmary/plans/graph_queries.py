"""Queries over triples and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.operators import graph
from lemmary.plans import bindings as b
from lemmary.plans import rules
from lemmary.plans.bindings import with_views as w
from lemmary.plans.registry import query

#: The rules that the queries run.
REGION_RULE = "?a  P17  ?b  ?b  P361  ?c   => ?a  P30  ?c"
INVERSE_RULE = "?a  P361  ?b   => ?b  P527  ?a"
ORDER_RULE = "?o  P98  ?c   => ?c  P800  ?o"
CHAIN_RULE = "?o  P98  ?c  ?c  P17  ?n  ?n  P361  ?r   => ?o  P30  ?r"
OR_RULE = "(?a P17 ?b OR ?b P527 ?a) => ?a P30 ?b"
NOT_RULE = "?a P17 ?b AND ?b P361 ?c AND NOT ?a P30 ?c => ?a P30 ?c"
RULES = {"region": REGION_RULE, "inverse": INVERSE_RULE, "order": ORDER_RULE, "chain": CHAIN_RULE}


def predicate_table(triples: DataFrame) -> dict[str, int]:
    """Counts by predicate on the driver: as many rows as there are predicates."""
    return {r.p: r.n for r in graph.predicate_counts(triples).collect()}


@query("S1_triple_scan", w("SELECT s, p, o FROM triples WHERE p = 'P361' AND o = 'Q3000000001'", "triples"))
def triple_scan(spark: SparkSession, sf: str) -> DataFrame:
    return graph.scan(b.triples(spark, sf), p="P361", o="Q3000000001")


@query("S1_triple_scan_limit", w("SELECT s, p, o FROM triples WHERE p = 'P98' ORDER BY s, p, o LIMIT 20", "triples"))
def triple_scan_limit(spark: SparkSession, sf: str) -> DataFrame:
    return graph.scan(b.triples(spark, sf), p="P98", limit=20)


@query(
    "S2_triple_upsert",
    w("SELECT s, p, o FROM triples WHERE p <> 'P800' UNION SELECT o, 'P800', s FROM triples WHERE p = 'P98'", "triples"),
)
def triple_upsert(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    new = t.filter("p = 'P98'").select(F.col("o").alias("s"), F.lit("P800").alias("p"), F.col("s").alias("o"))
    return graph.upsert(t.filter("p <> 'P800'"), new)


@query(
    "S2_new_triples",
    w("SELECT o AS s, 'P800' AS p, s AS o FROM triples WHERE p = 'P98' EXCEPT SELECT s, p, o FROM triples", "triples"),
)
def new_triples(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    return graph.new_only(t, t.filter("p = 'P98'").select(F.col("o").alias("s"), F.lit("P800").alias("p"), F.col("s").alias("o")))


@query(
    "F4_contains",
    w("SELECT o AS s, 'P527' AS p, s AS o FROM triples WHERE p = 'P361' INTERSECT SELECT s, p, o FROM triples", "triples"),
)
def contains(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    return graph.contains(t, t.filter("p = 'P361'").select(F.col("o").alias("s"), F.lit("P527").alias("p"), F.col("s").alias("o")))


@query("A1_pattern_counts", w("SELECT p, count(*) AS n FROM triples GROUP BY p", "triples"))
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.predicate_counts(b.triples(spark, sf))


@query(
    "A2_distinct_counts",
    w("SELECT p, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, count(*) AS pairs FROM triples GROUP BY p", "triples"),
)
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.distinct_counts(b.triples(spark, sf))


_FUNCTIONALITY = """
WITH f AS (SELECT p, avg(1.0 / k) AS f FROM (SELECT p, s, count(*) AS k FROM triples GROUP BY p, s) GROUP BY p),
g AS (SELECT p, avg(1.0 / k) AS g FROM (SELECT p, o, count(*) AS k FROM triples GROUP BY p, o) GROUP BY p)
SELECT p, round(f, 9) AS functionality, round(g, 9) AS inverse_functionality FROM f JOIN g USING (p)
"""


def rounded_functionality(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.functionality(b.triples(spark, sf))
    return f.select("p", F.round("functionality", 9).alias("functionality"), F.round("inverse_functionality", 9).alias("inverse_functionality"))


query("A3_functionality", w(_FUNCTIONALITY, "triples"))(rounded_functionality)


@query("F13_functional_predicates", w(f"SELECT p, functionality FROM ({_FUNCTIONALITY}) WHERE functionality > 0.95", "triples"))
def functional_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_functionality(spark, sf).filter("functionality > 0.95").select("p", "functionality")


@query("A4_top_predicates", w("SELECT p, count(*) AS n FROM triples GROUP BY p ORDER BY n DESC, p LIMIT 5", "triples"))
def top_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_predicates(b.triples(spark, sf), 5)


def _overlap_sql(position: str) -> str:
    return w(
        f"""SELECT a.p AS p1, c.p AS p2, count(*) AS shared
FROM (SELECT DISTINCT p, {position} AS e FROM triples) a JOIN (SELECT DISTINCT p, {position} AS e FROM triples) c ON a.e = c.e AND a.p < c.p GROUP BY a.p, c.p""",
        "triples",
    )


@query("A5_relation_overlap", _overlap_sql("s"))
def relation_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_overlap(b.triples(spark, sf), "s")


@query("A5_relation_overlap_objects", _overlap_sql("o"))
def relation_overlap_objects(spark: SparkSession, sf: str) -> DataFrame:
    return graph.relation_overlap(b.triples(spark, sf), "o")


@query("A6_distinct_entities", w("SELECT s AS id FROM triples UNION SELECT o FROM triples", "triples"))
def distinct_entities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.distinct_entities(b.triples(spark, sf))


@query("A6_distinct_relations", w("SELECT DISTINCT p FROM triples", "triples"))
def distinct_relations(spark: SparkSession, sf: str) -> DataFrame:
    return b.triples(spark, sf).select("p").distinct()


@query(
    "A7_graph_stats",
    w(
        """SELECT (SELECT count(*) FROM triples) AS triples, (SELECT count(DISTINCT p) FROM triples) AS predicates,
(SELECT count(*) FROM (SELECT s FROM triples UNION SELECT o FROM triples)) AS entities, count(label) AS labels, count(description) AS descriptions FROM entities""",
        "triples",
        "entities",
    ),
)
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stats(b.triples(spark, sf), b.entities(spark, sf))


_REGION_SQL = "SELECT t.s AS a, t.o AS b, u.o AS c FROM triples t JOIN triples u ON t.o = u.s WHERE t.p = 'P17' AND u.p = 'P361'"


@query("J1_rule_match", w(_REGION_SQL, "triples"))
def rule_match(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    return rules.match(t, rules.flatten(rules.parse_horn(REGION_RULE).body))


@query(
    "J2_rule_match_limit",
    w(f"SELECT a, b, c FROM ({_REGION_SQL}) JOIN triples h ON h.s = a AND h.p = 'P30' AND h.o = c ORDER BY a, b, c LIMIT 1000", "triples"),
)
def rule_match_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first 1000 bindings, cut after the head has been verified."""
    t = b.triples(spark, sf)
    rule = rules.parse_horn(REGION_RULE)
    return rules.verified(rules.match(t, list(rule.body)), t, rule).orderBy("a", "b", "c").limit(1000)


@query(
    "J3_ordered_match",
    w(
        """SELECT t.s AS o, t.o AS c, u.o AS n, v.o AS r FROM triples t JOIN triples u ON t.o = u.s JOIN triples v ON u.o = v.s
WHERE t.p = 'P98' AND u.p = 'P17' AND v.p = 'P361'""",
        "triples",
    ),
)
def ordered_match(spark: SparkSession, sf: str) -> DataFrame:
    """Three atoms joined in an order chosen from predicate counts, always along shared variables."""
    t = b.triples(spark, sf)
    found = rules.match(t, list(rules.parse_horn(CHAIN_RULE).body), predicate_table(t))
    return found.select("o", "c", "n", "r")


@query(
    "J4_shared_variable",
    w("SELECT t.s AS x, t.o AS n, u.s AS y FROM triples t JOIN triples u ON t.o = u.s WHERE t.p = 'P361' AND u.p = 'P527' AND u.o = t.s", "triples"),
)
def shared_variable(spark: SparkSession, sf: str) -> DataFrame:
    """A cycle: the second atom must agree with both variables of the first."""
    t = b.triples(spark, sf)
    return rules.match(t, [rules.Atom("?x", "P361", "?n"), rules.Atom("?n", "P527", "?x")]).select("x", "n", F.col("n").alias("y"))


@query(
    "J5_head_verified",
    w(f"SELECT a, b, c FROM ({_REGION_SQL}) WHERE EXISTS (SELECT 1 FROM triples h WHERE h.s = a AND h.p = 'P30' AND h.o = c)", "triples"),
)
def head_verified(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    rule = rules.parse_horn(REGION_RULE)
    return rules.verified(rules.match(t, list(rule.body)), t, rule)


@query(
    "J6_rule_violations",
    w(f"SELECT a, b, c FROM ({_REGION_SQL}) WHERE NOT EXISTS (SELECT 1 FROM triples h WHERE h.s = a AND h.p = 'P30' AND h.o = c)", "triples"),
)
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    rule = rules.parse_horn(REGION_RULE)
    return rules.violations(rules.match(t, list(rule.body)), t, rule)


@query(
    "J7_disjunctive_body",
    w("SELECT s AS a, o AS b FROM triples WHERE p = 'P17' UNION SELECT o, s FROM triples WHERE p = 'P527'", "triples"),
)
def disjunctive_body(spark: SparkSession, sf: str) -> DataFrame:
    return rules.evaluate(b.triples(spark, sf), rules.parse_rule(OR_RULE).body).select("a", "b")


@query(
    "J7_negated_body",
    w(f"SELECT a, b, c FROM ({_REGION_SQL}) WHERE NOT EXISTS (SELECT 1 FROM triples h WHERE h.s = a AND h.p = 'P30' AND h.o = c)", "triples"),
)
def negated_body(spark: SparkSession, sf: str) -> DataFrame:
    return rules.evaluate(b.triples(spark, sf), rules.parse_rule(NOT_RULE).body)


def _quality_sql(body: str, head_p: str, on: str, keys: str) -> str:
    return f"""SELECT count(*) AS body, count(h.s) AS support, round(count(h.s) / count(*), 9) AS std_confidence,
round(count(DISTINCT CASE WHEN h.s IS NOT NULL THEN concat({keys}) END) / (SELECT count(*) FROM triples WHERE p = '{head_p}'), 9) AS head_coverage
FROM ({body}) m LEFT JOIN (SELECT s, o FROM triples WHERE p = '{head_p}') h ON {on}"""


@query("rule_quality", w(_quality_sql(_REGION_SQL, "P30", "h.s = a AND h.o = c", "a, '|', c"), "triples"))
def rule_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, REGION_RULE)


def _quality(spark: SparkSession, sf: str, text: str) -> DataFrame:
    q = rules.quality(b.triples(spark, sf), rules.parse_rule(text))
    return q.select("body", "support", F.round("std_confidence", 9).alias("std_confidence"), F.round("head_coverage", 9).alias("head_coverage"))


@query("rule_quality_inverse", w(_quality_sql("SELECT s AS a, o AS b FROM triples WHERE p = 'P361'", "P527", "h.s = b AND h.o = a", "a, '|', b"), "triples"))
def rule_quality_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, INVERSE_RULE)


@query("rule_quality_order", w(_quality_sql("SELECT s AS oo, o AS c FROM triples WHERE p = 'P98'", "P800", "h.s = c AND h.o = oo", "oo, '|', c"), "triples"))
def rule_quality_order(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, ORDER_RULE)


@query(
    "J8_labels",
    w("SELECT t.s, t.o, coalesce(e.label, t.s) AS s_label FROM triples t LEFT JOIN entities e ON e.id = t.s WHERE t.p = 'P98'", "triples", "entities"),
)
def labels(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf).filter("p = 'P98'").select("s", "o")
    return graph.label(t, b.entities(spark, sf), "s", "s_label").select("s", "o", "s_label")


@query(
    "Q8_label_entries",
    w(
        """SELECT t.o AS id, concat(t.o, ': ', coalesce(e.label, '[No label]'), ' | ', coalesce(e.description, '[No description]')) AS entry
FROM triples t LEFT JOIN entities e ON e.id = t.o WHERE t.p = 'P176'""",
        "triples",
        "entities",
    ),
)
def label_entries(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf).filter("p = 'P176'").select(F.col("o").alias("id"))
    return graph.label_entries(t, b.entities(spark, sf), "id").select("id", "entry")


_UP = """up AS (SELECT node, ancestor, min(steps) AS steps FROM (
SELECT s AS node, o AS ancestor, 1 AS steps FROM edge
UNION ALL SELECT a.s, c.o, 2 FROM edge a JOIN edge c ON a.o = c.s
UNION ALL SELECT a.s, d.o, 3 FROM edge a JOIN edge c ON a.o = c.s JOIN edge d ON c.o = d.s) GROUP BY node, ancestor)"""
_EDGES = "edge AS (SELECT s, o FROM triples WHERE p IN ('P98', 'P17', 'P361'))"


def _hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return b.triples(spark, sf).filter(F.col("p").isin("P98", "P17", "P361")).withColumn("p", F.lit("P279"))


@query("J12_ancestors", w(f"WITH {_EDGES}, {_UP} SELECT node, ancestor, steps FROM up", "triples"))
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Orders below customers below nations below regions, read as one hierarchy."""
    return graph.ancestors(_hierarchy(spark, sf), "P279", 3)


@query(
    "J12_compatible_types",
    w(
        f"""WITH {_EDGES}, {_UP}, pairs AS (SELECT c_custkey AS k, concat('Q1', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS a,
concat('Q1', lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')) AS b FROM customer)
SELECT a, b, EXISTS (SELECT 1 FROM up x JOIN up y ON x.ancestor = y.ancestor WHERE x.node = a AND y.node = b AND x.ancestor <> 'Q3000000000') AS compatible FROM pairs""",
        "triples",
    ),
)
def compatible_types(spark: SparkSession, sf: str) -> DataFrame:
    customer = b.table(spark, sf, "customer")
    pairs = customer.select(b.qid(1, "c_custkey").alias("a"), b.qid(1, F.col("c_custkey") + 1).alias("b"))
    return graph.compatible_types(pairs, graph.ancestors(_hierarchy(spark, sf), "P279", 3), ["Q3000000000"])


@query(
    "J13_entity_facts",
    w(f"SELECT m.a AS entity, t.p, t.o FROM (SELECT DISTINCT a FROM ({_REGION_SQL})) m JOIN triples t ON t.s = m.a", "triples"),
)
def entity_facts(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    found = rules.match(t, list(rules.parse_horn(REGION_RULE).body)).select(F.col("a").alias("entity")).distinct()
    return graph.facts_of(found, t).select("entity", "p", "o")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(RULES.items()), "rule_id string, rule string")


_RULE_VALUES = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(RULES.items())) + ") AS t(rule_id, rule)"


@query(
    "R1_rule_atoms",
    f"""SELECT rule_id, i AS pos, ws[3 * i + 1] AS s, ws[3 * i + 2] AS p, ws[3 * i + 3] AS o FROM (
SELECT rule_id, ws, unnest(range(len(ws) // 3)) AS i FROM (SELECT rule_id, regexp_split_to_array(trim(split_part(rule, '=>', 1)), '\\s+') AS ws FROM {_RULE_VALUES}))""",
)
def rule_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return rule_table(spark).select("rule_id", F.posexplode(rules.atoms_of("rule")).alias("pos", "a")).select(
        "rule_id", F.col("pos").cast("long").alias("pos"), "a.s", "a.p", "a.o"
    )


@query(
    "R4_rule_variables",
    f"SELECT rule_id, unnest(list_distinct(regexp_extract_all(rule, '\\?\\w+'))) AS variable FROM {_RULE_VALUES}",
)
def rule_variables(spark: SparkSession, sf: str) -> DataFrame:
    return rule_table(spark).select("rule_id", F.explode(rules.variables_of("rule")).alias("variable"))


INSTANCES_SQL = f"""SELECT a, b, c, concat(a, ' P17 ', b, '  ', b, ' P361 ', c, ' => ', a, ' P30 ', c) AS instance FROM ({_REGION_SQL})
WHERE EXISTS (SELECT 1 FROM triples h WHERE h.s = a AND h.p = 'P30' AND h.o = c)"""


@query("R5_instances", w(f"SELECT '{REGION_RULE}' AS original_rule, instance FROM ({INSTANCES_SQL})", "triples"))
def instances(spark: SparkSession, sf: str) -> DataFrame:
    return region_instances(spark, sf).select("original_rule", "instance")


def region_instances(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf)
    rule = rules.parse_horn(REGION_RULE)
    return rules.instances(rules.verified(rules.match(t, list(rule.body)), t, rule), rule, REGION_RULE)


@query(
    "R6_match_rows",
    w(
        f"""SELECT '{REGION_RULE}' AS original_rule, instance, concat('{{"?a":"', a, '","?b":"', b, '","?c":"', c, '"}}') AS instantiation_mapping,
'KG' AS engine_type FROM ({INSTANCES_SQL})""",
        "triples",
    ),
)
def match_rows(spark: SparkSession, sf: str) -> DataFrame:
    return region_instances(spark, sf).withColumn("engine_type", F.lit("KG"))


@query(
    "W1_atom_ranks",
    w(
        f"""WITH atoms AS (SELECT rule_id, i AS pos, ws[3 * i + 2] AS p FROM (
SELECT rule_id, ws, unnest(range(len(ws) // 3)) AS i FROM (SELECT rule_id, regexp_split_to_array(trim(split_part(rule, '=>', 1)), '\\s+') AS ws FROM {_RULE_VALUES}))),
n AS (SELECT p, count(*) AS n FROM triples GROUP BY p)
SELECT rule_id, pos, p, coalesce(n, 0) AS estimate, row_number() OVER (PARTITION BY rule_id ORDER BY coalesce(n, 0), pos) AS rank FROM atoms LEFT JOIN n USING (p)""",
        "triples",
    ),
)
def atom_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of each rule by the size of their predicate, their place in the rule kept."""
    from pyspark.sql import Window

    atoms = rule_atoms(spark, sf).select("rule_id", "pos", "p")
    counted = atoms.join(graph.predicate_counts(b.triples(spark, sf)), "p", "left").select("rule_id", "pos", "p", F.coalesce("n", F.lit(0).cast("long")).alias("estimate"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("rule_id").orderBy("estimate", "pos")))


@query(
    "C8_rule_features",
    f"""WITH x AS (SELECT rule_id, rule, regexp_split_to_array(trim(split_part(rule, '=>', 1)), '\\s+') AS body,
regexp_split_to_array(trim(split_part(rule, '=>', 2)), '\\s+') AS head, regexp_extract_all(rule, '\\?\\w+') AS vars, regexp_extract_all(rule, '\\bP\\d+\\b') AS preds FROM {_RULE_VALUES})
SELECT rule_id, len(body) // 3 AS body_atom_count, len(head) // 3 AS head_atom_count, len(body) // 3 + len(head) // 3 AS total_atom_count,
len(list_distinct(vars)) AS unique_variable_count, len(list_distinct(preds)) AS unique_predicate_count,
list_max([len([y FOR y IN vars IF y = v]) FOR v IN list_distinct(vars)]) AS max_variable_reuse FROM x""",
)
def rule_features(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.functions import text

    return rule_table(spark).select("rule_id", *[c.cast("long").alias(n) for n, c in text.rule_features("rule").items()])


@query(
    "C9_rule_patterns",
    "SELECT * FROM (VALUES ('chain', '?V1  P98  ?V2  ?V2  P17  ?V3  ?V3  P361  ?V4   => ?V1  P30  ?V4'), ('inverse', '?V1  P361  ?V2   => ?V2  P527  ?V1'), "
    "('order', '?V1  P98  ?V2   => ?V2  P800  ?V1'), ('region', '?V1  P17  ?V2  ?V2  P361  ?V3   => ?V1  P30  ?V3')) AS t(rule_id, pattern)",
)
def rule_patterns(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.functions import text

    return rule_table(spark).select("rule_id", text.rule_pattern("rule").alias("pattern"))
