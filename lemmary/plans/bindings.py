"""The driver's tables read as the tables of the consistency pipeline.

Each function returns a lazy projection, so filters and pruned columns reach the
Parquet scans. ``VIEWS`` says the same in SQL for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of entity by the digit after Q.
CUSTOMER, NATION, REGION, SUPPLIER, ORDER, PART = 1, 2, 3, 4, 5, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qid(kind: int, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"Q{kind}"), F.lpad(key.cast("string"), 9, "0"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o) with set semantics.

    Only the two relations drawn from line items can repeat, so only they are
    made distinct; the others come from tables with unique keys. The predicate
    is a literal in each branch: a filter on it removes whole scans.
    """
    t = lambda name: table(spark, sf_dir, name)
    fact = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    customer, nation, orders, item = t("customer"), t("nation"), t("orders"), t("lineitem")
    by_customer = customer.filter("c_custkey % 3 <> 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        fact(customer, qid(1, "c_custkey"), "P17", qid(2, "c_nationkey")),
        fact(t("supplier"), qid(4, "s_suppkey"), "P17", qid(2, "s_nationkey")),
        fact(nation, qid(2, "n_nationkey"), "P361", qid(3, "n_regionkey")),
        fact(nation.filter("n_nationkey % 5 <> 0"), qid(3, "n_regionkey"), "P527", qid(2, "n_nationkey")),
        fact(orders, qid(5, "o_orderkey"), "P98", qid(1, "o_custkey")),
        fact(orders.filter("o_orderkey % 4 <> 0"), qid(1, "o_custkey"), "P800", qid(5, "o_orderkey")),
        fact(item.select("l_orderkey", "l_suppkey").distinct(), qid(5, "l_orderkey"), "P176", qid(4, "l_suppkey")),
        fact(item.select("l_orderkey", "l_partkey").distinct(), qid(5, "l_orderkey"), "P527", qid(6, "l_partkey")),
        fact(by_customer, qid(1, "c_custkey"), "P30", qid(3, "n_regionkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, description)."""
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, i, label, d: df.select(i.alias("id"), F.col(label).alias("label"), d.alias("description"))
    parts = [
        row(t("customer"), qid(1, "c_custkey"), "c_name", F.col("c_mktsegment")),
        row(t("supplier"), qid(4, "s_suppkey"), "s_name", F.lit(None).cast("string")),
        row(t("nation"), qid(2, "n_nationkey"), "n_name", F.lit("nation")),
        row(t("region"), qid(3, "r_regionkey"), "r_name", F.lit("region")),
        row(t("part"), qid(6, "p_partkey"), "p_name", F.col("p_type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for each line item."""
    t = lambda name: table(spark, sf_dir, name)
    mutation = F.array(F.lit("body_augmentation"), F.lit("body_permutation"), F.lit("entity_rename"))
    qtype = F.array(F.lit("yes_no"), F.lit("true_false"), F.lit("wh_question"), F.lit("multiple_choice"))
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        t("customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.concat(F.lit("kg_rule_"), F.col("c_nationkey").cast("string")).alias("rule"),
        F.get(mutation, F.col("l_linenumber") % 3).alias("mutation_type"),
        F.get(qtype, (F.col("l_orderkey") % 4).cast("int")).alias("qtype"),
        (F.col("l_returnflag") != "R").alias("answers_consistent"),
        (F.col("l_quantity") / 10).alias("contradiction_score"),
        (F.col("l_extendedprice") / 10000).alias("entailment_score"),
        (F.col("l_discount") * 50).alias("neutral_score"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the next one as its mutated answer; the verdict is null without a label."""
    docs = table(spark, sf_dir, "documents")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("mutated_llm_answer"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(following, "doc_id").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_index"), F.col("source").alias("kg_rule"), F.col("lang").alias("mutation_type"),
        F.col("text").alias("original_llm_answer"), "mutated_llm_answer", (F.col("quality") == 1).alias("answers_consistent"),
    )


def _q(kind: int, key: str) -> str:
    return f"concat('Q{kind}', lpad(CAST({key} AS VARCHAR), 9, '0'))"


VIEWS = {
    "triples": f"""
SELECT {_q(1, "c_custkey")} AS s, 'P17' AS p, {_q(2, "c_nationkey")} AS o FROM customer
UNION SELECT {_q(4, "s_suppkey")}, 'P17', {_q(2, "s_nationkey")} FROM supplier
UNION SELECT {_q(2, "n_nationkey")}, 'P361', {_q(3, "n_regionkey")} FROM nation
UNION SELECT {_q(3, "n_regionkey")}, 'P527', {_q(2, "n_nationkey")} FROM nation WHERE n_nationkey % 5 <> 0
UNION SELECT {_q(5, "o_orderkey")}, 'P98', {_q(1, "o_custkey")} FROM orders
UNION SELECT {_q(1, "o_custkey")}, 'P800', {_q(5, "o_orderkey")} FROM orders WHERE o_orderkey % 4 <> 0
UNION SELECT {_q(5, "l_orderkey")}, 'P176', {_q(4, "l_suppkey")} FROM lineitem
UNION SELECT {_q(5, "l_orderkey")}, 'P527', {_q(6, "l_partkey")} FROM lineitem
UNION SELECT {_q(1, "c_custkey")}, 'P30', {_q(3, "n_regionkey")} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0
""",
    "entities": f"""
SELECT {_q(1, "c_custkey")} AS id, c_name AS label, c_mktsegment AS description FROM customer
UNION ALL SELECT {_q(4, "s_suppkey")}, s_name, NULL FROM supplier
UNION ALL SELECT {_q(2, "n_nationkey")}, n_name, 'nation' FROM nation
UNION ALL SELECT {_q(3, "r_regionkey")}, r_name, 'region' FROM region
UNION ALL SELECT {_q(6, "p_partkey")}, p_name, p_type FROM part
""",
    "consistency": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat('kg_rule_', CAST(c_nationkey AS VARCHAR)) AS rule,
       CASE l_linenumber % 3 WHEN 0 THEN 'body_augmentation' WHEN 1 THEN 'body_permutation' ELSE 'entity_rename' END AS mutation_type,
       CASE l_orderkey % 4 WHEN 0 THEN 'yes_no' WHEN 1 THEN 'true_false' WHEN 2 THEN 'wh_question' ELSE 'multiple_choice' END AS qtype,
       l_returnflag <> 'R' AS answers_consistent, l_quantity / 10 AS contradiction_score,
       l_extendedprice / 10000 AS entailment_score, l_discount * 50 AS neutral_score,
       o_orderpriority AS priority, c_mktsegment AS segment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""",
    "qa_pairs": """
SELECT d.doc_id AS row_index, d.source AS kg_rule, d.lang AS mutation_type, d.text AS original_llm_answer,
       e.text AS mutated_llm_answer, l.quality = 1 AS answers_consistent
FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
}


def with_views(sql: str, *names: str) -> str:
    """The statement after common table expressions for the named views."""
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {head},\n{sql[5:]}"
    return f"WITH {head}\n{sql}"
