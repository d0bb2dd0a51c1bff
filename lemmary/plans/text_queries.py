"""Queries that apply the text, vector and source functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions import grammar, text, vectors
from lemmary.operators import stats
from lemmary.plans import bindings as b
from lemmary.plans.bindings import with_views as w
from lemmary.plans.registry import query

#: Texts of answers, dealt over the orders so that every branch of a function occurs.
PHRASES = [
    "Yes, that is correct.", "No, this is not true.", "North gate", "that is incorrect", "ERROR: timeout", "", "nan", "The capital of France is Paris.",
    "Paris", "A. Paris is the capital", "Option B: the second river", "**C.** Marshal of the branch", "true", "False.", "Not sure about this", "unsure",
    "It is the case that Bob is a child of Alice.", "The bridge is located in the north.\n\nIs it old?", "1. first item\n2) second item\n- third item",
    '{"label": "Contradiction", "confidence": 0.8}', 'Here: {"relation": "same", "score": "1.5"} done', '{"verdict": 3}', "Given that A is B, is it true that C is D?",
    "Conclusion: **Yes**, the town  is part of the region.",
]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """(k, a, c): two texts for each order."""
    table = F.array(*[F.lit(p) for p in PHRASES])
    n = len(PHRASES)
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select("k", F.get(table, (F.col("k") % n).cast("int")).alias("a"), F.get(table, ((F.col("k") * 7 + F.expr("k DIV 24") + 3) % n).cast("int")).alias("c"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


b.VIEWS["answers"] = f"SELECT o_orderkey AS k, ({_list(PHRASES)})[o_orderkey % 24 + 1] AS a, ({_list(PHRASES)})[(o_orderkey * 7 + o_orderkey // 24 + 3) % 24 + 1] AS c FROM orders"

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda v: v <> '')"


def _s(x: str) -> str:
    return _STRIP.format(x=x)


def _w(x: str) -> str:
    return _WORDS.format(x=x)


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {_lit(p)})" for p in parts) + ")"


def _starts(x: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {_lit(p)})" for p in parts) + ")"


# ---- filters

_RATES = "(SELECT p_partkey AS rule_id, p_size / 50.0 AS pca, (p_partkey % 100) / 100.0 AS std, (p_partkey % 37) / 100.0 AS coverage, p_partkey % 200 AS positives FROM part)"


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    p = b.table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("rule_id"), (F.col("p_size") / 50).alias("pca"), ((k % 100) / 100).alias("std"), ((k % 37) / 100).alias("coverage"), (k % 200).alias("positives"))


@query("F1_rule_quality_filter", f"SELECT rule_id, round(pca, 6) AS pca, round(std, 6) AS std FROM {_RATES} WHERE coverage >= 0.05 AND std >= 0.5 AND pca >= 0.9 AND positives >= 10")
def rule_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = _rates(spark, sf).filter("coverage >= 0.05 AND std >= 0.5 AND pca >= 0.9 AND positives >= 10")
    return r.select("rule_id", F.round("pca", 6).alias("pca"), F.round("std", 6).alias("std"))


@query("F2_threshold_funnel", f"SELECT count(*) AS total, count_if(coverage >= 0.05) AS by_coverage, count_if(std >= 0.5) AS by_std, count_if(pca >= 0.9) AS by_pca, count_if(positives >= 10) AS by_positives, round(100.0 * count_if(pca >= 0.9) / count(*), 6) AS pca_pct FROM {_RATES}")
def threshold_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Every threshold counted on its own, in one pass."""
    c = lambda e: stats.count_if(F.expr(e))
    return _rates(spark, sf).agg(
        F.count(F.lit(1)).alias("total"), c("coverage >= 0.05").alias("by_coverage"), c("std >= 0.5").alias("by_std"), c("pca >= 0.9").alias("by_pca"),
        c("positives >= 10").alias("by_positives"), F.round(100 * c("pca >= 0.9") / F.count(F.lit(1)), 6).alias("pca_pct"),
    )


_JUDGED = "(SELECT k, CASE WHEN k % 5 = 0 THEN a WHEN k % 5 = 1 THEN concat('Validity judgment: Yes', chr(10), 'Reason: ', a) WHEN k % 5 = 2 THEN concat('Validity judgment:  n ', chr(10)) ELSE concat('Reason: x', chr(10), 'Validity judgment: ', a) END AS t FROM answers)"
_JUDGEMENT = "CASE WHEN starts_with(t, 'ERROR:') THEN 'E' WHEN v IN ('Y', 'YES', '是', '合理', 'VALID') THEN 'Y' WHEN v IN ('N', 'NO', '否', '不合理', 'INVALID') THEN 'N' ELSE 'U' END"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("k") % 5
    t = (
        F.when(m == 0, F.col("a")).when(m == 1, F.concat(F.lit("Validity judgment: Yes\nReason: "), "a"))
        .when(m == 2, F.lit("Validity judgment:  n \n")).otherwise(F.concat(F.lit("Reason: x\nValidity judgment: "), "a"))
    )
    return answers(spark, sf).select("k", text.judgement(t).alias("verdict"))


_VERDICTS = f"(SELECT k, {_JUDGEMENT} AS verdict FROM (SELECT k, t, upper(trim(regexp_extract(concat(chr(10), t), '\\nValidity judgment:([^\\n]*)', 1))) AS v FROM {_JUDGED}))"


@query("C30_judgement", w(f"SELECT k, verdict FROM {_VERDICTS}", "answers"))
def judgement(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)


@query("F3_verdict_filter", w(f"SELECT k FROM {_VERDICTS} WHERE verdict = 'Y'", "answers"))
def verdict_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).filter("verdict = 'Y'").select("k")


_MUTANTS = "(SELECT k, CASE WHEN k % 4 = 0 THEN concat('?a P17 ', a) WHEN k % 4 = 1 THEN '?x P1 ?y' WHEN k % 4 = 2 THEN '' ELSE concat('Q', k, ' P17 Q2') END AS m, CASE WHEN k % 3 = 0 THEN concat('Q', k, ' P17 Q2') ELSE a END AS o FROM answers)"


def _mutants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    own = F.concat(F.lit("Q"), k.cast("string"), F.lit(" P17 Q2"))
    m = F.when(k % 4 == 0, F.concat(F.lit("?a P17 "), "a")).when(k % 4 == 1, F.lit("?x P1 ?y")).when(k % 4 == 2, F.lit("")).otherwise(own)
    return answers(spark, sf).select("k", m.alias("m"), F.when(k % 3 == 0, own).otherwise(F.col("a")).alias("o"))


@query("F5_template_rows", w(f"SELECT k, regexp_matches(m, '\\?[a-zA-Z0-9_]+') AS template FROM {_MUTANTS}", "answers"))
def template_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _mutants(spark, sf).select("k", F.col("m").rlike(r"\?[a-zA-Z0-9_]+").alias("template"))


@query("F6_row_validation", w(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {_s('m')} = '' THEN 'empty' WHEN regexp_matches(m, '\\?[a-zA-Z0-9_]+') THEN 'template' WHEN m = o THEN 'same as original' ELSE 'valid' END AS reason FROM {_MUTANTS}) GROUP BY reason", "answers"))
def row_validation(spark: SparkSession, sf: str) -> DataFrame:
    reason = (
        F.when(text.strip("m") == "", F.lit("empty")).when(F.col("m").rlike(r"\?[a-zA-Z0-9_]+"), F.lit("template"))
        .when(F.col("m") == F.col("o"), F.lit("same as original")).otherwise(F.lit("valid"))
    )
    return _mutants(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rule_range(expression: str, rule: str = "rule"):
    """A predicate for "1-63,70": ranges over the number in kg_rule_N, which prunes partitions when N is one."""
    number = F.regexp_extract(F.col(rule), r"kg_rule_(\d+)", 1).cast("int")
    out = F.lit(False)
    for part in expression.split(","):
        low, _, high = part.strip().partition("-")
        out = out | number.between(int(low), int(high or low))
    return out


@query("F8_rule_range", w("SELECT rule, count(*) AS n FROM consistency WHERE CAST(regexp_extract(rule, 'kg_rule_(\\d+)', 1) AS INT) BETWEEN 1 AND 5 OR rule = 'kg_rule_20' GROUP BY rule", "consistency"))
def rule_range_rows(spark: SparkSession, sf: str) -> DataFrame:
    return b.consistency(spark, sf).filter(rule_range("1-5, 20")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_PRESENT = f"({_s('{x}')} <> '' AND {_s('{x}')} NOT IN ('nan', 'None'))"


@query("F9_non_empty_answers", w(f"SELECT k FROM answers WHERE {_PRESENT.format(x='a')} AND {_PRESENT.format(x='c')}", "answers"))
def non_empty_answers(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).filter(text.present("a").isNotNull() & text.present("c").isNotNull()).select("k")


@query("F10_reusable_answers", w(f"SELECT k FROM answers WHERE {_PRESENT.format(x='a')} AND {_PRESENT.format(x='c')} AND NOT starts_with(a, 'ERROR:') AND NOT starts_with(c, 'ERROR:')", "answers"))
def reusable_answers(spark: SparkSession, sf: str) -> DataFrame:
    ok = text.present("a").isNotNull() & text.present("c").isNotNull() & ~text.is_error("a") & ~text.is_error("c")
    return answers(spark, sf).filter(ok).select("k")


@query("F11_inconsistent_rows", w("SELECT row_index FROM qa_pairs WHERE NOT answers_consistent AND length(original_llm_answer) >= 3 AND length(mutated_llm_answer) >= 3", "qa_pairs"))
def inconsistent_rows(spark: SparkSession, sf: str) -> DataFrame:
    q = b.qa_pairs(spark, sf)
    return q.filter(~F.col("answers_consistent") & (F.length("original_llm_answer") >= 3) & (F.length("mutated_llm_answer") >= 3)).select("row_index")


@query("F16_transitive_filter", "SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, p_brand, contains(lower(p_type), 'steel') AS t, max(CASE WHEN contains(lower(p_type), 'steel') THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand) AS other FROM part) WHERE NOT t OR other = 0")
def transitive_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a kind go, unless a group has no other."""
    marked = b.table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", F.contains(F.lower("p_type"), F.lit("steel")).alias("t"))
    others = marked.filter("NOT t").select("p_brand").distinct().withColumn("some", F.lit(True))
    kept = marked.join(others, "p_brand", "left").filter(~F.col("t") | F.col("some").isNull())
    return kept.select("p_partkey", "p_type")


# ---- joins

@query(
    "J9_question_probe",
    f"SELECT d.doc_id, p.idx FROM documents d JOIN (SELECT {_s('regexp_replace(text, $$\\s+$$, $$ $$, $$g$$)')} AS q, max(doc_id) AS idx FROM documents GROUP BY 1) p ON {_s('regexp_replace(d.text, $$\\s+$$, $$ $$, $$g$$)')} = p.q",
)
def question_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Texts probe an index by their white-space form; the last of equal texts wins. The key is a digest, the texts are compared."""
    q = F.trim(F.regexp_replace("text", r"\s+", " "))
    docs = b.table(spark, sf, "documents").select("doc_id", q.alias("q"))
    keyed = docs.withColumn("h", F.sha2(F.col("q").cast("binary"), 256)).drop("q")
    index = keyed.groupBy("h").agg(F.max("doc_id").alias("idx"))
    return keyed.join(index, "h").select("doc_id", "idx")


@query(
    "J10_zip_shorter",
    "SELECT x.k, x.i AS pos, x.v AS item, y.v AS answer FROM (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey AS v FROM lineitem WHERE l_returnflag <> 'A') x JOIN (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_suppkey AS v FROM lineitem WHERE l_linestatus = 'F') y ON x.k = y.k AND x.i = y.i",
)
def zip_shorter(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of a row by position, cut to the shorter one."""
    item = b.table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = item.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "A", order))).alias("x"), F.sort_array(F.collect_list(F.when(F.col("l_linestatus") == "F", order))).alias("y")
    )
    z = F.arrays_zip(F.col("x.l_partkey").alias("item"), F.col("y.l_suppkey").alias("answer"))
    return g.select("k", F.posexplode(F.slice(z, F.lit(1), F.least(F.size("x"), F.size("y")))).alias("pos", "z")).select("k", "pos", "z.item", "z.answer")


@query(
    "J14_same_domain_neighbours",
    w("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rule, count(*) OVER (PARTITION BY rule) - 1 AS neighbours FROM consistency WHERE qtype <> 'multiple_choice'", "consistency"),
)
def same_domain_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The other rows with each row's rule, multiple choice left out, as membership: rows of one rule are all neighbours of each other.

    A row's neighbours are the rows that name its rule, but for itself; pairs would grow with the square of a rule.
    """
    c = b.consistency(spark, sf).filter("qtype <> 'multiple_choice'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rule")
    sizes = c.groupBy("rule").agg((F.count(F.lit(1)) - 1).alias("neighbours"))
    return c.join(sizes, "rule")


@query("J15_annotators", "SELECT x.o_orderkey AS item, x.o_orderstatus AS first, y.o_orderpriority AS second FROM orders x JOIN orders y ON x.o_orderkey = y.o_orderkey")
def annotators(spark: SparkSession, sf: str) -> DataFrame:
    o = b.table(spark, sf, "orders")
    x = o.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("first"))
    return x.join(o.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("second")), "item")


# ---- text

_LABELS = "(SELECT id, CASE WHEN hash_n % 4 = 0 THEN concat('category: ', lower(label), ' of THE world') WHEN hash_n % 4 = 1 THEN concat(label, ' and covid-19 in spain') WHEN hash_n % 4 = 2 THEN 'COVID-19' ELSE lower(label) END AS label FROM (SELECT id, label, CAST(substr(id, 3) AS BIGINT) AS hash_n FROM entities))"


@query(
    "C1_standard_labels",
    w(
        f"""SELECT id, CASE WHEN starts_with(label, 'category:') THEN concat('Category:', t) WHEN label = 'COVID-19' THEN label ELSE t END AS label FROM (
SELECT id, label, array_to_string(list_transform(ws, lambda v, i: CASE WHEN lower(v) = 'covid-19' AND len(ws) > 1 THEN 'COVID-19' WHEN i > 1 AND list_contains({_list(text.SMALL_WORDS)}, lower(v)) THEN lower(v) ELSE concat(upper(substr(v, 1, 1)), lower(substr(v, 2))) END), ' ') AS t
FROM (SELECT id, label, {_w("regexp_replace(label, '^category:', '')")} AS ws FROM {_LABELS}))""",
        "entities",
    ),
)
def standard_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substr("id", F.lit(3)).cast("long") % 4
    e = b.entities(spark, sf)
    label = (
        F.when(n == 0, F.concat(F.lit("category: "), F.lower("label"), F.lit(" of THE world"))).when(n == 1, F.concat("label", F.lit(" and covid-19 in spain")))
        .when(n == 2, F.lit("COVID-19")).otherwise(F.lower("label"))
    )
    return e.select("id", text.standard_label(label).alias("label"))


@query("C2_entry_labels", w("SELECT id, trim(label) AS label FROM entities WHERE length(trim(label)) >= 2", "entities"))
def entry_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = b.entities(spark, sf)
    entry = F.to_json(F.array(F.concat_ws(": ", "id", F.concat("label", F.lit(" | "), F.coalesce("description", F.lit("none")))), F.lit("no colon")))
    return e.select("id", F.explode(text.entry_labels(entry, 2)).alias("label"))


_DIFF = f"list_sort(list_filter(list_distinct(regexp_extract_all(c, '[A-Za-z][A-Za-z0-9_]*')), lambda t: NOT list_contains(regexp_extract_all(a, '[A-Za-z][A-Za-z0-9_]*'), t) AND length(t) >= 2 AND NOT list_contains({_list(text.DIFF_STOP)}, lower(t))))"


@query("C3_placeholders", w(f"SELECT k, array_to_string({_DIFF}, ' ') AS placeholders FROM answers", "answers"))
def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", F.array_join(text.placeholders("a", "c", text.DIFF_STOP), " ").alias("placeholders"))


@query("C4_unified_entities", w("SELECT k, replace(replace(replace(concat(regexp_replace(a, 'Object', 'Object', 'g'), ' near ENT'), 'the region', 'ENT'), 'Paris', 'ENT'), 'Bob', 'ENT') AS t FROM answers", "answers"))
def unified_entities(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("a", F.lit(" near Object12"))
    surfaces = F.array(F.lit("Bob"), F.lit("Paris"), F.lit("the region"))
    return answers(spark, sf).select("k", text.unify_entities(t, surfaces, text.PLACEHOLDER).alias("t"))


_OPTION = "^\\s*\\**\\s*(?:[oO][pP][tT][iI][oO][nN]\\s+)?[A-Da-d]\\s*[.):\\-](?:\\*+\\s*|\\s+)"


@query("C5_strip_option", w(f"SELECT k, regexp_replace(regexp_replace(a, '{_OPTION}', ''), '{_OPTION}', '') AS t FROM answers", "answers"))
def strip_option(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.strip_option("a").alias("t"))


@query("C6_mutation_of_name", w("SELECT DISTINCT mutation_type, mutation_type AS found FROM consistency", "consistency"))
def mutation_of_name(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("out/"), "rule", F.lit("/"), F.upper("mutation_type"), F.lit("_llm_answers.csv"))
    return b.consistency(spark, sf).select("mutation_type", text.mutation_of_name(path).alias("found")).distinct()


@query("C7_rename_map", w("SELECT k, CASE WHEN k % 24 = 7 THEN 'Person1=France;Town1=Paris' ELSE '' END AS renamed FROM answers", "answers"))
def rename_map(spark: SparkSession, sf: str) -> DataFrame:
    """New words of the changed text paired by position with the labels that it lost."""
    changed = F.replace(F.replace(F.col("a"), F.lit("Paris"), F.lit("Town1")), F.lit("France"), F.lit("Person1"))
    m = text.rename_map("a", changed, F.array(F.lit("France"), F.lit("Paris")), text.DIFF_STOP)
    shown = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return answers(spark, sf).select("k", F.when(F.contains("a", F.lit("France")), shown).otherwise(F.lit("")).alias("renamed"))


@query("C10_entity_features", w("SELECT id, 2 AS entity_count, CAST(length(trim(label)) AS DOUBLE) AS avg_label_length, CAST(len(" + _w("label") + ") AS DOUBLE) AS avg_word_count, regexp_matches(label, '[-/_&]') AS has_special_chars, regexp_matches(label, '[0-9]') AS has_numbers FROM entities", "entities"))
def entity_features(spark: SparkSession, sf: str) -> DataFrame:
    e = b.entities(spark, sf)
    parts = text.entity_features(F.to_json(F.create_map(F.lit("?a"), F.col("id"), F.lit("?b"), F.lit("Q1"))), F.concat(F.col("id"), F.lit(" P17 Q1")), F.to_json(F.array(F.concat("id", F.lit(": "), "label", F.lit(" | x")))))
    return e.select("id", *[c.alias(n) for n, c in parts.items()])


@query("C11_question_types", w("SELECT qtype, CASE WHEN qtype IN ('yes_no', 'true_false') THEN 'yes_no' ELSE qtype END AS kind, count(*) AS n FROM consistency GROUP BY 1, 2", "consistency"))
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    return b.consistency(spark, sf).groupBy("qtype", text.question_type("qtype").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("C12_answer_complexity", w(f"SELECT row_index, length(t) AS chars, n AS words, s AS sentences, CAST((length(t) - length(replace(t, chr(10) || chr(10), ''))) / 2 + 1 AS INT) AS paragraphs, round(n / s, 6) AS per_sentence FROM (SELECT row_index, original_llm_answer AS t, len({_w('original_llm_answer')}) AS n, greatest(1, length(original_llm_answer) - length(replace(replace(original_llm_answer, '.', ''), '?', ''))) AS s FROM qa_pairs)", "qa_pairs"))
def answer_complexity(spark: SparkSession, sf: str) -> DataFrame:
    p = text.answer_complexity("original_llm_answer")
    return b.qa_pairs(spark, sf).select(
        "row_index", p["answer_length_chars"].alias("chars"), p["answer_length_words"].alias("words"), p["answer_num_sentences"].alias("sentences"),
        p["answer_num_paragraphs"].alias("paragraphs"), F.round(p["answer_avg_sentence_length"], 6).alias("per_sentence"),
    )


def _sentiment(x: str) -> str:
    low = f"lower({_s(x)})"
    first = f"list_slice({_w(low)}, 1, 10)"
    joined = f"array_to_string({first}, ' ')"
    return f"""CASE WHEN {_starts(low, text.YES_STARTS)} THEN 'yes' WHEN {_starts(low, text.NO_STARTS)} THEN 'no' WHEN {_any(joined, ["yes", "true", "correct", "right"])} THEN 'yes'
WHEN list_contains({first}, 'no') OR {_any(joined, ["not ", "false", "wrong"])} THEN 'no' END"""


@query("C13_same_yes_no", w(f"SELECT k, x AS sentiment, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x = y WHEN x IS NOT NULL OR y IS NOT NULL THEN false ELSE lower({_s('a')}) = lower({_s('c')}) END AS same FROM (SELECT *, {_sentiment('a')} AS x, {_sentiment('c')} AS y FROM answers)", "answers"))
def same_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.sentiment("a").alias("sentiment"), text.same_yes_no("a", "c").alias("same"))


def _terms(x: str) -> str:
    return "list_distinct(" + _w(f"regexp_replace({x}, '[^A-Za-z0-9_\\s]', '', 'g')") + ")"


def _keys(x: str) -> str:
    return f"list_distinct(list_filter({_w(x)}, lambda v: length(v) > 2 AND NOT list_contains({_list(text.STOP_WORDS)}, v)))"


@query(
    "C13_same_answer",
    w(
        f"""SELECT k, CASE WHEN x = y THEN true WHEN len(s) > 0 AND len(list_intersect(s, l)) >= len(s) * 0.8 THEN true WHEN len(p) = 0 OR len(q) = 0 THEN false
WHEN len(list_intersect(p, q)) / len(list_distinct(list_concat(p, q))) >= 0.5 THEN true ELSE len(list_intersect(p, q)) >= len(p) * 0.6 END AS same FROM (
SELECT k, x, y, {_terms("CASE WHEN length(x) <= length(y) THEN x ELSE y END")} AS s, {_terms("CASE WHEN length(x) <= length(y) THEN y ELSE x END")} AS l, {_keys("x")} AS p, {_keys("y")} AS q FROM (
SELECT k, lower({_s("a")}) AS x, lower({_s("c")}) AS y FROM answers))""",
        "answers",
    ),
)
def same_answer(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.same_answer("a", "c").alias("same"))


_CONTENT = "list_filter(list_distinct(" + _WORDS + f"), lambda v: NOT list_contains({_list(text.OVERLAP_STOP_WORDS)}, v))"


@query(
    "C14_expected_answer",
    w(
        f"""SELECT k, m AS method, CASE m WHEN 'bigram_overlap' THEN sim >= 0.48 WHEN 'missing_answer' THEN false ELSE true END AS consistent, round(CASE m WHEN 'bigram_overlap' THEN sim WHEN 'missing_answer' THEN 0.0 WHEN 'word_overlap' THEN j WHEN 'subset_match' THEN 0.8 ELSE 1.0 END, 6) AS similarity FROM (
SELECT k, sim, j, CASE WHEN a = '' OR e = '' THEN 'missing_answer' WHEN contains(a, e) OR contains(e, a) THEN 'exact_match' WHEN len(y) > 0 AND j >= 0.6 THEN 'word_overlap' WHEN len(y) > 0 AND len(list_intersect(x, y)) = len(y) THEN 'subset_match' ELSE 'bigram_overlap' END AS m FROM (
SELECT *, len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0) AS j, CASE WHEN len(p) > 0 AND len(q) > 0 THEN len(list_intersect(p, q)) / least(len(p), len(q)) ELSE 0.0 END AS sim FROM (
SELECT k, a, e, {_CONTENT.format(x="a")} AS x, {_CONTENT.format(x="e")} AS y, list_distinct(list_transform(range(1, length(e)), lambda i: substr(e, i, 2))) AS p, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS q
FROM (SELECT k, lower({_s("a")}) AS a, lower({_s("c")}) AS e FROM answers))))""",
        "answers",
    ),
)
def expected_answer(spark: SparkSession, sf: str) -> DataFrame:
    v = text.expected_answer("a", "c")
    return answers(spark, sf).select("k", v["method"].alias("method"), v["consistent"].alias("consistent"), F.round(v["similarity"], 6).alias("similarity"))


@query(
    "C14_expected_yes_no",
    w(
        f"""SELECT k, CASE WHEN a = '' THEN false WHEN k % 2 = 0 THEN CASE WHEN {_starts("a", ["yes", '"yes', "'yes", "correct. ", "true. ", "indeed. "])} THEN true WHEN {_starts("a", ["no", "false", "incorrect"])} THEN false ELSE {_any("a", ["yes", "indeed", "correct. ", "true. "])} END
ELSE CASE WHEN {_starts("a", ["no", '"no', "'no", "false. ", "incorrect. "])} THEN true WHEN {_starts("a", ["yes", "true", "correct"])} THEN false ELSE {_any("a", ["no", "not ", "false", "incorrect"])} END END AS consistent FROM (SELECT k, lower({_s("a")}) AS a FROM answers)""",
        "answers",
    ),
)
def expected_yes_no(spark: SparkSession, sf: str) -> DataFrame:
    e = F.when(F.col("k") % 2 == 0, F.lit("yes")).otherwise(F.lit("no"))
    return answers(spark, sf).select("k", text.expected_answer("a", e)["consistent"].alias("consistent"))


@query(
    "C16_rouge_1",
    w(
        f"""WITH x AS (SELECT row_index, lower(v) AS v, count(*) AS n FROM (SELECT row_index, unnest({_w("original_llm_answer")}) AS v FROM qa_pairs) GROUP BY 1, 2),
y AS (SELECT row_index, lower(v) AS v, count(*) AS m FROM (SELECT row_index, unnest({_w("mutated_llm_answer")}) AS v FROM qa_pairs) GROUP BY 1, 2),
a AS (SELECT row_index, sum(n) AS n FROM x GROUP BY 1), c AS (SELECT row_index, sum(m) AS m FROM y GROUP BY 1), o AS (SELECT x.row_index, sum(least(n, m)) AS k FROM x JOIN y ON x.row_index = y.row_index AND x.v = y.v GROUP BY 1)
SELECT a.row_index, round(coalesce(k, 0) / m, 6) AS precision, round(coalesce(k, 0) / n, 6) AS recall FROM a JOIN c USING (row_index) LEFT JOIN o USING (row_index)""",
        "qa_pairs",
    ),
)
def rouge_1(spark: SparkSession, sf: str) -> DataFrame:
    """Shared words as multisets over the words of each text.

    Rows are dealt by their index once, before words are made: both groupings find their rows in place.
    """
    q = b.qa_pairs(spark, sf).select("row_index", "original_llm_answer", "mutated_llm_answer").repartition("row_index")
    side = lambda c, first: F.transform(text.words(c), lambda v: F.struct(F.lower(v).alias("v"), F.lit(first).alias("first")))
    each = q.select("row_index", F.explode(F.concat(side("original_llm_answer", True), side("mutated_llm_answer", False))).alias("w"))
    both = each.groupBy("row_index", F.col("w.v").alias("v")).agg(F.count_if("w.first").alias("n"), F.count_if(~F.col("w.first")).alias("m"))
    g = both.groupBy("row_index").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.least("n", "m")).alias("k"))
    return g.filter("n > 0 AND m > 0").select("row_index", F.round(F.col("k") / F.col("m"), 6).alias("precision"), F.round(F.col("k") / F.col("n"), 6).alias("recall"))


@query("C17_numbered_items", w(f"SELECT k, item FROM (SELECT k, unnest(list_transform(string_split(a, chr(10)), lambda v: {_s('regexp_replace(regexp_replace(' + _s('v') + ', $$^\\d+[.):\\-]\\s*$$, $$$$), $$^- $$, $$$$)')})) AS item FROM answers) WHERE item <> ''", "answers"))
def numbered_items(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", F.explode(text.numbered_items("a")).alias("item"))


@query(
    "C17_verification",
    w(
        f"""SELECT k, CASE WHEN t = '' THEN NULL WHEN t IN ('not sure', 'not sure.', 'unsure') OR starts_with(t, 'not sure') THEN 'Not Sure' WHEN starts_with(t, 'yes') THEN 'Yes' WHEN starts_with(t, 'no') THEN 'No'
WHEN contains(t, 'not sure') THEN 'Not Sure' WHEN contains(t, 'yes') THEN 'Yes' WHEN contains(t, 'no') THEN 'No' END AS label FROM (SELECT k, lower({_s("a")}) AS t FROM answers)""",
        "answers",
    ),
)
def verification(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.verification("a").alias("label"))


@query(
    "C18_consistency_verdict",
    w(
        f"""SELECT k, CASE WHEN t = '' THEN NULL WHEN f IN ('yes', 'consistent', 'right', 'correct') THEN true WHEN f IN ('no', 'inconsistent', 'wrong', 'not') THEN false WHEN contains(t, 'not') AND contains(t, 'consistent') THEN false
WHEN contains(t, 'consistent') OR contains(t, 'yes') THEN true WHEN contains(t, 'no') OR contains(t, 'wrong') THEN false END AS verdict FROM (SELECT k, lower({_s("a")}) AS t, ({_w("lower(a)")})[1] AS f FROM answers)""",
        "answers",
    ),
)
def consistency_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.consistency_verdict("a").alias("verdict"))


@query(
    "C19_boolean_verdict",
    w(
        f"""SELECT k, CASE WHEN t IN ('', 'nan') THEN NULL WHEN f IN ('true', 'yes', 'correct', 'affirmative', 'right') THEN true WHEN f IN ('false', 'no', 'incorrect', 'wrong', 'negative') THEN false WHEN regexp_matches(t, '\\bnot (true|the case)\\b') OR contains(t, 'is false') THEN false
WHEN contains(t, 'is true') THEN true WHEN contains(t, 'false') THEN false WHEN contains(t, 'true') THEN true END AS verdict FROM (SELECT k, lower({_s("a")}) AS t, regexp_extract(lower({_s("a")}), '^[^\\s,.;:!?]*') AS f FROM answers)""",
        "answers",
    ),
)
def boolean_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.boolean_verdict("a").alias("verdict"))


@query("C19_proposition", w("SELECT k, CASE WHEN contains(a, 'is it true that') THEN 'C is D' END AS proposition FROM answers", "answers"))
def proposition(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.proposition("a").alias("proposition"))


@query("C19_option_index", w(f"SELECT k, CASE WHEN l <> '' AND ascii(upper(l)) - 65 < k % 5 THEN ascii(upper(l)) - 65 END AS option FROM (SELECT k, CASE WHEN t IN ('nan', 'None') THEN '' WHEN regexp_matches(t, '^\\(?[A-Da-d]\\)?[.\\):\\s]') THEN regexp_extract(t, '^\\(?([A-Da-d])', 1) WHEN regexp_matches(t, '^[A-Da-d]$') THEN t ELSE '' END AS l FROM (SELECT k, {_s('a')} AS t FROM answers))", "answers"))
def option_index(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.option_index("a", F.col("k") % 5).alias("option"))


@query(
    "C20_translation_valid",
    w(
        f"""SELECT k, NOT (t = '' OR starts_with(upper(t), 'ERROR:') OR regexp_matches(lower(t), '^\\s*({"|".join(text.ANSWER_TOKENS)}|[a-d1-9])\\s*[.!]?\\s*$') OR regexp_matches(t, '^\\s*[A-Da-d]\\s*[.):]\\s+\\S') OR NOT regexp_matches(t, '[A-Za-zÀ-ÖØ-öø-ÿ]')
OR (ends_with(c, '?') AND NOT ends_with(t, '?')) OR length(t) < 8) AS valid FROM (SELECT k, {_s("a")} AS t, rtrim(c) AS c FROM answers)""",
        "answers",
    ),
)
def translation_valid(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.translation_valid("a", "c").alias("valid"))


@query(
    "C21_nli_labels",
    w(
        """SELECT k, label, conf AS confidence, round(CASE label WHEN 'entailment' THEN conf ELSE (1 - conf) / 2 END, 6) AS entailment, round(CASE label WHEN 'contradiction' THEN conf ELSE (1 - conf) / 2 END, 6) AS contradiction FROM (
SELECT k, CASE WHEN contains(a, 'Contradiction') THEN 'contradiction' WHEN contains(a, '"same"') THEN 'entailment' ELSE 'neutral' END AS label, CASE WHEN contains(a, 'Contradiction') THEN 0.8 WHEN contains(a, '"same"') THEN 1.0 ELSE 0.9 END AS conf FROM answers)""",
        "answers",
    ),
)
def nli_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = text.nli_label("a")
    return answers(spark, sf).select("k", n["label"].alias("label"), n["confidence"].alias("confidence"), F.round(n["entailment"], 6).alias("entailment"), F.round(n["contradiction"], 6).alias("contradiction"))


_CLEAN = "regexp_replace(" + _s("regexp_replace(regexp_replace(regexp_replace(" + _s("a") + ", $$\\*\\*(.+?)\\*\\*$$, $$\\1$$, $$g$$), $$\\*(.+?)\\*$$, $$\\1$$, $$g$$), $$^(?i)(conclusion|final conclusion|最终结论|结论|answer)\\s*[:：]?\\s*$$, $$$$)") + ", $$\\s+$$, $$ $$, $$g$$)"


@query("C22_clean_conclusion", w(f"SELECT k, {_CLEAN} AS conclusion FROM answers", "answers"))
def clean_conclusion(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.clean_conclusion("a").alias("conclusion"))


@query(
    "C22_bare_conclusion",
    w(f"SELECT k, length(t) < 15 OR list_contains({_list(text.BARE_WORDS)}, lower(t)) OR len({_w('t')}) <= 3 OR NOT list_has_any(regexp_extract_all(lower(t), '[a-z]+'), {_list(text.CLAIM_WORDS)}) AS bare FROM (SELECT k, {_s('regexp_replace(' + _s('a') + ', $$[.!?]+$$ || chr(36), $$$$)')} AS t FROM answers)", "answers"),
)
def bare_conclusion(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.bare_conclusion("a").alias("bare"))


@query("C23_tail_window", w(f"SELECT row_index, CASE WHEN n > 400 THEN {_s('substr(t, n - 400 + 1 + CASE WHEN p > 0 THEN p + 1 WHEN s > 0 THEN s + 1 ELSE 0 END)')} ELSE t END AS tail FROM (SELECT row_index, t, n, instr(substr(t, n - 400 + 1, 200), chr(10) || chr(10)) AS p, instr(substr(t, n - 400 + 1, 150), '. ') AS s FROM (SELECT row_index, original_llm_answer AS t, length(original_llm_answer) AS n FROM qa_pairs))", "qa_pairs"))
def tail_window(spark: SparkSession, sf: str) -> DataFrame:
    return b.qa_pairs(spark, sf).select("row_index", text.tail_window("original_llm_answer", 400).alias("tail"))


@query("C23_locate_conclusion", w("SELECT k, CASE WHEN i > 0 THEN i - 1 ELSE greatest(0, length(a) - 2 * length(c)) END AS start, CASE WHEN i > 0 THEN i - 1 + length(c) ELSE length(a) END AS \"end\" FROM (SELECT k, a, c, CASE WHEN c = '' THEN 1 ELSE instr(lower(a), lower(c)) END AS i FROM answers)", "answers"))
def locate_conclusion(spark: SparkSession, sf: str) -> DataFrame:
    v = text.locate_conclusion("a", "c")
    return answers(spark, sf).select("k", v["start"].alias("start"), v["end"].alias("end"))


@query(
    "C24_nli_verdicts",
    w("SELECT label, label <> 'contradiction' AS consistent, count(*) AS n FROM (SELECT CASE WHEN entailment_score >= contradiction_score AND entailment_score >= neutral_score THEN 'entailment' WHEN contradiction_score >= neutral_score THEN 'contradiction' ELSE 'neutral' END AS label FROM consistency) GROUP BY 1, 2", "consistency"),
)
def nli_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = text.nli_verdict(F.col("entailment_score"), F.col("contradiction_score"), F.col("neutral_score"), F.lit(False))
    return b.consistency(spark, sf).groupBy(v["label"].alias("label"), v["consistent"].alias("consistent")).agg(F.count(F.lit(1)).alias("n"))


@query("C25_split_context", w("SELECT k, CASE WHEN contains(a, 'is it true that') THEN 'Given that A is B,' WHEN contains(a, 'Is it old') THEN '' ELSE '' END AS context, CASE WHEN contains(a, 'is it true that') THEN 'is it true that C is D?' ELSE a END AS question FROM answers", "answers"))
def split_context(spark: SparkSession, sf: str) -> DataFrame:
    v = text.split_context("a")
    return answers(spark, sf).select("k", v["context"].alias("context"), v["question"].alias("question"))


#: Openings for an extra fact before a question.
FACT_OPENINGS = ["I have known that ", "I heard about that ", "It is said that ", "Someone told me that ", "I've heard a whisper that "]


@query("C26_extra_fact", w(f"SELECT k, concat(({_list(FACT_OPENINGS)})[CAST(concat('0x', substr(md5(CAST(k AS VARCHAR)), 1, 8)) AS BIGINT) % 5 + 1], regexp_replace(lower({_s('c')}), '[.,;:!?]+$', ''), ', ', lower({_s('a')})) AS t FROM answers", "answers"))
def extra_fact(spark: SparkSession, sf: str) -> DataFrame:
    """A question after a fact, with an opening chosen by the row's hash."""
    pick = (F.conv(F.substring(F.md5(F.col("k").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5).cast("int")
    fact = F.regexp_replace(F.lower(text.strip("c")), "[.,;:!?]+$", "")
    return answers(spark, sf).select("k", F.concat(F.get(F.array(*[F.lit(x) for x in FACT_OPENINGS]), pick), fact, F.lit(", "), F.lower(text.strip("a"))).alias("t"))


@query("C27_follow_ups", w("SELECT k, concat(rtrim(a), ' Please think step by step to solve this problem and give the answer.') AS qmr1, concat('Known: [', c, ']', chr(10), 'May I ask: [', a, ']') AS qmr4, concat('[', c, '] Is this statement not true?') AS amr1, concat(a, ' Is it ''x''? Or ''', c, '''? Or ''z''? Or maybe none of the above answers are correct?') AS amr2 FROM answers", "answers"))
def follow_ups(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select(
        "k",
        F.concat(F.rtrim("a"), F.lit(" Please think step by step to solve this problem and give the answer.")).alias("qmr1"),
        F.concat(F.lit("Known: ["), "c", F.lit("]\nMay I ask: ["), "a", F.lit("]")).alias("qmr4"),
        F.concat(F.lit("["), "c", F.lit("] Is this statement not true?")).alias("amr1"),
        F.concat("a", F.lit(" Is it 'x'? Or '"), "c", F.lit("'? Or 'z'? Or maybe none of the above answers are correct?")).alias("amr2"),
    )


@query("C28_atomic_pairs", w("SELECT s, o, concat('Does ', coalesce(e.label, s), ' have a ', coalesce(f.label, o), '?') AS q1, concat('Is there a ', coalesce(f.label, o), ' in ', coalesce(e.label, s), '?') AS q2 FROM triples LEFT JOIN entities e ON e.id = s LEFT JOIN entities f ON f.id = o WHERE p = 'P527' AND starts_with(s, 'Q3')", "triples", "entities"))
def atomic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.operators import graph

    t = b.triples(spark, sf).filter(F.col("p").eqNullSafe("P527") & F.startswith("s", F.lit("Q3"))).select("s", "o")
    e = b.entities(spark, sf)
    named = graph.label(graph.label(t, e, "s", "ls"), e, "o", "lo")
    return named.select("s", "o", F.concat(F.lit("Does "), "ls", F.lit(" have a "), "lo", F.lit("?")).alias("q1"), F.concat(F.lit("Is there a "), "lo", F.lit(" in "), "ls", F.lit("?")).alias("q2"))


@query("C29_training_answers", w("SELECT k, concat(CASE WHEN k % 2 = 0 THEN concat('Reasoning: Based on the given rule ''r', k, ''', I can determine the answer.', chr(10), chr(10)) ELSE '' END, 'Answer: ', CASE k % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'True' WHEN 2 THEN 'B' ELSE a END) AS t FROM answers", "answers"))
def training_answers(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("k") % 4
    kind = F.when(m == 0, F.lit("yes_no")).when(m == 1, F.lit("true_false")).when(m == 2, F.lit("multiple_choice")).otherwise(F.lit("wh_question"))
    answer = F.when(m < 2, F.lit("true")).when(m == 2, F.lit("second")).otherwise(F.col("a"))
    reason = F.when(F.col("k") % 2 == 0, F.concat(F.lit("r"), F.col("k").cast("string"))).otherwise(F.lit(""))
    return answers(spark, sf).select("k", text.training_answer(kind, answer, F.array(F.lit("first"), F.lit("second")), reason).alias("t"))


@query("C31_percent", w("SELECT rule, concat(CAST(CAST(round(100.0 * bad / n, 2) AS DECIMAL(10, 2)) AS VARCHAR), '%') AS rate FROM (SELECT rule, count(*) AS n, count_if(NOT answers_consistent) AS bad FROM consistency GROUP BY rule)", "consistency"))
def percents(spark: SparkSession, sf: str) -> DataFrame:
    g = stats.rate_by(b.consistency(spark, sf), "rule", "answers_consistent")
    return g.select("rule", text.percent(F.round(F.col("inconsistent") * 100.0 / F.col("n"), 2) / 100).alias("rate"))


@query("C32_smart_lower", w("SELECT k, CASE WHEN regexp_matches(({ws})[1], '^[A-Z]{{2,}}|[0-9:]') THEN a ELSE concat(lower(substr(a, 1, 1)), substr(a, 2)) END AS t FROM answers".format(ws=_w("a")), "answers"))
def smart_lower(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", F.when(F.col("a") == "", F.lit("")).otherwise(text.smart_lower("a")).alias("t"))


_NEGATIONS = "CASE " + f"WHEN {_any('lower(a)', grammar.NEGATIVE)} THEN a " + " ".join(f"WHEN regexp_matches(lower(a), '\\b{v}\\b') THEN regexp_replace({_s('a')}, '(?i)\\b{v}\\b', '{n}')" for v, n in grammar.NEGATED.items()) + f" ELSE concat('It is not true that ', lower({_s('a')})) END"


@query("C33_negations", w(f"SELECT k, {_NEGATIONS} AS t FROM answers", "answers"))
def negations(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", grammar.negate(F.col("a")).alias("t"))


_ASKED = [
    ("is|are|was|were|am", ".+", "\\2 \\1 \\3?"), ("can|could|will|would|shall|should|may|might|must", ".+", "\\2 \\1 \\3?"), ("has|have|had", ".+", "\\2 \\1 \\3?"),
    ("\\w+s", ".*", "Does \\1 \\2 \\3?"), ("\\w+ed", ".*", "Did \\1 \\2 \\3?"),
]


def _asked(x: str) -> str:
    cases = ""
    for verb, rest, by in _ASKED:
        pattern = f"'(?i)^(\\w+)\\s+({verb})\\s+({rest})$'"
        q = f"regexp_replace({x}, {pattern}, '{by}')"
        cases += f" WHEN regexp_matches({x}, {pattern}) THEN concat(upper(substr({q}, 1, 1)), substr({q}, 2))"
    return f"CASE{cases} ELSE concat('Is it true that ', lower({x}), '?') END"


@query("C34_yes_no_questions", w(f"SELECT id, {_asked('x')} AS q1, {_asked('y')} AS q2, {_asked('z')} AS q3 FROM (SELECT id, concat(label, ' is a part of it') AS x, concat(label, ' makes steel') AS y, concat('The ', label, ' of all') AS z FROM entities)", "entities"))
def yes_no_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda *parts: grammar.yes_no_question(F.concat(*[F.col(p) if p == "label" else F.lit(p) for p in parts]))
    return b.entities(spark, sf).select("id", q("label", " is a part of it").alias("q1"), q("label", " makes steel").alias("q2"), q("The ", "label", " of all").alias("q3"))


_WORDS_ROWS = "(SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark UNION ALL SELECT unnest(['child', 'leaf', 'knife', 'city', 'box', 'hero', 'cactus', 'analysis', 'radio', 'index', 'wolf', 'bus', 'people', 'criteria', 'heroes', 'boxes', 'cities', 'wolves', 'i'])))"
_FOREIGN_SQL = " ".join(f"WHEN ends_with(w, '{e}') THEN concat(substr(w, 1, length(w) - {len(e)}), '{n}')" for e, n in grammar.FOREIGN)
_PLURAL = "CASE " + " ".join(f"WHEN w = '{a}' THEN '{c}'" for a, c in grammar.IRREGULAR.items()) + f""" {_FOREIGN_SQL} WHEN regexp_matches(w, '(s|sh|ch|x|z)$') THEN concat(w, 'es') WHEN regexp_matches(w, '[^aeiou]y$') THEN concat(substr(w, 1, length(w) - 1), 'ies')
WHEN ends_with(w, 'f') THEN concat(substr(w, 1, length(w) - 1), 'ves') WHEN ends_with(w, 'fe') THEN concat(substr(w, 1, length(w) - 2), 'ves') WHEN regexp_matches(w, '[^aeiou]o$') THEN concat(w, 'es') ELSE concat(w, 's') END"""
_SINGULAR = "CASE " + " ".join(f"WHEN w = '{c}' THEN '{a}'" for a, c in grammar.IRREGULAR.items()) + """ WHEN ends_with(w, 'ies') AND length(w) > 3 THEN concat(substr(w, 1, length(w) - 3), 'y') WHEN ends_with(w, 'ves') THEN concat(substr(w, 1, length(w) - 3), 'f')
WHEN regexp_matches(w, '(s|sh|ch|x|z|o)es$') THEN substr(w, 1, length(w) - 2) WHEN ends_with(w, 's') AND length(w) > 1 THEN substr(w, 1, length(w) - 1) ELSE w END"""


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    own = "child leaf knife city box hero cactus analysis radio index wolf bus people criteria heroes boxes cities wolves i".split()
    found = b.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))
    return found.unionByName(spark.createDataFrame([(x,) for x in own], "w string")).select(F.lower("w").alias("w")).distinct()


@query("C35_number_forms", f"SELECT w, {_PLURAL} AS plural, {_SINGULAR} AS singular FROM {_WORDS_ROWS}")
def number_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf).select("w", grammar.plural(F.col("w")).alias("plural"), grammar.singular(F.col("w")).alias("singular"))


@query("C36_articles", f"SELECT w, CASE WHEN list_contains({_list(text.DETERMINERS)}, w) OR (ends_with(w, 's') AND NOT list_contains({_list(text.SINGULAR_S)}, w)) THEN w WHEN regexp_matches(w, '^[aeiou]') THEN concat('an ', w) ELSE concat('a ', w) END AS phrase FROM {_WORDS_ROWS}")
def articles(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf).select("w", text.with_article("w").alias("phrase"))


@query("C39_wh_questions", w(f"SELECT k, concat('What is the home of ', CASE WHEN k % 2 = 0 THEN 'who' ELSE 'when' END, '?') AS q FROM answers", "answers"))
def wh_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The focus replaced by a question word: when for a year, who for a person."""
    focus = F.when(F.col("k") % 2 == 0, F.lit("Ann Lee")).otherwise(F.lit("1984"))
    word = grammar.question_word(text.entity_kind(focus), focus)
    return answers(spark, sf).select("k", grammar.wh_question(F.concat(F.lit("What is the home of "), focus, F.lit(".")), focus, word).alias("q"))


@query("C40_sentence_kinds", w(f"SELECT k, CASE WHEN ends_with(t, '?') AND list_contains({_list(grammar.WH_WORDS)}, f) THEN 'wh' WHEN ends_with(t, '?') AND contains(t, ' or ') THEN 'choice' WHEN ends_with(t, '?') THEN 'yes_no' WHEN ends_with(t, '!') THEN 'exclamation' ELSE 'statement' END AS kind, CASE WHEN regexp_matches(t, '\\b(not|no|never|none|neither|nor|nothing|nobody)\\b') OR regexp_matches(t, 'n''t\\b') THEN 'negative' ELSE 'positive' END AS polarity FROM (SELECT k, lower({_s('a')}) AS t, ({_w('lower(a)')})[1] AS f FROM answers)", "answers"))
def sentence_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", grammar.sentence_kind(F.col("a")).alias("kind"), grammar.polarity(F.col("a")).alias("polarity"))


@query("N1_tenses", w("SELECT k, CASE k % 6 WHEN 0 THEN 'present simple' WHEN 1 THEN 'past continuous' WHEN 2 THEN 'present perfect' WHEN 3 THEN 'future simple' WHEN 4 THEN 'present perfect continuous' ELSE 'past simple' END AS tense FROM answers", "answers"))
def tenses(spark: SparkSession, sf: str) -> DataFrame:
    said = ["She opens the gate.", "They were waiting outside.", "He has finished it.", "We will go.", "She has been reading.", "It rained and ended early."]
    t = F.get(F.array(*[F.lit(x) for x in said]), (F.col("k") % 6).cast("int"))
    return answers(spark, sf).select("k", grammar.tense(t).alias("tense"))


@query("N2_parts_of_speech", f"SELECT w, CASE WHEN ends_with(w, 'ly') THEN 'adverb' WHEN regexp_matches(w, '(ing|ed|ize|ise|ify)$') THEN 'verb' WHEN regexp_matches(w, '(ous|ful|able|ible|ive|less|al|ic)$') THEN 'adjective' ELSE 'noun' END AS pos FROM {_WORDS_ROWS}")
def parts_of_speech(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(spark, sf).select("w", grammar.part_of_speech(F.col("w")).alias("pos"))


@query("N12_last_sentence", w("SELECT k, CASE WHEN contains(a, 'A. Paris') THEN 'Paris is the capital' WHEN contains(a, 'C.') THEN 'C.** Marshal of the branch' WHEN contains(a, 'Is it old') THEN 'The bridge is located in the north.' WHEN contains(a, 'second item') THEN '- third item' ELSE a END AS t FROM answers", "answers"))
def last_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", text.last_sentence("a").alias("t"))


# ---- vectors

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "embeddings")


_COS = "CASE WHEN list_dot_product(x.embedding, x.embedding) = 0 OR list_dot_product(y.embedding, y.embedding) = 0 THEN 0 ELSE list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))) END"


@query("V1_cosine", f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS}, 5) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf).select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    nxt = embeddings(spark, sf).select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(nxt, "a").select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query("V2_dot", "SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 5) AS dot FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def dot(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf).select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    nxt = embeddings(spark, sf).select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(nxt, "a").select("a", "b", F.round(vectors.dot(F.col("x"), F.col("y")), 5).alias("dot"))


@query("X8_similarity_top_k", f"SELECT q, vec_id, round(score, 4) AS score, rank FROM (SELECT q, vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM (SELECT x.vec_id AS q, y.vec_id, round(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS score FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0)) WHERE rank <= 5")
def similarity_top_k(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return vectors.top_k(e.filter("vec_id % 50 = 0"), e, 5).select("q", "vec_id", F.round("score", 4).alias("score"), "rank")


@query("F17_similar_relations", f"SELECT label, a, b FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, {_COS} AS c FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE c < 0.7")
def similar_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one label that differ enough; norms are computed once for each vector, not for each pair."""
    e = embeddings(spark, sf).select("label", "vec_id", "embedding", F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))).alias("n"))
    x = e.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.col("n").alias("nx"))
    y = e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("n").alias("ny"))
    norm = F.col("nx") * F.col("ny")
    close = F.when(norm > 0, vectors.dot(F.col("x"), F.col("y")) / norm).otherwise(F.lit(0.0))
    return x.join(y, "label").filter((F.col("a") < F.col("b")) & (close < 0.7)).select("label", "a", "b")


@query("F18_distinct_meaning", f"SELECT a, b, round(c, 5) AS cosine FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_COS} AS c FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) WHERE c < 0.99")
def distinct_meaning(spark: SparkSession, sf: str) -> DataFrame:
    return cosine(spark, sf).filter("cosine < 0.99")


# ---- sources and sinks that SQL can follow

def _through(spark: SparkSession, df: DataFrame, name: str, write, read) -> DataFrame:
    from lemmary.sources.scratch import scratch_path

    path = scratch_path(spark, name)
    write(df, path)
    return read(path)


@query("S3_tsv_round_trip", w("SELECT s, p, o FROM triples WHERE p = 'P361'", "triples"))
def tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.sources import files

    t = b.triples(spark, sf).filter("p = 'P361'")
    return _through(spark, t, "triples", files.write_triples, lambda p: files.read_triples(spark, p))


@query("S4_csv_tree", w("SELECT rule, mutation_type, count(*) AS n FROM consistency GROUP BY 1, 2", "consistency"))
def csv_tree(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.sources import files

    c = b.consistency(spark, sf).select("rule", "mutation_type", "l_orderkey", "answers_consistent")
    tree = _through(spark, c, "tree", files.write_tree, lambda p: files.read_tree(spark, p, "l_orderkey long, answers_consistent boolean"))
    return tree.groupBy("rule", "mutation_type").agg(F.count(F.lit(1)).alias("n"))


@query("S6_tolerant_jsonl", "SELECT event_id AS property_id, round(value, 6) AS functionality FROM events WHERE event_id % 3 = 0")
def tolerant_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Good lines of a file that also has blank, broken and error lines."""
    from lemmary.sources import files

    e = b.table(spark, sf, "events")
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("property_id"), F.col("value").alias("functionality"), F.lit(None).cast("string").alias("error")))
    line = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.lit('{"property_id": "x", broken')).otherwise(F.to_json(F.struct(F.lit("y").alias("property_id"), F.lit("timeout").alias("error"))))
    rows = _through(spark, e.select(line.alias("value")), "jsonl", lambda d, p: d.write.text(p), lambda p: files.read_jsonl(spark, p, "property_id string, functionality double, error string"))
    return rows.select(F.col("property_id").cast("long").alias("property_id"), F.round("functionality", 6).alias("functionality"))


@query("S7_cache_round_trip", w("SELECT p AS key, round(f, 6) AS value FROM (SELECT p, avg(1.0 / k) AS f FROM (SELECT p, s, count(*) AS k FROM triples GROUP BY p, s) GROUP BY p)", "triples"))
def cache_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The functionality cache as one JSON object of a key for each predicate, and back."""
    from lemmary.operators import graph

    f = graph.functionality(b.triples(spark, sf))
    packed = f.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p", "functionality")))).alias("j"))  # a key for each predicate
    return packed.select(F.explode(F.from_json("j", "map<string,double>")).alias("key", "value")).select("key", F.round("value", 6).alias("value"))


@query("S9_chunks", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk, o_orderkey FROM orders")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.operators import sampling

    o = sampling.chunk_numbers(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 50)
    return o.select("chunk", "o_orderkey")


@query("S10_chunk_merge", "SELECT c_custkey, c_name FROM customer")
def chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks written apart and read as one."""
    c = b.table(spark, sf, "customer").select("c_custkey", "c_name")
    return _through(spark, c.withColumn("chunk", F.col("c_custkey") % 7), "chunks", lambda d, p: d.write.partitionBy("chunk").parquet(p), lambda p: spark.read.parquet(p)).select("c_custkey", "c_name")


@query(
    "S11_resume_upsert",
    w("SELECT k, CASE WHEN a = '' OR a = 'nan' OR starts_with(a, 'ERROR:') THEN concat('again ', k) ELSE a END AS answer FROM answers", "answers"),
)
def resume_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with an error or no answer are done again; the newest answer of a key wins."""
    from lemmary.operators import resume

    a = answers(spark, sf).select("k", F.col("a").alias("answer"))
    todo = resume.pending(a.select("k"), a, ["k"], "answer")
    fresh = todo.withColumn("answer", F.concat(F.lit("again "), F.col("k").cast("string")))
    return resume.upsert(a, fresh, ["k"])


@query("S16_chat_lines", "SELECT conv_id, concat('{\"conversations\":[', string_agg(concat('{\"from\":', to_json(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END), ',\"turns\":', turn, '}'), ',' ORDER BY turn), ']}') AS line FROM conversations GROUP BY conv_id")
def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = b.table(spark, sf, "conversations")
    who = F.when(F.col("role") == "user", F.lit("human")).when(F.col("role") == "assistant", F.lit("gpt")).otherwise(F.col("role"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", who.alias("from")))).alias("x"))
    turns = F.transform("x", lambda t: F.struct(t["from"].alias("from"), t["turn"].alias("turns")))
    return g.select("conv_id", F.to_json(F.struct(turns.alias("conversations"))).alias("line"))


@query("S17_trainer_log", "SELECT event_id AS current_steps, CASE WHEN event_id % 5 = 0 THEN 'eval' ELSE 'train' END AS series, round(value, 6) AS loss FROM events")
def trainer_log(spark: SparkSession, sf: str) -> DataFrame:
    """One mixed log read as two series."""
    from lemmary.sources import files

    e = b.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 5 == 0, F.struct(F.col("event_id").alias("current_steps"), F.col("value").alias("eval_loss"), F.lit(None).cast("double").alias("loss")))
    name = name.otherwise(F.struct(F.col("event_id").alias("current_steps"), F.lit(None).cast("double").alias("eval_loss"), F.col("value").alias("loss")))
    rows = _through(spark, e.select(F.to_json(name).alias("value")), "log", lambda d, p: d.write.text(p), lambda p: files.read_trainer_log(spark, p))
    return rows.select("current_steps", "series", F.round("loss", 6).alias("loss"))


@query("S19_question_tsv", "SELECT doc_id, lang FROM documents")
def question_tsv(spark: SparkSession, sf: str) -> DataFrame:
    d = b.table(spark, sf, "documents").select("doc_id", "lang")
    return _through(spark, d, "tsv", lambda x, p: x.write.option("sep", "\t").csv(p), lambda p: spark.read.csv(p, sep="\t", schema="doc_id long, lang string"))


@query("S20_prompt_templates", w("SELECT k, concat('Q: ', a, ' A:') AS prompt FROM answers WHERE k % 2 = 0 UNION ALL SELECT k, concat('Please answer: ', a) FROM answers WHERE k % 2 = 1", "answers"))
def prompt_templates(spark: SparkSession, sf: str) -> DataFrame:
    table = F.array(F.lit("Q: {question} A:"), F.lit("Please answer: {question}"))
    return answers(spark, sf).select("k", F.replace(F.get(table, (F.col("k") % 2).cast("int")), F.lit("{question}"), F.col("a")).alias("prompt"))


@query("S15_answer_source")
def answer_source(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from an injected callable, one call for a batch of prompts; here a stub that echoes."""
    from lemmary.sources import models

    return models.answer(prompt_templates(spark, sf), "prompt", lambda prompts: [f"Yes: {p[:20]}" for p in prompts])


@query("N13_nli_scores")
def nli_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of an injected judge averaged; here the share of equal words."""
    from lemmary.sources import models

    def judge(pairs):
        share = [len(set(a.split()) & set(c.split())) / max(1, len(set(a.split()) | set(c.split()))) for a, c in pairs]
        return [(s, (1 - s) / 2, (1 - s) / 2) for s in share]

    return models.entail(answers(spark, sf), "a", "c", judge)


