"""Queries over verdicts: rates, intervals, effect sizes, correlations, bins, samples and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmary.functions import text
from lemmary.operators import overlap, sampling, stats
from lemmary.plans import bindings as b
from lemmary.plans.bindings import with_views as w
from lemmary.plans.registry import query

MUTATIONS = ["body_augmentation", "body_permutation", "entity_rename"]
TYPES = ["yes_no", "true_false", "wh_question", "multiple_choice"]
SCORES = ["contradiction_score", "entailment_score", "neutral_score"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def rnd(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


@query(
    "A8_overall_consistency",
    w("SELECT count(*) AS total, count_if(answers_consistent) AS consistent, count_if(NOT answers_consistent) AS inconsistent, round(avg(CAST(answers_consistent AS INT)), 6) AS consistency_rate FROM consistency", "consistency"),
)
def overall(spark: SparkSession, sf: str) -> DataFrame:
    return stats.overall(b.consistency(spark, sf), "answers_consistent").select("total", "consistent", "inconsistent", *rnd("consistency_rate"))


@query(
    "A8_overall_labelled",
    w("SELECT count(answers_consistent) AS total, count_if(answers_consistent) AS consistent, count_if(NOT answers_consistent) AS inconsistent, round(avg(CAST(answers_consistent AS INT)), 6) AS consistency_rate FROM qa_pairs", "qa_pairs"),
)
def overall_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return stats.overall(b.qa_pairs(spark, sf), "answers_consistent").select("total", "consistent", "inconsistent", *rnd("consistency_rate"))


def _wilson_sql(factor: str, z: float) -> str:
    mid = f"(r + {z} * {z} / (2 * n)) / (1 + {z} * {z} / n)"
    half = f"{z} * sqrt(r * (1 - r) / n + {z} * {z} / (4.0 * n * n)) / (1 + {z} * {z} / n)"
    return w(
        f"""SELECT {factor}, n, n - bad AS consistent, bad AS inconsistent, round(r, 6) AS rate, round(greatest(0.0, {mid} - {half}), 6) AS ci_low, round(least(1.0, {mid} + {half}), 6) AS ci_high
FROM (SELECT {factor}, count(*) AS n, count_if(NOT answers_consistent) AS bad, avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END) AS r FROM consistency GROUP BY {factor})""",
        "consistency",
    )


def _rates(factor: str, z: float):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return stats.rate_by(b.consistency(spark, sf), factor, "answers_consistent", z).select(
            factor, "n", "consistent", "inconsistent", *rnd("rate", "ci_low", "ci_high")
        )

    return run


query("A9_rate_by_mutation", _wilson_sql("mutation_type", 1.96))(_rates("mutation_type", stats.Z))
query("A9_rate_by_rule", _wilson_sql("rule", 1.96))(_rates("rule", stats.Z))
query("A9b_rate_by_type", _wilson_sql("qtype", stats.Z_EXACT))(_rates("qtype", stats.Z_EXACT))
query("A24_group_comparison", _wilson_sql("segment", stats.Z_EXACT))(_rates("segment", stats.Z_EXACT))


@query(
    "A10_rate_matrix",
    w("SELECT rule, " + ", ".join(f"round(avg(CASE WHEN mutation_type = '{m}' THEN CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END END), 6) AS {m}_rate, count_if(mutation_type = '{m}') AS {m}_n" for m in MUTATIONS) + " FROM consistency GROUP BY rule", "consistency"),
)
def rate_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.matrix(b.consistency(spark, sf), "rule", "mutation_type", MUTATIONS, "answers_consistent")
    return m.select("rule", *[c for v in MUTATIONS for c in (*rnd(f"{v}_rate"), F.col(f"{v}_n"))])


@query(
    "A11_keep_latest",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1",
)
def keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return stats.keep_latest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id")]).drop("ts")


@query(
    "W3_duplicate_counts",
    "SELECT count(*) AS rows, count(DISTINCT user_id) AS kept, count(*) - count(DISTINCT user_id) AS duplicates FROM events",
)
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = b.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kept")).withColumn("duplicates", F.col("rows") - F.col("kept"))


_PCT = "concat(printf('%.2f', round(100.0 * {a} / {n}, 2)), '%')"


@query(
    "A12_rule_mutation_summary",
    w("SELECT rule, mutation_type, count(*) AS total, count_if(v = 'true') AS consistent, count(*) - count_if(v = 'true') AS inconsistent, round(100.0 * count_if(v = 'true') / count(*), 2) AS consistent_pct FROM (SELECT rule, mutation_type, lower(CAST(answers_consistent AS VARCHAR)) AS v FROM consistency) GROUP BY rule, mutation_type", "consistency"),
)
def rule_mutation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts as text: only 'true' in any case is consistent, anything else is not."""
    c = b.consistency(spark, sf).select("rule", "mutation_type", (F.lower(F.col("answers_consistent").cast("string")) == "true").alias("ok"))
    g = c.groupBy("rule", "mutation_type").agg(F.count(F.lit(1)).alias("total"), stats.count_if(F.col("ok")).alias("consistent"))
    return g.withColumns({"inconsistent": F.col("total") - F.col("consistent"), "consistent_pct": F.round(100 * F.col("consistent") / F.col("total"), 2)})


@query(
    "A13_type_summary",
    w("SELECT coalesce(qtype, 'OVERALL') AS question_type, count(*) AS total, count_if(answers_consistent) AS consistent, round(100.0 * count_if(answers_consistent) / count(*), 2) AS consistent_pct FROM consistency GROUP BY ROLLUP (qtype)", "consistency"),
)
def type_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = b.consistency(spark, sf).rollup("qtype").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), stats.count_if(F.col("answers_consistent")).alias("consistent"))
    name = F.when(F.col("g") == 1, F.lit("OVERALL")).otherwise(F.col("qtype"))
    return g.select(name.alias("question_type"), "total", "consistent", F.round(100 * F.col("consistent") / F.col("total"), 2).alias("consistent_pct"))


def by_rule(c: DataFrame) -> DataFrame:
    bad = ~F.col("answers_consistent")
    return c.groupBy("rule").agg(
        F.count(F.lit(1)).alias("total"), stats.count_if(bad).alias("inconsistent"),
        *[stats.count_if(bad & (F.col("mutation_type") == m)).alias(f"{m}_inconsistent") for m in MUTATIONS],
        *[F.avg(F.when(bad, F.col(s))).alias(f"mean_{s}") for s in SCORES],
        F.array_join(F.sort_array(F.collect_set("priority")), ", ").alias("relations"),
    )


_BY_RULE = (
    "SELECT rule, count(*) AS total, count_if(NOT answers_consistent) AS inconsistent, "
    + ", ".join(f"count_if(NOT answers_consistent AND mutation_type = '{m}') AS {m}_inconsistent" for m in MUTATIONS)
    + ", "
    + ", ".join(f"round(avg(CASE WHEN NOT answers_consistent THEN {s} END), 6) AS mean_{s}" for s in SCORES)
    + ", array_to_string(list_sort(list(DISTINCT priority)), ', ') AS relations FROM consistency GROUP BY rule"
)


@query("A14_by_rule", w(_BY_RULE, "consistency"))
def rule_report(spark: SparkSession, sf: str) -> DataFrame:
    g = by_rule(b.consistency(spark, sf))
    return g.select("rule", "total", "inconsistent", *[f"{m}_inconsistent" for m in MUTATIONS], *rnd(*[f"mean_{s}" for s in SCORES]), "relations")


@query(
    "A15_by_mutation",
    w("SELECT mutation_type, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate, " + ", ".join(f"round(avg({s}), 6) AS mean_{s}, round(stddev_pop({s}), 6) AS std_{s}" for s in SCORES) + ", round(coalesce(avg(CASE WHEN neutral_score > 0 THEN neutral_score END), 0), 6) AS mean_confidence FROM consistency GROUP BY mutation_type", "consistency"),
)
def mutation_report(spark: SparkSession, sf: str) -> DataFrame:
    g = b.consistency(spark, sf).groupBy("mutation_type").agg(
        F.count(F.lit(1)).alias("total"), F.avg((~F.col("answers_consistent")).cast("double")).alias("rate"),
        *[f(s).alias(f"{n}_{s}") for s in SCORES for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.coalesce(F.avg(F.when(F.col("neutral_score") > 0, F.col("neutral_score"))), F.lit(0.0)).alias("mean_confidence"),
    )
    return g.select("mutation_type", "total", *rnd("rate", *[f"{n}_{s}" for s in SCORES for n in ("mean", "std")], "mean_confidence"))


_ENTITY_ROWS = """SELECT pos, entity, answers_consistent FROM (
SELECT 0 AS pos, concat('Q6', lpad(CAST(l_partkey AS VARCHAR), 9, '0')) AS entity, answers_consistent FROM consistency
UNION ALL SELECT 1, concat('Q4', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')), answers_consistent FROM consistency)"""


def _entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf)
    return c.select("answers_consistent", F.posexplode(F.array(b.qid(6, "l_partkey"), b.qid(4, "l_suppkey"))).alias("pos", "entity"))


@query(
    "A16_by_entity",
    w(f"SELECT entity, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate FROM ({_ENTITY_ROWS}) GROUP BY entity HAVING count(*) >= 10", "consistency"),
)
def by_entity(spark: SparkSession, sf: str) -> DataFrame:
    g = _entity_rows(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("total"), F.avg((~F.col("answers_consistent")).cast("double")).alias("rate"))
    return g.filter("total >= 10").select("entity", "total", *rnd("rate"))


@query(
    "A16_label_lengths",
    w(f"SELECT pos, answers_consistent, count(*) AS n, round(avg(length(label)), 6) AS mean_length FROM ({_ENTITY_ROWS}) x JOIN entities e ON e.id = x.entity GROUP BY pos, answers_consistent", "consistency", "entities"),
)
def label_lengths(spark: SparkSession, sf: str) -> DataFrame:
    named = _entity_rows(spark, sf).join(b.entities(spark, sf).select(F.col("id").alias("entity"), "label"), "entity")
    return named.groupBy("pos", "answers_consistent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("label")), 6).alias("mean_length"))


@query(
    "A16_entity_types",
    w(f"SELECT coalesce(description, '[none]') AS entity_type, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate FROM ({_ENTITY_ROWS}) x JOIN entities e ON e.id = x.entity GROUP BY 1 HAVING count(*) >= 5", "consistency", "entities"),
)
def entity_types(spark: SparkSession, sf: str) -> DataFrame:
    named = _entity_rows(spark, sf).join(b.entities(spark, sf).select(F.col("id").alias("entity"), "description"), "entity")
    g = named.groupBy(F.coalesce("description", F.lit("[none]")).alias("entity_type")).agg(
        F.count(F.lit(1)).alias("total"), F.avg((~F.col("answers_consistent")).cast("double")).alias("rate")
    )
    return g.filter("total >= 5").select("entity_type", "total", *rnd("rate"))


#: One rule text for each mutation, so that relations can be counted over verdicts.
RULE_TEXTS = ["?a P17 ?b ?b P361 ?c => ?a P30 ?c", "?a P361 ?b => ?b P527 ?a", "?o P98 ?c ?c P17 ?n ?n P361 ?r => ?o P30 ?r"]
_WITH_RULES = (
    "(SELECT *, CASE mutation_type " + " ".join(f"WHEN '{m}' THEN '{r}'" for m, r in zip(MUTATIONS, RULE_TEXTS, strict=True)) + " END AS original_rule FROM consistency)"
)


def with_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf)
    chosen = F.get(F.array(*[F.lit(r) for r in RULE_TEXTS]), F.array_position(F.array(*[F.lit(m) for m in MUTATIONS]), F.col("mutation_type")).cast("int") - 1)
    return c.withColumn("original_rule", chosen)


@query(
    "A17_by_relation",
    w(f"SELECT relation, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate, count(DISTINCT rule) AS rules FROM (SELECT rule, answers_consistent, unnest(regexp_extract_all(original_rule, '\\bP\\d+\\b')) AS relation FROM {_WITH_RULES}) GROUP BY relation HAVING count(*) >= 5", "consistency"),
)
def by_relation(spark: SparkSession, sf: str) -> DataFrame:
    x = with_rules(spark, sf).select("rule", "answers_consistent", F.explode(text.rule_predicates("original_rule")).alias("relation"))
    # Few rules for each relation: rules are made distinct by a first grouping.
    g = x.groupBy("relation", "rule").agg(F.count(F.lit(1)).alias("n"), stats.count_if(~F.col("answers_consistent")).alias("bad"))
    g = g.groupBy("relation").agg(F.sum("n").alias("total"), F.round(F.sum("bad") / F.sum("n"), 6).alias("rate"), F.count(F.lit(1)).alias("rules"))
    return g.filter("total >= 5")


@query(
    "A17_relation_ngrams",
    w(f"SELECT concat(p[i], ' -> ', p[i + 1]) AS ngram, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate FROM (SELECT answers_consistent, p, unnest(range(1, len(p))) AS i FROM (SELECT answers_consistent, regexp_extract_all(original_rule, '\\bP\\d+\\b') AS p FROM {_WITH_RULES})) GROUP BY 1", "consistency"),
)
def relation_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    p = text.rule_predicates("original_rule")
    grams = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: F.concat(x, F.lit(" -> "), F.get(p, i + 1)))
    x = with_rules(spark, sf).select("answers_consistent", F.explode(grams).alias("ngram"))
    return x.groupBy("ngram").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg((~F.col("answers_consistent")).cast("double")), 6).alias("rate"))


_TOP = """(SELECT *, CASE WHEN entailment_score >= contradiction_score AND entailment_score >= neutral_score THEN 'entailment'
WHEN contradiction_score >= neutral_score THEN 'contradiction' ELSE 'neutral' END AS label,
list_sort([entailment_score, contradiction_score, neutral_score]) AS ss FROM consistency)"""


def nli(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf)
    sorted_scores = F.sort_array(F.array(*SCORES), asc=False)
    verdict = text.nli_verdict(F.col("entailment_score"), F.col("contradiction_score"), F.col("neutral_score"), F.lit(False))
    return c.withColumns({"label": verdict["label"], "gap": F.get(sorted_scores, F.lit(0)) - F.get(sorted_scores, F.lit(1))})


@query(
    "A18_by_nli_label",
    w(f"SELECT label, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate, round(avg(ss[3] - ss[2]), 6) AS mean_gap, round(stddev_samp(ss[3] - ss[2]), 6) AS std_gap FROM {_TOP} GROUP BY label", "consistency"),
)
def by_nli_label(spark: SparkSession, sf: str) -> DataFrame:
    g = nli(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("total"), F.avg((~F.col("answers_consistent")).cast("double")).alias("rate"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("std_gap")
    )
    return g.select("label", "total", *rnd("rate", "mean_gap", "std_gap"))


_BINS = [0.5, 1.0, 1.5, 2.0, 3.0]


@query(
    "A18_gap_bins",
    w("SELECT bin, count(*) AS total, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate FROM (SELECT answers_consistent, " + " + ".join(f"CAST(ss[3] - ss[2] > {x} AS INT)" for x in _BINS) + f" AS bin FROM {_TOP}) GROUP BY bin", "consistency"),
)
def gap_bins(spark: SparkSession, sf: str) -> DataFrame:
    edges = F.array(F.lit(0.0), *[F.lit(x) for x in _BINS], F.lit(100.0))
    g = nli(spark, sf).groupBy(stats.bucket(F.col("gap"), edges).alias("bin"))
    return g.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg((~F.col("answers_consistent")).cast("double")), 6).alias("rate"))


@query(
    "A18_score_summary",
    w("SELECT " + ", ".join(f"round(min({s}), 9) AS {s}_min, round(max({s}), 9) AS {s}_max, round(avg({s}), 9) AS {s}_mean, round(quantile_cont({s}, 0.25), 9) AS {s}_q25, round(quantile_cont({s}, 0.5), 9) AS {s}_median, round(quantile_cont({s}, 0.75), 9) AS {s}_q75" for s in SCORES) + " FROM consistency", "consistency"),
)
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf).select(*SCORES)
    row = c.agg(*[f(s).alias(f"{s}_{n}") for s in SCORES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    found = stats.quantiles(c, SCORES, [0.25, 0.5, 0.75])
    exact = {f"{s}_{n}": v for s in SCORES for n, v in zip(("q25", "median", "q75"), found[s], strict=True)}
    row = row.withColumns({n: F.lit(v).cast("double") for n, v in exact.items()})
    return row.select(*[F.round(n, 9).alias(n) for n in row.columns])


@query(
    "A18_score_correlations",
    w("SELECT round(corr(contradiction_score, entailment_score), 6) AS c_e, round(corr(contradiction_score, neutral_score), 6) AS c_n, round(corr(entailment_score, neutral_score), 6) AS e_n FROM consistency", "consistency"),
)
def score_correlations(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf)
    x, e, n = SCORES
    return c.agg(F.round(F.corr(x, e), 6).alias("c_e"), F.round(F.corr(x, n), 6).alias("c_n"), F.round(F.corr(e, n), 6).alias("e_n"))


_COMPLEX = """SELECT row_index, length(original_llm_answer) AS length_chars, len(list_filter(regexp_split_to_array(original_llm_answer, '\\s+'), lambda x: x <> '')) AS length_words,
length(original_llm_answer) - length(replace(original_llm_answer, ',', '')) AS num_commas,
length(original_llm_answer) - length(replace(replace(original_llm_answer, '(', ''), ')', '')) AS num_parentheses,
length(original_llm_answer) - length(replace(original_llm_answer, '?', '')) AS num_question_marks,
contains(lower(original_llm_answer), ' and ') AS has_and, contains(lower(original_llm_answer), ' or ') AS has_or, contains(lower(original_llm_answer), 'given that') AS has_given_that,
length(original_llm_answer) - length(replace(replace(original_llm_answer, '.', ''), '?', '')) AS num_sentences FROM qa_pairs"""


@query("C12_question_complexity", w(_COMPLEX, "qa_pairs"))
def question_complexity(spark: SparkSession, sf: str) -> DataFrame:
    q = b.qa_pairs(spark, sf)
    parts = text.question_complexity("original_llm_answer")
    return q.select("row_index", *[(c if n.startswith("has") else c.cast("long")).alias(n) for n, c in parts.items()])


@query(
    "A19_complexity_contrast",
    w(f"""SELECT feature, round(avg(CASE WHEN answers_consistent THEN v END), 6) AS consistent, round(avg(CASE WHEN NOT answers_consistent THEN v END), 6) AS inconsistent FROM (
SELECT q.answers_consistent, unnest(['length_chars', 'length_words', 'num_commas', 'num_sentences']) AS feature, unnest([length_chars, length_words, num_commas, num_sentences]) AS v
FROM ({_COMPLEX}) c JOIN qa_pairs q USING (row_index)) GROUP BY feature""", "qa_pairs"),
)
def complexity_contrast(spark: SparkSession, sf: str) -> DataFrame:
    q = b.qa_pairs(spark, sf)
    names = ["length_chars", "length_words", "num_commas", "num_sentences"]
    parts = text.question_complexity("original_llm_answer")
    row = q.select("answers_consistent", *[parts[n].cast("double").alias(n) for n in names])
    sums = row.agg(*[
        F.struct(F.lit(n).alias("feature"), F.round(F.avg(F.when(F.col("answers_consistent"), F.col(n))), 6).alias("consistent"),
                 F.round(F.avg(F.when(~F.col("answers_consistent"), F.col(n))), 6).alias("inconsistent")).alias(n)
        for n in names
    ])
    return sums.select(F.explode(F.array(*names)).alias("x")).select("x.*")


_CHI = """WITH cells AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM consistency GROUP BY 1, 2),
r AS (SELECT a, sum(n) AS row FROM cells GROUP BY a), c AS (SELECT b, sum(n) AS col FROM cells GROUP BY b),
x AS (SELECT r.a, c.b, coalesce(n, 0) AS n, row * col / (SELECT sum(n) FROM cells) AS e, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS dof
FROM r CROSS JOIN c LEFT JOIN cells ON cells.a = r.a AND cells.b = c.b)
SELECT round(chi2, 6) AS chi2, dof, round(sqrt(chi2 / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1))), 6) AS cramers_v, n
FROM (SELECT sum(pow(CASE WHEN dof = 1 THEN abs(n - e) - least(0.5, abs(n - e)) ELSE abs(n - e) END, 2) / e) AS chi2, max(dof) AS dof, CAST(sum(n) AS BIGINT) AS n FROM x)"""


def _chi(a: str, c: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return stats.chi_square(b.consistency(spark, sf), a, c).select(*rnd("chi2"), "dof", *rnd("cramers_v"), "n")

    return run


query("A20_chi_square", w(_CHI.format(a="mutation_type", b="answers_consistent"), "consistency"))(_chi("mutation_type", "answers_consistent"))
query("A20_chi_square_yates", w(_CHI.format(a="(segment = 'BUILDING')", b="answers_consistent"), "consistency"))(
    lambda spark, sf: stats.chi_square(b.consistency(spark, sf).withColumn("big", F.col("segment") == "BUILDING"), "big", "answers_consistent").select(*rnd("chi2"), "dof", *rnd("cramers_v"), "n")
)


@query(
    "A21_pearson",
    w(" UNION ALL ".join(f"SELECT '{s}' AS feature, round(corr(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END, {s}), 6) AS r, count(*) AS n FROM consistency" for s in SCORES), "consistency"),
)
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf).withColumn("bad", (~F.col("answers_consistent")).cast("double"))
    return stats.pearson(c, SCORES, "bad").select("feature", *rnd("r"), "n")


_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(
    "A21_spearman",
    w(f"SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT {_RANK.format(c='contradiction_score')} AS x, {_RANK.format(c='entailment_score')} AS y FROM consistency)", "consistency"),
)
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf).select("contradiction_score", "entailment_score")
    ranked = stats.all_tied_ranks(c, {"contradiction_score": "x", "entailment_score": "y"})
    return ranked.agg(F.round(F.corr("x", "y"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


@query(
    "W5_tied_ranks",
    f"SELECT o_orderkey, {_RANK.format(c='o_totalprice')} AS price_rank FROM orders",
)
def tied_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tied_ranks(b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "price_rank").select("o_orderkey", "price_rank")


@query(
    "A22_cohens_d",
    w("""SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM (
SELECT count_if(NOT answers_consistent) AS n1, count_if(answers_consistent) AS n2, avg(contradiction_score) FILTER (NOT answers_consistent) AS m1, avg(contradiction_score) FILTER (answers_consistent) AS m2,
var_samp(contradiction_score) FILTER (NOT answers_consistent) AS v1, var_samp(contradiction_score) FILTER (answers_consistent) AS v2 FROM consistency)""", "consistency"),
)
def cohens_d(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cohens_d(b.consistency(spark, sf), "contradiction_score", "answers_consistent").select("n1", "n2", *rnd("d"))


@query(
    "A23_eta_squared",
    w("SELECT round(sum(pow(gm - tm, 2)) / sum(pow(x - tm, 2)), 6) AS eta_squared FROM (SELECT entailment_score AS x, avg(entailment_score) OVER (PARTITION BY rule) AS gm, avg(entailment_score) OVER () AS tm FROM consistency)", "consistency"),
)
def eta_squared(spark: SparkSession, sf: str) -> DataFrame:
    return stats.eta_squared(b.consistency(spark, sf), "rule", "entailment_score").select(*rnd("eta_squared"))


@query(
    "A25_quantile_bins",
    w("""WITH e AS (SELECT list_distinct(l) AS l FROM (SELECT [quantile_cont(contradiction_score, 0.0), quantile_cont(contradiction_score, 0.25), quantile_cont(contradiction_score, 0.5), quantile_cont(contradiction_score, 0.75), quantile_cont(contradiction_score, 1.0)] AS l FROM consistency))
SELECT bin, count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 6) AS rate FROM (
SELECT contradiction_score AS x, answers_consistent AS ok, len(list_filter(list_slice(list_sort(l), 2, len(l) - 1), lambda q: q < contradiction_score)) AS bin FROM consistency CROSS JOIN e) GROUP BY bin""", "consistency"),
)
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.quantile_bins(b.consistency(spark, sf), "contradiction_score")
    return x.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("contradiction_score"), 6).alias("low"), F.round(F.max("contradiction_score"), 6).alias("high"),
        F.round(F.avg((~F.col("answers_consistent")).cast("double")), 6).alias("rate"),
    )


_FREQ = f"""WITH p AS (SELECT unnest(regexp_extract_all(original_rule, '\\bP\\d+\\b')) AS predicate FROM {_WITH_RULES}), f AS (SELECT predicate, count(*) AS frequency FROM p GROUP BY predicate)"""


@query("A26_corpus_frequencies", w(f"{_FREQ} SELECT predicate, frequency, round(1 - cume_dist() OVER (ORDER BY frequency), 6) AS scarcity FROM f", "consistency"))
def corpus_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Scarcity is one less the share of predicates that are no more frequent."""
    p = with_rules(spark, sf).select(F.explode(text.rule_predicates("original_rule")).alias("predicate"))
    f = p.groupBy("predicate").agg(F.count(F.lit(1)).alias("frequency"))  # a row for each predicate: small enough for one window
    return f.select("predicate", "frequency", F.round(1 - F.cume_dist().over(Window.orderBy("frequency")), 6).alias("scarcity"))


@query("W2_percentile_rank", w("SELECT rule, n, round(cume_dist() OVER (ORDER BY n), 6) AS support FROM (SELECT rule, count(*) AS n FROM consistency GROUP BY rule)", "consistency"))
def percentile_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = b.consistency(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return f.select("rule", "n", F.round(F.cume_dist().over(Window.orderBy("n")), 6).alias("support"))


_RATERS = "(SELECT CASE l_linestatus WHEN 'O' THEN 'correct' ELSE 'logic_error' END AS a, CASE WHEN l_returnflag = 'N' THEN 'correct' ELSE 'logic_error' END AS b FROM lineitem)"


@query(
    "A27_kappa",
    f"""WITH r AS (SELECT * FROM {_RATERS}), t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM r),
pe AS (SELECT sum(x * y) AS pe FROM (SELECT a, count(*) / (SELECT n FROM t) AS x FROM r GROUP BY a) JOIN (SELECT b, count(*) / (SELECT n FROM t) AS y FROM r GROUP BY b) ON a = b)
SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM t, pe""",
)
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    item = b.table(spark, sf, "lineitem")
    a = F.when(F.col("l_linestatus") == "O", F.lit("correct")).otherwise(F.lit("logic_error"))
    c = F.when(F.col("l_returnflag") == "N", F.lit("correct")).otherwise(F.lit("logic_error"))
    return stats.kappa(item.select(a.alias("x"), c.alias("y")), "x", "y").select("n", *rnd("po", "pe", "kappa"))


@query(
    "A28_violation_statistics",
    w("SELECT grouping(mutation_type) AS g_mutation, grouping(qtype) AS g_type, grouping(rule) AS g_rule, mutation_type, qtype, rule, count(*) AS total, count_if(NOT answers_consistent) AS violations, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate FROM consistency GROUP BY GROUPING SETS ((), (mutation_type), (qtype), (rule))", "consistency"),
)
def violation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """All one-way tables and the total from a single scan."""
    c = b.consistency(spark, sf)
    g = c.groupingSets([[], ["mutation_type"], ["qtype"], ["rule"]], "mutation_type", "qtype", "rule")
    return g.agg(
        F.grouping("mutation_type").cast("long").alias("g_mutation"), F.grouping("qtype").cast("long").alias("g_type"), F.grouping("rule").cast("long").alias("g_rule"),
        F.count(F.lit(1)).alias("total"), stats.count_if(~F.col("answers_consistent")).alias("violations"),
        F.round(F.avg((~F.col("answers_consistent")).cast("double")), 6).alias("rate"),
    )


@query(
    "A29_majority_vote",
    """WITH v AS (SELECT l_orderkey AS row_index, trim(l_returnflag) AS answer, count(*) AS n, min(l_linenumber * 1000000 + l_partkey) AS pos FROM lineitem WHERE trim(l_returnflag) <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY row_index ORDER BY n DESC, pos, answer) AS k, max(n) OVER (PARTITION BY row_index) AS top FROM v)
SELECT row_index, max(CASE WHEN k = 1 THEN answer END) AS voted, CAST(max(top) AS BIGINT) AS votes, count_if(n = top) > 1 AS tie FROM r GROUP BY row_index""",
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent answer, the earliest among equals, then the first by name; tie says whether there were equals."""
    item = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_index"), F.trim("l_returnflag").alias("answer"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    v = item.filter("answer <> ''").groupBy("row_index", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    best = v.groupBy("row_index").agg(
        F.min_by("answer", F.struct(-F.col("n"), "pos", "answer")).alias("voted"), F.max("n").alias("votes"), F.collect_list("n").alias("ns")
    )
    return best.select("row_index", "voted", "votes", (F.size(F.filter("ns", lambda n: n == F.col("votes"))) > 1).alias("tie"))


@query(
    "A30_hallucination_score",
    """SELECT l_orderkey AS row_index, round(avg(CASE WHEN l_linenumber % 2 = 0 THEN CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 0.5 END ELSE CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.0 ELSE 0.5 END END), 6) AS score,
count(*) AS items FROM lineitem GROUP BY l_orderkey""",
)
def hallucination_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over items: Yes 0 and No 1 for synonyms, reversed for antonyms, one half otherwise."""
    item = b.table(spark, sf, "lineitem")
    yes = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(0.5)
    value = F.when(F.col("l_linenumber") % 2 == 0, yes).otherwise(1 - yes)
    return item.groupBy(F.col("l_orderkey").alias("row_index")).agg(F.round(F.avg(value), 6).alias("score"), F.count(F.lit(1)).alias("items"))


@query(
    "A31_method_table",
    w("SELECT qtype, mutation_type, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("automobile", "building", "furniture", "household", "machinery")) + ", round((coalesce(automobile, 0) + coalesce(building, 0) + coalesce(furniture, 0) + coalesce(household, 0) + coalesce(machinery, 0)) / nullif(CAST(automobile IS NOT NULL AS INT) + CAST(building IS NOT NULL AS INT) + CAST(furniture IS NOT NULL AS INT) + CAST(household IS NOT NULL AS INT) + CAST(machinery IS NOT NULL AS INT), 0), 6) AS average FROM (SELECT qtype, mutation_type, " + ", ".join(f"avg(CASE WHEN segment = '{m.upper()}' THEN CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END END) AS {m}" for m in ("automobile", "building", "furniture", "household", "machinery")) + " FROM consistency GROUP BY qtype, mutation_type)", "consistency"),
)
def method_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rate of each model as a column and the unweighted mean of those present."""
    models = ["automobile", "building", "furniture", "household", "machinery"]
    bad = (~F.col("answers_consistent")).cast("double")
    g = b.consistency(spark, sf).groupBy("qtype", "mutation_type").agg(*[F.avg(F.when(F.col("segment") == m.upper(), bad)).alias(m) for m in models])
    present = F.filter(F.array(*models), lambda x: x.isNotNull())
    mean = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    return g.select("qtype", "mutation_type", *rnd(*models), F.round(mean, 6).alias("average"))


@query(
    "A32_model_overview",
    w("SELECT segment AS model, count(*) AS total, round(avg(b), 6) AS overall, " + ", ".join(f"round(avg(CASE WHEN mutation_type = '{m}' THEN b END), 6) AS {m}" for m in MUTATIONS) + ", round(avg(CASE WHEN qtype IN ('yes_no', 'true_false') THEN b END), 6) AS yes_no, round(avg(CASE WHEN qtype = 'wh_question' THEN b END), 6) AS wh_question, round(avg(CASE WHEN qtype = 'multiple_choice' THEN b END), 6) AS multiple_choice FROM (SELECT *, CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END AS b FROM consistency) GROUP BY segment", "consistency"),
)
def model_overview(spark: SparkSession, sf: str) -> DataFrame:
    bad = (~F.col("answers_consistent")).cast("double")
    c = b.consistency(spark, sf).withColumn("kind", text.question_type("qtype"))
    return c.groupBy(F.col("segment").alias("model")).agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(bad), 6).alias("overall"),
        *[F.round(F.avg(F.when(F.col("mutation_type") == m, bad)), 6).alias(m) for m in MUTATIONS],
        *[F.round(F.avg(F.when(F.col("kind") == k, bad)), 6).alias(k) for k in ("yes_no", "wh_question", "multiple_choice")],
    )


@query(
    "A33_false_positive_audit",
    w("SELECT count(*) AS sampled, count_if(v = 'Y') AS judged_yes, count_if(v = 'N') AS judged_no, count_if(v = 'E') AS errors, round(count_if(v = 'N') / count(*), 6) AS false_positive_rate FROM (SELECT CASE WHEN priority LIKE '1%' THEN 'Y' WHEN priority LIKE '5%' THEN 'E' ELSE 'N' END AS v FROM consistency WHERE NOT answers_consistent)", "consistency"),
)
def false_positive_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of a judge over inconsistent rows; errors stay in the denominator."""
    v = F.when(F.col("priority").like("1%"), F.lit("Y")).when(F.col("priority").like("5%"), F.lit("E")).otherwise(F.lit("N"))
    c = b.consistency(spark, sf).filter(~F.col("answers_consistent")).select(v.alias("v"))
    n = F.count(F.lit(1))
    count = lambda x: stats.count_if(F.col("v") == x)
    return c.agg(n.alias("sampled"), count("Y").alias("judged_yes"), count("N").alias("judged_no"), count("E").alias("errors"), F.round(count("N") / n, 6).alias("false_positive_rate"))


@query(
    "A34_distribution_profile",
    w("SELECT grouping(mutation_type) AS g_mutation, grouping(qtype) AS g_type, mutation_type, qtype, count(*) AS n FROM consistency GROUP BY CUBE (mutation_type, qtype)", "consistency"),
)
def distribution_profile(spark: SparkSession, sf: str) -> DataFrame:
    return b.consistency(spark, sf).cube("mutation_type", "qtype").agg(
        F.grouping("mutation_type").cast("long").alias("g_mutation"), F.grouping("qtype").cast("long").alias("g_type"), F.count(F.lit(1)).alias("n")
    )


@query(
    "A35_mutation_stats",
    w("SELECT mutation_type, count(*) AS n, count(DISTINCT rule) AS rules, round(count(*) / count(DISTINCT rule), 6) AS per_rule FROM consistency GROUP BY mutation_type", "consistency"),
)
def mutation_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = b.consistency(spark, sf).groupBy("mutation_type", "rule").agg(F.count(F.lit(1)).alias("k"))
    return g.groupBy("mutation_type").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("rules"), F.round(F.sum("k") / F.count(F.lit(1)), 6).alias("per_rule"))


@query(
    "A36_method_histogram",
    w("SELECT priority AS method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(CASE WHEN neutral_score > 0 THEN neutral_score END), 6) AS mean_confidence FROM consistency GROUP BY priority", "consistency"),
)
def method_histogram(spark: SparkSession, sf: str) -> DataFrame:
    g = b.consistency(spark, sf).groupBy(F.col("priority").alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("neutral_score") > 0, F.col("neutral_score"))), 6).alias("mean_confidence")
    )
    return g.crossJoin(g.agg(F.sum("n").alias("all"))).select("method", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"), "mean_confidence")


@query("W7_share_of_total", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    g = b.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("all"))).select("event_type", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(
    "A38_equal_width_trend",
    w("""WITH s AS (SELECT min(entailment_score) AS lo, max(entailment_score) AS hi, least(20, count(DISTINCT entailment_score)) AS k FROM consistency)
SELECT bin, count(*) AS n, round(avg(x), 6) AS mean_feature, round(avg(y), 6) AS mean_target FROM (
SELECT entailment_score AS x, CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END AS y, CAST(least(greatest(0, ceil((entailment_score - lo) / ((hi - lo) / k)) - 1), k - 1) AS INT) AS bin FROM consistency CROSS JOIN s) GROUP BY bin""", "consistency"),
)
def equal_width_trend(spark: SparkSession, sf: str) -> DataFrame:
    x = stats.equal_width(b.consistency(spark, sf), "entailment_score")
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("entailment_score"), 6).alias("mean_feature"), F.round(F.avg((~F.col("answers_consistent")).cast("double")), 6).alias("mean_target"))


@query(
    "A39_rate_distribution",
    w("SELECT round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(min(r), 6) AS min, round(max(r), 6) AS max, count(*) AS rules FROM (SELECT rule, avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END) AS r FROM consistency GROUP BY rule)", "consistency"),
)
def rate_distribution(spark: SparkSession, sf: str) -> DataFrame:
    r = by_rule(b.consistency(spark, sf)).select((F.col("inconsistent") / F.col("total")).alias("r"))
    return r.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.percentile("r", 0.5), 6).alias("median"), F.round(F.min("r"), 6).alias("min"), F.round(F.max("r"), 6).alias("max"), F.count(F.lit(1)).alias("rules"))


@query(
    "A37_master_summary",
    w("""SELECT 'mutation' AS dimension, mutation_type AS level, count(*) AS n, count_if(NOT answers_consistent) AS inconsistent FROM consistency GROUP BY 2
UNION ALL SELECT 'type', qtype, count(*), count_if(NOT answers_consistent) FROM consistency GROUP BY 2
UNION ALL SELECT 'rule', rule, count(*), count_if(NOT answers_consistent) FROM consistency GROUP BY 2
UNION ALL SELECT 'segment', segment, count(*), count_if(NOT answers_consistent) FROM consistency GROUP BY 2""", "consistency"),
)
def master_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every dimension's table from one scan."""
    level = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("level")) for d, c in (("mutation", "mutation_type"), ("type", "qtype"), ("rule", "rule"), ("segment", "segment"))])
    x = b.consistency(spark, sf).select("answers_consistent", F.explode(level).alias("l"))
    return x.groupBy("l.dimension", "l.level").agg(F.count(F.lit(1)).alias("n"), stats.count_if(~F.col("answers_consistent")).alias("inconsistent"))


# ---- order, limit and samples


@query(
    "X1_multi_key_sort",
    "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_mktsegment DESC, c_custkey LIMIT 100",
)
def multi_key_sort(spark: SparkSession, sf: str) -> DataFrame:
    c = b.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return c.orderBy(F.col("c_acctbal").desc(), F.col("c_mktsegment").desc(), "c_custkey").limit(100)


@query(
    "X2_top_rules",
    w("SELECT rule, round(avg(CASE WHEN answers_consistent THEN 0.0 ELSE 1.0 END), 6) AS rate FROM consistency GROUP BY rule ORDER BY rate DESC, rule LIMIT 10", "consistency"),
)
def top_rules(spark: SparkSession, sf: str) -> DataFrame:
    g = b.consistency(spark, sf).groupBy("rule").agg(F.round(F.avg((~F.col("answers_consistent")).cast("double")), 6).alias("rate"))
    return g.orderBy(F.col("rate").desc(), "rule").limit(10)


def _md5(seed: int, *columns: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + "))"


_ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


@query(
    "X3_stratified_sample",
    f"""WITH s AS (SELECT count(*) AS s FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)),
r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {_md5(42, "o_orderkey")} AS o, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {_md5(42, "o_orderkey")}, o_orderkey) AS k, greatest(1, 500 // s) AS base FROM orders CROSS JOIN s),
f AS (SELECT * FROM r WHERE k <= base), g AS (SELECT *, row_number() OVER (ORDER BY o, o_orderkey) AS m FROM r WHERE k > base)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM f UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM g WHERE m <= 500 - (SELECT count(*) FROM f)""",
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = b.table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    return sampling.stratified(o, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 500)


@query(
    "X4_golden_sample",
    f"""WITH l AS (SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS l FROM orders GROUP BY o_orderstatus),
r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {_md5(42, "o_orderkey")}, o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM r JOIN l USING (o_orderstatus) WHERE k <= greatest(1, 12 // l)""",
)
def golden_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.per_group(b.table(spark, sf, "orders").select(*_ORDER_COLUMNS), ["o_orderstatus"], "o_orderpriority", ["o_orderkey"], 12)


@query(
    "X5_inconsistent_first",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus <> 'F' AS ok FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, ok ORDER BY {_md5(42, "o_orderkey")}, o_orderkey) AS k FROM o),
n AS (SELECT o_orderpriority, count_if(NOT ok AND k <= 5) AS bad FROM r GROUP BY o_orderpriority)
SELECT o_orderkey, o_orderpriority, ok FROM r JOIN n USING (o_orderpriority) WHERE CASE WHEN NOT ok THEN k <= 5 ELSE k <= 11 - bad END""",
)
def inconsistent_first(spark: SparkSession, sf: str) -> DataFrame:
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") != "F").alias("ok"))
    return sampling.inconsistent_first(o, ["o_orderpriority"], "ok", ["o_orderkey"], 11)


@query(
    "X6_split",
    f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_md5(42, "o_orderkey")}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split(b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"])


@query("X7_random_facts", w(f"SELECT s, p, o FROM triples WHERE s = 'Q1000000001' ORDER BY {_md5(7, 's', 'p', 'o')} LIMIT 20", "triples"))
def random_facts(spark: SparkSession, sf: str) -> DataFrame:
    t = b.triples(spark, sf).filter("s = 'Q1000000001'")
    return t.orderBy(sampling.order_key(7, "s", "p", "o")).limit(20)


@query("X9_limit", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000")
def limit(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(1000)


@query(
    "W4_first_k_per_group",
    w("SELECT rule, l_orderkey, l_linenumber, l_partkey, l_suppkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM consistency) WHERE rank <= 10", "consistency"),
)
def first_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    from lemmary.operators import graph

    return graph.first_k(b.consistency(spark, sf).select("rule", *KEY), ["rule"], KEY, 10)


@query("W6_chunk_numbers", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk FROM orders")
def chunk_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.chunk_numbers(b.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 50).select("o_orderkey", "chunk")


@query(
    "W8_order_kept",
    "SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS parts FROM lineitem GROUP BY l_orderkey",
)
def order_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Positions travel with the values, so the first order can be restored after any shuffle."""
    item = b.table(spark, sf, "lineitem")
    g = item.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["l_partkey"].cast("string")), ",").alias("parts"))


@query("W9_score_gap", w(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ss[3] - ss[2], 6) AS gap FROM {_TOP}", "consistency"))
def score_gap(spark: SparkSession, sf: str) -> DataFrame:
    return nli(spark, sf).select(*KEY, *rnd("gap"))


# ---- set operations

METHODS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_FLAGS = "(SELECT DISTINCT l_partkey AS idx, segment AS method FROM consistency WHERE NOT answers_consistent)"


def flags(spark: SparkSession, sf: str) -> DataFrame:
    bad = b.consistency(spark, sf).withColumn("violation", ~F.col("answers_consistent"))
    return overlap.flagged(bad.select(F.col("l_partkey").alias("idx"), F.col("segment").alias("method"), "violation"), ["idx", "method"], "violation")


@query("U1_union_all", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with different columns: those a source lacks are null."""
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("U2_distinct", "SELECT DISTINCT l_shipmode FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem)")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode")).distinct()


@query("U3_intersection_size", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def intersection_size(spark: SparkSession, sf: str) -> DataFrame:
    c, s = b.table(spark, sf, "customer").select("c_nationkey"), b.table(spark, sf, "supplier").select("s_nationkey")
    return c.intersect(s).agg(F.count(F.lit(1)).alias("n"))


def _mask(names: list[str]) -> str:
    return " + ".join(f"max(CASE WHEN method = '{m}' THEN {1 << i} ELSE 0 END)" for i, m in enumerate(names))


@query("U4_venn_regions", w(f"SELECT mask, count(*) AS n FROM (SELECT idx, {_mask(METHODS[:3])} AS mask FROM {_FLAGS} WHERE method IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') GROUP BY idx) GROUP BY mask", "consistency"))
def venn_regions(spark: SparkSession, sf: str) -> DataFrame:
    three = METHODS[:3]
    return overlap.regions(flags(spark, sf).filter(F.col("method").isin(three)), ["idx"], "method", three)


@query("U5_exact_intersections", w(f"SELECT members, degree, count(*) AS n FROM (SELECT array_to_string(list_sort(list(method)), '&') AS members, count(*) AS degree FROM {_FLAGS} GROUP BY idx) GROUP BY members, degree", "consistency"))
def exact_intersections(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.exact_intersections(flags(spark, sf), ["idx"], "method")


@query(
    "U6_jaccard",
    w(f"""WITH f AS (SELECT * FROM {_FLAGS}), c AS (SELECT method, count(*) AS n FROM f GROUP BY method),
p AS (SELECT x.method AS a, y.method AS b, count(*) AS shared FROM f x JOIN f y ON x.idx = y.idx AND x.method < y.method GROUP BY 1, 2)
SELECT x.method AS a, y.method AS b, coalesce(shared, 0) AS shared, x.n + y.n - coalesce(shared, 0) AS either, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS jaccard
FROM c x JOIN c y ON x.method < y.method LEFT JOIN p ON p.a = x.method AND p.b = y.method""", "consistency"),
)
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.jaccard(flags(spark, sf), ["idx"], "method", METHODS).select("a", "b", "shared", "either", *rnd("jaccard"))


@query("U7_any_violation", w("SELECT DISTINCT l_partkey AS idx FROM consistency WHERE coalesce(CASE WHEN neutral_score > 4 THEN contradiction_score > 4.5 END, NOT answers_consistent)", "consistency"))
def any_violation(spark: SparkSession, sf: str) -> DataFrame:
    c = b.consistency(spark, sf).select(
        F.col("l_partkey").alias("idx"), F.when(F.col("neutral_score") > 4, F.col("contradiction_score") > 4.5).alias("nli"), (~F.col("answers_consistent")).alias("plain")
    )
    return overlap.flagged(c, ["idx"], "nli", "plain")


@query("U8_model_keys", w("SELECT segment AS model, count(*) AS n FROM (SELECT DISTINCT segment, l_partkey FROM consistency WHERE NOT answers_consistent) GROUP BY segment", "consistency"))
def model_keys(spark: SparkSession, sf: str) -> DataFrame:
    return flags(spark, sf).groupBy(F.col("method").alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("U9_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def difference(spark: SparkSession, sf: str) -> DataFrame:
    c = b.table(spark, sf, "customer").select("c_custkey")
    return c.join(b.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
