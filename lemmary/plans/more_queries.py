"""Queries of the remaining sources, text functions and language transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions import grammar, text, vectors
from lemmary.operators import distract
from lemmary.plans import bindings as b
from lemmary.plans import rules
from lemmary.plans.bindings import with_views as w
from lemmary.plans.mutation_queries import _kind_sql
from lemmary.plans.registry import query
from lemmary.plans.text_queries import _list, _s, _through, _w, answers
from lemmary.sources import files


@query("S5_rule_scan", "SELECT concat('?a P', p_partkey, ' ?b => ?a P1 ?b') AS \"Rule\", round(p_size / 50.0, 6) AS \"PCA Confidence\", p_partkey % 200 AS \"Positive Examples\" FROM part")
def rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A rule file: tab separated with spaces in its header."""
    p = b.table(spark, sf, "part")
    rows = p.select(
        F.concat(F.lit("?a P"), F.col("p_partkey").cast("string"), F.lit(" ?b => ?a P1 ?b")).alias("Rule"), F.lit(0.1).alias("Head Coverage"), F.lit(0.5).alias("Std Confidence"),
        (F.col("p_size") / 50).alias("PCA Confidence"), (F.col("p_partkey") % 200).alias("Positive Examples"),
    )
    read = _through(spark, rows, "rules", lambda d, at: d.write.option("sep", "\t").option("header", True).csv(at), lambda at: files.read_rules(spark, at))
    return read.select("Rule", F.round("PCA Confidence", 6).alias("PCA Confidence"), "Positive Examples")


@query("S8_ordered_sink", w("SELECT rule, mutation_type, min(l_orderkey) AS first_order, count(*) AS n FROM consistency GROUP BY 1, 2", "consistency"))
def ordered_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Known columns first, written under rule and mutation, read back."""
    c = files.ordered_columns(b.consistency(spark, sf).select("qtype", "l_orderkey", "rule", "mutation_type"), ["rule", "mutation_type"])
    tree = _through(spark, c, "sink", files.write_tree, lambda at: files.read_tree(spark, at, "l_orderkey long, qtype string"))
    return tree.groupBy("rule", "mutation_type").agg(F.min("l_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))


@query("S12_append_sink", "SELECT event_id, event_type FROM events")
def append_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint that grows by appending: two runs, read as one."""
    from lemmary.sources.scratch import scratch_path

    e = b.table(spark, sf, "events").select("event_id", "event_type")
    path = scratch_path(spark, "append")
    files.append_jsonl(e.filter("event_id % 2 = 0"), path)
    files.append_jsonl(e.filter("event_id % 2 = 1"), path)
    return spark.read.json(path, schema="event_id long, event_type string")


@query("S13_graph_round_trip", w("SELECT 'triples' AS part, count(*) AS n FROM triples UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'properties', count(DISTINCT p) FROM triples", "triples", "entities"))
def graph_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from functools import reduce

    from lemmary.sources.scratch import scratch_path

    t = b.triples(spark, sf)
    path = scratch_path(spark, "graph")
    files.save_graph(path, t, b.entities(spark, sf), t.select("p").distinct())
    loaded = files.load_graph(spark, path)
    return reduce(DataFrame.unionByName, [f.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, f in loaded.items()])


@query("S14_raw_query", w("SELECT p, count(*) AS n FROM triples WHERE starts_with(s, 'Q1') GROUP BY p", "triples"))
def raw_query(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters are bound, not pasted into the text."""
    return spark.sql("SELECT p, count(*) AS n FROM {t} WHERE startswith(s, :kind) GROUP BY p", args={"kind": "Q1"}, t=b.triples(spark, sf))


@query("C15_word_vectors")
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of best matches between the words of two answers; words take vectors of the table by their length and first letter."""
    e = b.table(spark, sf, "embeddings")
    a = answers(spark, sf).select("k", "a", "c")
    found = a.select(F.explode(text.words("a")).alias("w")).unionByName(a.select(F.explode(text.words("c")).alias("w"))).select(F.lower("w").alias("word")).distinct()
    table = found.withColumn("vec_id", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(100))).join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return vectors.word_vector_score(a, table.select("word", "vector"), "a", "c", "k").select("k", F.round("score", 5).alias("score"))


_TEXTS = "(SELECT k, CASE k % 4 WHEN 0 THEN concat('Given (a, b), x', k, ', is y, z') WHEN 1 THEN concat('no commas ', k) WHEN 2 THEN concat('only (one, two) ', k) ELSE concat('first ', k, ', second') END AS t FROM answers)"


@query("C37_premise_split", w(f"SELECT k, CASE k % 4 WHEN 0 THEN concat('Given (a, b), x', k, ', is y') WHEN 3 THEN concat('first ', k) ELSE '' END AS premise, CASE k % 4 WHEN 0 THEN 'z' WHEN 3 THEN 'second' ELSE t END AS main FROM {_TEXTS}", "answers"))
def premise_split(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    m = F.col("k") % 4
    t = (
        F.when(m == 0, F.concat(F.lit("Given (a, b), x"), k, F.lit(", is y, z"))).when(m == 1, F.concat(F.lit("no commas "), k))
        .when(m == 2, F.concat(F.lit("only (one, two) "), k)).otherwise(F.concat(F.lit("first "), k, F.lit(", second")))
    )
    return answers(spark, sf).select("k", text.split_premise(t).alias("x")).select("k", "x.premise", "x.main")


@query(
    "C38_answer_spans",
    w(
        f"""SELECT k, unnest(list_distinct(list_transform(list_concat(regexp_extract_all(a, '(\\b\\p{{Lu}}\\w*(?:\\s+\\p{{Lu}}\\w*)*)', 1),
list_concat(regexp_extract_all(a, '"([^"]+)"', 1), regexp_extract_all(a, '\\(([^)]+)\\)', 1))), lambda v: {_s("v")}))) AS span FROM answers""",
        "answers",
    ),
)
def answer_spans(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", F.explode(text.answer_spans("a")).alias("span"))


@query("Q6_logic_in_words", "SELECT * FROM (VALUES ('either a P17 b, or b P527 a'), ('a P17 b and b P361 c and it is not the case that a P30 c')) AS t(said)")
def logic_in_words(spark: SparkSession, sf: str) -> DataFrame:
    say = lambda a: f"{a.s[1:]} {a.p} {a.o[1:]}"
    bodies = ["(?a P17 ?b OR ?b P527 ?a) => ?a P30 ?b", "?a P17 ?b AND ?b P361 ?c AND NOT ?a P30 ?c => ?a P30 ?c"]
    return spark.createDataFrame([(rules.describe(rules.parse_rule(x).body, say),) for x in bodies], "said string")


@query("R2_logic_parser", "SELECT * FROM (VALUES ('AND', 3, 3), ('OR', 2, 2)) AS t(kind, parts, variables)")
def logic_parser(spark: SparkSession, sf: str) -> DataFrame:
    bodies = [rules.parse_rule(x).body for x in ("?a P17 ?b AND ?b P361 ?c AND NOT ?a P30 ?c => ?a P30 ?c", "(?a P17 ?b OR ?b P527 ?a) => ?a P30 ?b")]
    return spark.createDataFrame([(x.kind, len(x.parts), len(x.variables)) for x in bodies], "kind string, parts int, variables int")


@query("N9_question_words", w("SELECT id, CASE WHEN regexp_matches(label, '\\b(1[0-9]{3}|20[0-9]{2})\\b') THEN 'when' WHEN kind = 'person' THEN 'who' WHEN kind = 'place' THEN 'where' WHEN kind = 'organization' THEN 'which organization' ELSE 'what' END AS word FROM (SELECT id, label, " + _kind_sql("label") + " AS kind FROM entities)", "entities"))
def question_words(spark: SparkSession, sf: str) -> DataFrame:
    return b.entities(spark, sf).select("id", grammar.question_word(text.entity_kind("label"), F.col("label")).alias("word"))


@query("N10_grammar_shapes", "SELECT * FROM (VALUES ('located in', 'located', 'in', 'verb preposition'), ('part of', NULL, 'of', 'noun preposition'), ('country', NULL, NULL, 'noun'), ('follows', 'follows', NULL, 'verb')) AS t(label, verb, preposition, shape)")
def grammar_shapes(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.createDataFrame([("located in",), ("part of",), ("country",), ("follows",)], "label string")
    return labels.select("label", grammar.grammar_shape(F.col("label")).alias("g")).select("label", "g.*")


_CORE, _ABSTRACT, _SUBSTANCE = f"list_contains({_list(grammar.UNCOUNTABLE)}, v)", f"regexp_matches(v, '{grammar.ABSTRACT}')", f"regexp_matches(v, '{grammar.SUBSTANCE}')"


@query(
    "N3_countability",
    f"""SELECT v, s > 0.5 AS uncountable, round(least(s, 1.0), 6) AS confidence FROM (SELECT v, (CASE WHEN {_CORE} THEN 0.9 ELSE 0 END + CASE WHEN {_ABSTRACT} THEN 0.6 ELSE 0 END + CASE WHEN {_SUBSTANCE} THEN 0.2 ELSE 0 END)::DOUBLE AS s FROM (
SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS v FROM documents UNION SELECT unnest({_list([*grammar.UNCOUNTABLE, "kindness", "sing", "learning", "ing", "helium", "machine", "hardware", "nation"])}))) ORDER BY v""",
)
def countability(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct word of the documents, beside the listed ones."""
    found = b.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("v"))
    listed = spark.createDataFrame([(v,) for v in [*grammar.UNCOUNTABLE, "kindness", "sing", "learning", "ing", "helium", "machine", "hardware", "nation"]], "v string")
    return found.unionByName(listed).distinct().select("v", grammar.countability(F.col("v")).alias("x")).select("v", "x.*")


_AUXILIARY = "is|are|was|were|do|does|did|has|have|can|will|would"


@query(
    "N11_sentence_analysis",
    w(
        f"""SELECT k, CASE WHEN ends_with(t, '?') AND regexp_matches(t, ',\\s*({_AUXILIARY})(n''t)?\\s+\\w+\\?$') THEN 'tag' WHEN ends_with(t, '?') AND coalesce(list_contains({_list(grammar.WH_WORDS)}, v[1]), false) THEN 'wh'
WHEN ends_with(t, '?') AND contains(t, ' or ') THEN 'choice' WHEN ends_with(t, '?') THEN 'yes_no' WHEN ends_with(t, '!') THEN 'exclamation' ELSE 'statement' END AS kind,
CASE WHEN regexp_matches(lower(a), '\\b(not|no|never|none|neither|nor|nothing|nobody)\\b|n''t\\b') THEN 'negative' ELSE 'positive' END AS polarity,
concat(CASE WHEN regexp_matches(t, '\\b(would|should)\\b') THEN 'future-in-past' WHEN regexp_matches(t, '\\b(will|shall)\\b') THEN 'future'
WHEN regexp_matches(t, '\\b(was|were|had|did)\\b') OR (NOT regexp_matches(string_split(t, chr(10))[1], '\\b(have|has)\\b') AND regexp_matches(string_split(t, chr(10))[1], '\\b[a-z]{{3,}}ed\\b')) THEN 'past' ELSE 'present' END, ' ',
CASE WHEN regexp_matches(t, '\\b(have|has|had)\\s+been\\s+\\w+ing\\b') THEN 'perfect continuous' WHEN regexp_matches(t, '\\b(have|has|had)\\s+\\w+(ed|en|n|t)\\b') THEN 'perfect'
WHEN regexp_matches(t, '\\b(am|is|are|was|were|be)\\s+\\w+ing\\b') THEN 'continuous' ELSE 'simple' END) AS tense, len(v) AS words FROM (SELECT k, a, lower({_s("a")}) AS t, {_w("lower(a)")} AS v FROM answers)""",
        "answers",
    ),
)
def sentence_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", grammar.analysis(F.col("a")).alias("x")).select("k", "x.*")


@query(
    "N15_statements",
    w(
        f"""SELECT k, CASE WHEN starts_with(lower(s), 'no') THEN 'it is not true' WHEN starts_with(lower(s), 'yes') THEN 'it Is true' ELSE 'Is it true' END AS yes_no,
CASE WHEN starts_with(lower(s), 'no') THEN 'It is not true that which town lies there' WHEN starts_with(lower(s), 'yes') THEN 'Which town lies there' ELSE concat(s, ' lies there') END AS wh FROM (SELECT k, {_s("a")} AS s FROM answers)""",
        "answers",
    ),
)
def statements(spark: SparkSession, sf: str) -> DataFrame:
    """A question of either form with each answer made a statement."""
    said = lambda q: grammar.statement_of(F.lit(q), F.col("a"))
    return answers(spark, sf).select("k", said("Is it true?").alias("yes_no"), said("Which town lies there?").alias("wh"))


@query("N16_paraphrases", w("SELECT k, CASE WHEN contains(a, 'is it true that') THEN replace(a, 'is it true that', 'is it the case that') ELSE a END AS t FROM answers", "answers"))
def paraphrases(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("k", grammar.paraphrase(F.col("a")).alias("t"))


@query("N17_pair_judges")
def pair_judges(spark: SparkSession, sf: str) -> DataFrame:
    """Only pairs that a cheap test calls different go to the judge; the others keep its verdict."""
    from lemmary.sources import models

    a = answers(spark, sf).withColumn("cheap", text.same_answer("a", "c"))
    asked = models.answer(a.filter("NOT cheap"), "a", lambda texts: ["Yes" if "yes" in t.lower() else "No" for t in texts])
    judged = asked.select("k", text.consistency_verdict("answer").alias("same"), F.lit(True).alias("judged"))
    return a.filter("cheap").select("k", F.col("cheap").alias("same"), F.lit(False).alias("judged")).unionByName(judged)


@query("D3_inverse_conclusions", w("SELECT p, CASE p WHEN 'P361' THEN false WHEN 'P527' THEN false ELSE true END AS safe FROM (SELECT DISTINCT p FROM triples)", "triples"))
def inverse_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    """Which predicates may be negated when the graph's own inverse pairs are the premises."""
    return b.triples(spark, sf).select("p").distinct().select("p", distract.negation_safe(F.col("p"), F.array(F.lit("P361"), F.lit("P527"))).alias("safe"))
