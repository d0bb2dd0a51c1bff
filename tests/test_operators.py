import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lemmary import config
from lemmary.functions import grammar, text, vectors
from lemmary.operators import graph, mutate, overlap, resume, sampling, stats
from lemmary.sources import files, models
from lemmary.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_functionality(spark):
    t = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("b", "p", "2"), *[("c", "p", str(i)) for i in range(4)]], "s string, p string, o string")
    f = graph.functionality(t).first()
    assert f.functionality == pytest.approx((1 + 0.5 + 0.25) / 3)


def test_upsert_and_scan(spark):
    t = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    new = spark.createDataFrame([("a", "p", "b"), ("a", "p", "c"), ("a", "p", "c")], "s string, p string, o string")
    assert graph.upsert(t, new).count() == 2 and graph.new_only(t, new).count() == 1
    assert graph.scan(t, s="", p="p").count() == 1 and graph.scan(t, p="q").count() == 0


def test_chi_square(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    r = stats.chi_square(spark.createDataFrame(rows, "f string, v string"), "f", "v").first()
    n, want = 65, 0
    for a, b, k in ((30, 40, 10), (30, 25, 20), (35, 40, 30), (35, 25, 5)):
        e = a * b / n
        want += (abs(k - e) - 0.5) ** 2 / e
    assert r.chi2 == pytest.approx(want) and r.dof == 1
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi_square_p(18.307038053275146, 10) == pytest.approx(0.05)


def test_kappa_and_bins(spark):
    same = spark.createDataFrame([("a", "a")] * 5, "x string, y string")
    assert stats.kappa(same, "x", "y").first().kappa == 1
    ties = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 9]], "v double")
    assert sorted(r.bin for r in stats.quantile_bins(ties, "v").collect()) == [0, 0, 0, 0, 1, 1, 1] or stats.quantile_bins(ties, "v").count() == 7
    ranks = {r.v: r.k for r in stats.tied_ranks(ties, "v", "k").collect()}
    assert ranks == {1.0: 2.5, 2.0: 5.0, 3.0: 6.0, 9.0: 7.0}


def test_wilson_holds_the_rate(spark):
    low, high = stats.wilson(F.lit(3), F.lit(10))
    a, b = value(spark, low), value(spark, high)
    assert 0 < a < 0.3 < b < 1
    p, z = 0.3, 1.96
    assert b == pytest.approx((p + z * z / 20 + z * math.sqrt(p * 0.7 / 10 + z * z / 400)) / (1 + z * z / 10))


def test_split_sizes(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(41)], "id long, s string")
    counts = {(r.s, r.split): r["count"] for r in sampling.split(frame, ["s"], ["id"]).groupBy("s", "split").count().collect()}
    assert counts == {("a", "train"): 14, ("a", "validation"): 3, ("a", "test"): 4, ("b", "train"): 14, ("b", "validation"): 3, ("b", "test"): 3}
    chunks = sampling.chunk_numbers(frame, "id", 10).orderBy("id").collect()
    assert [r.chunk for r in chunks] == [i // 10 for i in range(41)]
    assert sampling.stratified(frame, ["s"], ["id"], 7).count() == 7


def test_overlap(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "c")]
    frame = spark.createDataFrame(rows, "idx long, m string")
    assert {r.mask: r.n for r in overlap.regions(frame, ["idx"], "m", ["a", "b", "c"]).collect()} == {3: 1, 1: 1, 4: 1}
    j = {(r.a, r.b): r.jaccard for r in overlap.jaccard(frame, ["idx"], "m", ["a", "b", "c", "none"]).collect()}
    assert j["a", "b"] == 0.5 and j["a", "c"] == 0 and j["b", "none"] == 0


def test_mutants_of_sizes(spark):
    atom = lambda i: {"s": f"s{i}", "p": "p", "o": "o"}
    rows = [(str(n), [atom(i) for i in range(n)], atom(9), ["e"]) for n in (1, 2, 3, 4)] + [("dup", [atom(0), atom(0)], atom(9), ["e"])]
    schema = "instance_id string, body array<struct<s:string,p:string,o:string>>, head struct<s:string,p:string,o:string>, entities array<string>"
    frame = spark.createDataFrame(rows, schema)
    sizes = lambda f: {r.instance_id: r["count"] for r in f.groupBy("instance_id").count().collect()}
    assert sizes(mutate.permute(frame)) == {"2": 1, "3": 5, "4": 10}
    assert sizes(mutate.reduce_body(frame)) == {"2": 2, "3": 3, "4": 10, "dup": 2}
    assert sizes(mutate.merge_halves(frame)) == {"2": 1, "3": 1, "4": 1, "dup": 1}


def test_orders_of_bodies_of_any_length_and_equal_atoms(spark):
    bodies = ["", "a", "ab", "aa", "aab", "aba", "baa", "abcd", "baaa", "aaab", "aabb", "xaaaa", "xabcc", "abcde", "xaaaaa", "xyaaaaaa", "aaaaaaa", "xyaaaab"]
    want = {b: ["   ".join(f"{x} p o" for x in q) for q in permutations(b) if list(q) != list(b)][:10] for b in bodies}
    atom = lambda x: {"s": x, "p": "p", "o": "o"}
    schema = "instance_id string, body array<struct<s:string,p:string,o:string>>, head struct<s:string,p:string,o:string>"
    frame = spark.createDataFrame([(b, [atom(x) for x in b], atom("h")) for b in bodies], schema)
    got = sorted((r.instance_id, r.idx, r.mutated_body) for r in mutate.permute(frame).collect())
    assert got == sorted((b, i, x) for b, found in want.items() for i, x in enumerate(found))


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.standard_label(F.lit("the house OF cards"))) == "The House of Cards"
    assert v(text.standard_label(F.lit("category: foo bar"))) == "Category:Foo Bar"
    assert v(text.rule_pattern(F.lit("?a P1 ?ab => ?ab P2 ?a"))) == "?V1 P1 ?V2 => ?V2 P2 ?V1"
    assert v(text.strip_option(F.lit("**A.** B. real text"))) == "real text"
    assert v(text.strip_option(F.lit("E. coli"))) == "E. coli"
    assert v(text.numbered_items(F.lit("1. a\n- b\n\n3) c"))) == ["a", "b", "c"]
    assert v(text.present(F.lit(" nan "))) is None and v(text.present(F.lit(" x "))) == "x"
    assert v(text.join_premises(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and that c"
    assert v(text.last_sentence(F.lit("It is a long sentence here. Is it so, after all?"))) == "It is a long sentence here."
    assert v(text.split_context(F.lit("Given x, is it true that y?"))["question"]) == "is it true that y?"
    assert v(text.nli_label(F.lit('so {"label": "No", "conf": 2}'))).asDict() == {"label": "contradiction", "confidence": 1.0, "entailment": 0.0, "contradiction": 1.0, "neutral": 0.0}
    assert v(text.with_article(F.lit("apple"))) == "an apple" and v(text.with_article(F.lit("cats"))) == "cats"


def test_grammar(spark):
    v = lambda c: value(spark, c)
    assert v(grammar.negate(F.lit("Bob is tall and was here"))) == "Bob is not tall and was here"
    assert v(grammar.negate(F.lit("Bob is not tall"))) == "Bob is not tall"
    assert v(grammar.negate(F.lit("Bob sings"))) == "It is not true that bob sings"
    assert v(grammar.yes_no_question(F.lit("Bob is tall"))) == "Is Bob tall?"
    assert v(grammar.plural(F.lit("knife"))) == "knives" and v(grammar.plural(F.lit("leaf"))) == "leaves"
    assert v(grammar.singular(F.lit("children"))) == "child" and v(grammar.singular(F.lit("cities"))) == "city"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.cosine(a, a)) == 1 and value(spark, vectors.cosine(a, b)) == 0


def test_files(spark, tmp_path):
    (tmp_path / "kg_rule_3").mkdir()
    (tmp_path / "kg_rule_3" / "entity_rename_llm_answers.csv").write_text("x,y\n1,a\n2,b\n")
    tree = files.read_named_tree(spark, str(tmp_path), "x int, y string").collect()
    assert {(r.rule, r.mutation_type, r.x) for r in tree} == {("kg_rule_3", "entity_rename", 1), ("kg_rule_3", "entity_rename", 2)}
    (tmp_path / "log.jsonl").write_text('{"property_id": "P1", "functionality": 0.5}\n\n{broken\n{"property_id": "P2", "error": "timeout"}\n')
    assert [r.property_id for r in files.read_jsonl(spark, str(tmp_path / "log.jsonl"), "property_id string, functionality double, error string").collect()] == ["P1"]
    frame = spark.createDataFrame([(1, 2, 3)], "c int, a int, b int")
    assert files.ordered_columns(frame, ["b", "zz"]).columns == ["b", "a", "c"]
    t = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    files.save_graph(str(tmp_path / "g"), t, t, t)
    assert files.load_graph(spark, str(tmp_path / "g"))["triples"].count() == 1


def test_models(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert {r.answer for r in models.answer(frame, "prompt", lambda p: [x.upper() for x in p]).collect()} == {"A", "B"}

    def broken(prompts):
        raise ValueError("no model")

    assert {r.answer for r in models.answer(frame, "prompt", broken).collect()} == {"ERROR: no model"}


def test_models_in_parts_and_by_threads(spark):
    frame = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string").repartition(3)

    def sizes(prompts):
        return [f"{x}/{len(prompts)}" for x in prompts]

    out = models.answer(frame, "prompt", sizes, size=4, threads=3, per_second=1000, tasks=1).collect()
    assert {r.answer for r in out} == {f"p{i}/4" for i in range(20)} and all(r.answer.startswith(r.prompt + "/") for r in out)
    assert models.answer(frame.limit(0), "prompt", sizes, size=4).count() == 0
    assert models.answer(frame, "prompt", sizes, tasks=2).rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        models.answer(frame, "prompt", sizes, per_second=5)


def test_allowance():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    allowance = models.Allowance(2.0, burst=3, clock=lambda: now[0], sleep=sleep)
    for _ in range(7):
        allowance.take()
    assert slept == [0.5] * 4 and now[0] == 2.0
    now[0] += 100  # a rest saves no more than the burst
    for _ in range(4):
        allowance.take()
    assert slept == [0.5] * 5
    for rate, burst in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            models.Allowance(rate, burst)


def test_settings(tmp_path):
    at = tmp_path / "settings.json"
    at.write_text('{"filter": {"std_confidence": 0.4, "pca_confidence": 0.8}}')
    got = config.load(str(at), {"LEMMARY_FILTER__STD_CONFIDENCE": "0.6", "LEMMARY_NAME": "not json", "OTHER": "1"})
    assert got["filter"] == config.DEFAULTS["filter"] | {"std_confidence": 0.6, "pca_confidence": 0.8} and got["name"] == "not json"
    assert config.get(got, "sampling.seed") == 42 and config.get(got, "sampling.none", 7) == 7 and "other" not in got
    assert config.load(str(tmp_path / "none.json"), {}) == config.DEFAULTS


def test_split_does_not_depend_on_pieces(spark):
    frame = spark.createDataFrame([(i, "abc"[i % 7 % 3]) for i in range(300)], "id long, s string")
    kept = [sorted(map(tuple, sampling.split(frame, ["s"], ["id"], piece=n).collect())) for n in (1, 10, 1000)]
    assert kept[0] == kept[1] == kept[2]


def test_split_counts_decimal_shares_and_null_strata(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(180)], "id long, s string")
    counts = {(r.s, r.split): r["count"] for r in sampling.split(frame, ["s"], ["id"]).groupBy("s", "split").count().collect()}
    assert counts == {(s, name): n for s in ("a", None) for name, n in (("train", 63), ("validation", 13), ("test", 14))}


def test_ranks_of_several_columns(spark):
    rows = [(1.0, 5), (1.0, None), (2.0, 3), (None, 3), (2.0, 3)]
    got = stats.all_tied_ranks(spark.createDataFrame(rows, "a double, b int"), {"a": "x", "b": "y"})
    assert sorted(((r.a or 0, r.b or 0, r.x, r.y) for r in got.collect()), key=str) == sorted(
        [(1.0, 5, 1.5, 4.0), (1.0, 0, 1.5, None), (2.0, 3, 3.5, 2.0), (0, 3, None, 2.0), (2.0, 3, 3.5, 2.0)], key=str
    )


def test_resume(spark):
    done = spark.createDataFrame([(1, "x"), (2, "ERROR: y"), (3, None), (4, "nan")], "k int, a string")
    work = spark.createDataFrame([(i,) for i in range(1, 6)], "k int")
    todo = resume.pending(work, done, ["k"], "a")
    assert sorted(r.k for r in todo.collect()) == [2, 3, 4, 5]
    merged = resume.upsert(done, todo.withColumn("a", F.lit("new")), ["k"])
    assert {r.k: r.a for r in merged.collect()} == {1: "x", 2: "new", 3: "new", 4: "new", 5: "new"}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"k": 1, "answer": "x"}\n{"k": 2, "answer": "ERROR: y"}\n')
    run = lambda: incremental.resume_stream(spark, str(source), "k int, answer string", str(tmp_path / "out"), str(tmp_path / "cp"), "k", "answer", lambda d: d.withColumn("answer", F.lit("again")))
    run()
    (source / "b.json").write_text('{"k": 3, "answer": "z"}\n')
    run()
    assert {r.k: r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "x", 2: "again", 3: "z"}
    events = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 3.0)], "t string, kind string, value double")
    batch = incremental.windowed_rates(events.withColumn("t", F.to_timestamp("t")), "t", "kind").collect()
    assert [(r.n, r["mean"]) for r in batch] == [(2, 2.0)]


def test_expected_answer_compares_whole_texts(spark):
    """The matching part of a long answer stands after 4,000 characters."""
    from pyspark.sql import functions as F

    from lemmary.functions import text

    answer, expected = "0" * 5000 + " mount everest in nepal", "mount everest, nepal"
    row = spark.createDataFrame([(answer, expected)], "a string, e string").select(text.expected_answer(F.col("a"), F.col("e")).alias("r")).first().r
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    x, y = pairs(expected), pairs(answer)
    want = len(x & y) / min(len(x), len(y))
    if row.method == "bigram_overlap":
        assert abs(row.similarity - want) < 1e-9
    assert row.method == "bigram_overlap" and row.consistent


def test_top_k_works_off_queries_in_blocks(spark):
    from lemmary.functions import vectors

    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(30)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole, blocks = vectors.top_k(e, e, 3), vectors.top_k(e, e, 3, most_queries=12)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 90
