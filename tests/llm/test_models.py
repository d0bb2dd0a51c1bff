import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lemmary.llm import brown_lm, chaining, toxicity
from lemmary.llm.common import fold_of, text_of


def test_language_model_base(odd, odd_rows, empty):
    held = fold_of("doc_id", 7) == 2
    model = brown_lm.train(odd.filter(~held).select(text_of().alias("t")), classes=6)
    rows = brown_lm.score(odd, model).collect()
    counts = Counter()
    for d, t in odd_rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in odd_rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((d is None, d or 0, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)
    assert all(r.score < 0 for r in rows)
    blank = brown_lm.score(odd, brown_lm.train(empty.select(text_of().alias("t")))).collect()
    assert all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in blank)


def plain_model(model, texts, weight=0.98, pull=20.0):
    """P(word | word before) from the model's classes alone: every count is made again here."""
    index = brown_lm.TypeIndex(model.words, model.endings)
    class_of = lambda w: int(model.classes[index[w]])
    counts, moves = Counter(), Counter()
    for t in texts:
        own = [b"", *brown_lm.words_of(t), b""]
        counts.update(own[1:])
        moves.update(zip(map(class_of, own), map(class_of, own[1:])))
    n, v, size = sum(counts.values()), len(counts), model.log_factor.shape[0]
    class_n, class_v, out_of = Counter(), Counter(), Counter()
    for w, k in counts.items():
        class_n[class_of(w)] += k
        class_v[class_of(w)] += 1
    for (a, _), k in moves.items():
        out_of[a] += k
    unseen = {int(c) for c in model.classes[1 + len(model.words) :]}

    def p(before, w):
        a, c = class_of(before), class_of(w)
        step = (moves[a, c] + pull * (class_n[c] + 1) / (n + size)) / (out_of[a] + pull)
        return (counts[w] + 1) * (weight * step / (class_n[c] + class_v[c] + (c in unseen)) + (1 - weight) / (n + v + len(unseen)))

    return p, counts, unseen


def lm_texts(rng, n):
    stems = ["red", "blue", "car", "house", "walk", "talk", "bright"]
    word = lambda: rng.choice(stems) + rng.choice(["", "s", "ing", "ed", "x" * 70, str(rng.randrange(9))])
    return [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(n)]


def test_score_is_that_of_a_plain_model(spark):
    """With words clustered on the driver, words moved in parallel, and words beyond the head."""
    rng = random.Random(3)
    texts, fresh = lm_texts(rng, 150), lm_texts(rng, 20) + ["never seen " + "z" * 90, "", "x" * 70]
    model = brown_lm.train(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), classes=5, head_words=30, first_words=8)
    assert 8 < len(model.words) <= 30
    p, counts, _ = plain_model(model, texts)
    assert len(counts) > len(model.words) + 1
    rows = {r.doc_id: r for r in brown_lm.score(spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(fresh):
        own = [b"", *brown_lm.words_of(t), b""]
        assert math.isclose(rows[i].score, sum(math.log10(p(a, b)) for a, b in zip(own, own[1:], strict=False)), rel_tol=1e-9)
        assert rows[i].n_known == sum(counts[w] > 0 for w in own[1:])


def test_language_model_is_a_distribution(spark):
    """After any word, the probabilities of all known words and of an unknown one of each class that has any sum to one."""
    rng = random.Random(5)
    texts = lm_texts(rng, 120)
    model = brown_lm.train(spark.createDataFrame([(t,) for t in texts], "t string"), classes=6, head_words=25, first_words=6)
    index = brown_lm.TypeIndex(model.words, model.endings)
    classes = model.classes.tolist()
    unknown = set(classes[1 + len(model.words) :])
    known = [(r.n, classes[index[bytes(r.word)]]) for r in model.vocabulary.collect()]
    for before in range(model.log_factor.shape[0]):
        p = 10 ** model.log_factor[before]
        assert math.isclose(sum((n + 1) * p[c] for n, c in known) + sum(p[c] for c in unknown), 1, rel_tol=1e-9)


def test_words_move_to_the_best_class():
    """The move of one word agrees with the likelihood of class bigrams, computed from scratch."""
    rng = np.random.default_rng(4)
    pairs = rng.poisson(2.0, (12, 12)).astype(float)
    np.fill_diagonal(pairs, 0)
    label = np.array([0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2])

    def likelihood(label):
        m = np.array([[pairs[label == a][:, label == b].sum() for b in range(4)] for a in range(4)])
        x = brown_lm._xlogx
        return x(m).sum() - x(m.sum(1)).sum() - x(m.sum(0)).sum()

    one = np.eye(4)[label]
    for w in range(1, 12):
        others = np.array([likelihood(np.where(np.arange(12) == w, c, label)) for c in range(1, 4)])
        got = brown_lm.best_class(one.T @ pairs @ one, int(label[w]), pairs[:, w] @ one, pairs[w] @ one)
        assert math.isclose(others[got - 1], others.max())


def test_language_model_learns_order(spark):
    rng = random.Random(1)
    a, b = ["red", "blue", "green"], ["car", "house", "tree"]
    text = lambda: " ".join(rng.choice(a) + " " + rng.choice(b) for _ in range(30))
    train = spark.createDataFrame([(text(),) for _ in range(100)], "t string")
    model = brown_lm.train(train, classes=4)
    docs = spark.createDataFrame([(0, text()), (1, " ".join(rng.choice(a) for _ in range(60)))], "doc_id long, text string")
    good, bad = sorted(brown_lm.score(docs, model).collect(), key=lambda r: r.doc_id)
    assert good.score > good.base_score and bad.score < good.score
    index = brown_lm.TypeIndex(model.words, model.endings)
    kinds = [{int(model.classes[index[w.encode()]]) for w in g} for g in (a, b)]
    assert not kinds[0] & kinds[1]


def toy(rng, n, bad):
    words = [f"w{rng.randrange(400)}" for _ in range(n)]
    if bad:
        words[rng.randrange(n)] = rng.choice(["vileness", "vilest", "rotten"])
    return " ".join(words)


def test_toxicity(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, toy(rng, rng.randrange(5, 120), i % 4 == 0), "en" if i % 3 else "de") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_documents(docs, model).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in held]
    assert sum(right) / len(right) > 0.97
    assert sum(r.toxic_by_lang == (r.doc_id % 4 == 0) for r in out) / len(out) > 0.97
    strange = toxicity.score_documents(odd, model)
    assert strange.columns == [*odd.columns, "toxicity", "toxic_by_lang"]
    assert all(0 <= r.toxicity <= 1 for r in strange.collect()) and strange.count() == odd.count()
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.toxicity < 1e-6 for r in toxicity.score_documents(docs, none).collect())


def test_score_is_batch_free():
    rng = random.Random(8)
    texts = [toy(rng, rng.randrange(1, 60), i % 3 == 0) for i in range(90)]
    model = toxicity.train_model(texts, [int(i % 3 == 0) for i in range(90)], epochs=2)
    one = [float(toxicity.Scorer(model).score([t])[0]) for t in texts]
    assert np.allclose(toxicity.Scorer(model).score(texts), one, atol=1e-6)


def plain_score(model, text):
    """The classifier's formula word by word."""
    words = toxicity.WORD.findall(text.lower())
    table = [sum((model.tables[0][h % 2**15] + model.tables[1][(h >> 15) % 2**15] for h in toxicity.word_features(w) if h and model.is_known(np.array([h], np.uint64))[0]), np.zeros(model.tables.shape[2])) for w in words]
    table += [np.zeros(model.tables.shape[2])] * toxicity.PAD
    z = model.out_bias
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(model.bias.shape[1]):
            top = max([0.0, *[sum(float(table[i + j] @ model.filters[k][j][:, f]) for j in range(width)) for i in range(len(words))]])
            z += max(0.0, top + model.bias[k, f]) * model.out[k * model.bias.shape[1] + f]
    return 1 / (1 + math.exp(-z))


def toy_model(rng, epochs=3):
    texts = [toy(rng, rng.randrange(1, 40), i % 3 == 0) for i in range(90)]
    return texts, toxicity.train_model(texts, [int(i % 3 == 0) for i in range(90)], epochs=epochs)


def test_scorer_is_the_formula():
    texts, model = toy_model(random.Random(8))
    texts += ["", "unseen words only", "w1"]
    got = toxicity.Scorer(model).score(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)
    assert len(set(np.round(got, 3))) > 10


def test_gradient_is_that_of_the_loss():
    """Derivatives by central differences, in double precision."""
    texts, model = toy_model(random.Random(9), epochs=2)
    model.tables, model.bias, model.out = (x.astype(np.float64) for x in (model.tables, model.bias, model.out))
    model.filters = [w.astype(np.float64) for w in model.filters]
    model.embed = lambda hashes: sum(
        model.is_known(own)[:, None] * (model.tables[0][own & np.uint64(2**15 - 1)] + model.tables[1][(own >> np.uint64(15)) & np.uint64(2**15 - 1)]) for own in hashes.T
    )
    model.taps = lambda e: [[e @ w[j] for j in range(len(w))] for w in model.filters]
    index = {"": 0}
    docs = [[index.setdefault(w, len(index)) for w in t.split()] for t in texts[:6]]
    hashes = toxicity.features_of(list(index))
    flat = np.concatenate([[*d, *[0] * toxicity.PAD] for d in docs]).astype(np.int64)
    starts = np.cumsum([0, *[len(d) + toxicity.PAD for d in docs[:-1]]])
    y = np.array([1, 0, 0, 1, 0, 0], float)
    _, grads, d_bias = toxicity.gradient(model, flat, starts, y, hashes)
    loss = lambda: toxicity.gradient(model, flat, starts, y, hashes)[0]
    rng = np.random.default_rng(1)
    for p, g in zip((model.tables, *model.filters, model.bias, model.out), grads, strict=True):
        some = np.argwhere(np.abs(g) > 1e-7)
        for at in map(tuple, some[rng.choice(len(some), min(12, len(some)), replace=False)]):
            keep, sides = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = keep + step
                sides.append(loss())
            p[at] = keep
            assert math.isclose((sides[0] - sides[1]) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-7)
    model.out_bias += 1e-5
    up = loss()
    model.out_bias -= 2e-5
    assert math.isclose((up - loss()) / 2e-5, d_bias, rel_tol=1e-4)


def test_toxicity_on_odd_tables(spark):
    """String ids, repeated ids, columns named like those that are added, no rows."""
    rng = random.Random(8)
    rows = [(f"d{i % 200}", toy(rng, 20, i % 4 == 0), "en", 7.0, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, toxicity double, row string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(200)], "doc_id string, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_documents(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "row", "toxicity", "toxic_by_lang"] and out.count() == 400
    again = toxicity.fit(docs.repartition(7), labels.repartition(5))
    assert np.array_equal(model.tables, again.tables)
    none = toxicity.fit(docs.limit(0), labels)
    assert all(r.toxicity < 1e-6 for r in toxicity.score_documents(docs, none).collect())


def test_the_text_travels_once(spark):
    model = toxicity.train_model(["bad awful words"] * 4 + ["good fine words"] * 4, [1] * 4 + [0] * 4)
    rows = [(i, t) for i, t in enumerate([None, "", "bad awful words", "good fine words"] * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    scored = toxicity.score_documents(docs, model)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS text" in plan
    found = {r.doc_id: (r.text, r.toxicity) for r in scored.collect()}
    plain = dict(zip([r[0] for r in rows], toxicity.Scorer(model).score([r[1] or "" for r in rows]), strict=True))
    assert all(found[i][0] == t and abs(found[i][1] - plain[i]) < 1e-6 for i, t in rows)
    binary = toxicity.score_documents(docs.select("doc_id", docs.text.cast("binary").alias("text")), model).collect()
    assert all(abs(r.toxicity - plain[r.doc_id]) < 1e-6 for r in binary)


def test_every_labelled_row_is_trained_on(spark, monkeypatch):
    """6,400 labelled rows, eight for each word: whatever word three rows of training hold is known, in one block and in many."""
    docs = spark.createDataFrame([(i, f"w{i // 8} " + ("bad" if i % 16 == 0 else "good")) for i in range(6400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 16 == 0).cast("int").alias("toxic"))
    rows = docs.filter((fold_of("doc_id", 5) != 0) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) != 0)).select((F.col("doc_id") / 8).cast("int").alias("w"))
    want = {r.w: r["count"] >= 3 for r in rows.groupBy("w").count().collect()}
    monkeypatch.setattr(toxicity, "EPOCHS", 6)
    models = []
    for block, parts in ((8192, 3), (700, 3), (700, 5)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        model = toxicity.fit(docs.repartition(parts), labels)
        hashes = np.array([toxicity.word_hash(f"w{w}") for w in want], np.uint64)
        assert [bool(k) for k in model.is_known(hashes)] == list(want.values())
        scores = toxicity.Scorer(model).score(["w1 bad", "w1 good", "bad", "good"])
        assert min(scores[::2]) > 0.5 > max(scores[1::2])
        models.append(model)
    assert np.array_equal(models[1].tables, models[2].tables) and models[1].out_bias == models[2].out_bias and models[1].threshold == models[2].threshold


def brute_chain(x, y, k):
    score = []
    for i in range(len(x)):
        s = k
        for j in range(i):
            if x[j] < x[i] and y[j] < y[i]:
                s = max(s, score[j] - chaining.GAP_COST * (x[i] - x[j] + y[i] - y[j]) + min(k, x[i] - x[j], y[i] - y[j]))
        score.append(s)
    return max(score)


def chain_score(x, y, c, k):
    steps = [(x[b] - x[a], y[b] - y[a]) for a, b in zip(c, c[1:], strict=False)]
    return k + sum(min(k, dx, dy) - chaining.GAP_COST * (dx + dy) for dx, dy in steps)


def test_chain_is_the_best():
    rng = random.Random(6)
    for n in range(800):
        wide = rng.choice([12, 30, 60, 200])
        points = sorted({(rng.randrange(wide), rng.randrange(wide)) for _ in range(rng.randrange(2, 40))}, key=lambda p: (p[0], -p[1]))
        if n % 3 == 0:  # runs along diagonals, as repeats give them
            points = sorted({(a + i, b + i) for a, b in points for i in range(rng.randrange(1, 6))}, key=lambda p: (p[0], -p[1]))
        x, y = [p[0] for p in points], [p[1] for p in points]
        for k in (2, 4, 5):
            found = chaining.chains(x, y, k, least=1)
            flat = sorted(i for c in found for i in c)
            assert flat == list(range(len(x)))
            for c in found:
                assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
            assert math.isclose(chain_score(x, y, found[0], k), brute_chain(x, y, k))


def test_changed_passages_are_found(spark):
    """Pairs of texts that share a passage with changed words: of 60 words at 0.85 or 0.9, of 80 and 120 at 0.8."""
    rng = random.Random(14)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows, kinds = [], []
    for kind, (n, changed) in enumerate([(60, 6), (60, 9), (80, 8), (80, 16), (120, 24)]):
        for _ in range(40):
            p = some(n)
            q = list(p)
            for j in rng.sample(range(1, n - 1), changed):
                q[j] = some(1)[0]
            rows += [" ".join(some(90) + p + some(40)), " ".join(some(30) + q + some(100))]
            kinds.append(kind)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {(r.doc_id // 2, r.other_id // 2) for r in chaining.repeated_passages(docs).collect()}
    assert all(a == b for a, b in out)
    for kind in range(5):
        own = [i for i, k in enumerate(kinds) if k == kind]
        assert sum((i, i) in out for i in own) >= 0.9 * len(own), kind


def brute_shared(texts, n):
    """Pairs of different texts that share a run of n words, by comparing every run."""
    runs = {}
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            runs.setdefault(" ".join(w[i : i + n]), set()).add(d)
    return {frozenset(p) for ids in runs.values() for p in [sorted(ids)] if len(p) > 1 for p in itertools.combinations(p, 2)}


def test_shared_runs_by_brute_force(spark):
    """Texts of pieces from a small stock: whoever shares 50 words is reported and connected to all that share them; nobody else is."""
    rng = random.Random(23)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    stock = [some(n) for n in (72, 72, 60, 55, 30, 30, 25, 12) for _ in range(2)]
    stock += [stock[0][:34], stock[0][38:], stock[0][19:53], stock[1][:30], stock[1][30:60], stock[2][5:40]]
    texts = []
    for d in range(120):
        words = some(rng.randrange(0, 12))
        for piece in rng.sample(stock, 2):
            words += piece + some(rng.randrange(20, 40))
        texts.append((d, " ".join(words)))
    out = chaining.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    want = brute_shared(texts, 50)
    touched = {d for p in want for d in p}
    exact = [r for r in out if r.identity == 1]
    assert {r.doc_id for r in exact} | {r.other_id for r in exact} >= touched
    joined = union((r.doc_id, r.other_id) for r in out)
    assert all(joined(a) == joined(b) for a, b in want)
    words = dict(texts)
    for r in out:  # what is reported is there
        a, b = words[r.doc_id].split()[r.start : r.end], words[r.other_id].split()[r.other_start : r.other_end]
        assert max(len(a), len(b)) == r.words >= 50 and r.identity >= 0.8
        if r.identity == 1:
            assert a == b


def union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return find


def test_fragments_do_not_hide_a_pair(spark):
    """Two texts share 72 words; five earlier texts each hold 34 of them."""
    rng = random.Random(3)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    p = some(72)
    texts = [some(60) + p[a : a + 34] + some(60) for a in (0, 10, 19, 28, 38)] + [some(30) + p + some(50), some(80) + p + some(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    out = [(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.identity) for r in chaining.repeated_passages(docs).collect()]
    assert out == [(6, 5, 80, 152, 30, 1.0)]


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    passage, rows, spans = text(60), [], {}
    for i in range(40):
        body = text(rng.randrange(80, 400))
        if i % 4 == 0:
            own = list(passage)
            if i % 8 == 0 and i:
                for j in rng.sample(range(60), 3):
                    own[j] = word()
            at = rng.randrange(len(body))
            body[at:at] = own
            spans[i] = (at, at + 60)
        rows.append((i, " ".join(body)))
    rows += [(100, rows[1][1]), (101, rows[1][1]), (102, "la " * 90), (103, "x " + "la " * 70), (104, None), (105, "")]
    out = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    passages = [r for r in out if r.kind == "passage"]
    touched = {r.doc_id for r in passages} | {r.other_id for r in passages}
    assert touched == set(spans) | {102, 103}
    for r in passages:
        if r.doc_id in spans:
            a, b = spans[r.doc_id]
            assert abs(r.start - a) <= 6 and abs(r.end - b) <= 6 and r.identity >= 0.8
    assert {(r.doc_id, r.other_id) for r in out if r.kind == "copy"} == {(100, 1), (101, 1)}
    assert chaining.repeated_passages(empty).count() == 0
    assert {r.kind for r in chaining.repeated_passages(odd).collect()} <= {"copy", "passage"}


def test_minimizer_window():
    rng = random.Random(2)
    words = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    seeds, at = chaining.minimizers(words)
    assert all(b - a <= chaining.WINDOW for a, b in zip(at, at[1:], strict=False))
    inner, where = chaining.minimizers(words[100:120])
    assert set(inner.tolist()) & set(seeds.tolist()) and len(where)


def test_passage_whose_parts_stand_in_earlier_texts(spark):
    """Each row: texts with parts of a passage come first, B and C hold all of it (A part alone is too short to report)."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    rows, pairs = [], []
    for i in range(30):
        p = some(60)
        parts = [p[:33], p[27:]] if i % 2 else [p[:20], p[20:40], p[40:]]
        texts = [some(80) + x + some(80) for x in parts] + [some(40) + p + some(70), some(90) + p + some(30)]
        if i % 3 == 0:  # a line of the passage stands in C before
            texts[-1] = p[5:20] + some(9) + texts[-1]
        ids = [100 * i + j for j in range(len(texts))]
        rows += [(d, " ".join(t)) for d, t in zip(ids, texts, strict=True)]
        pairs.append((ids[-1], ids[-2], len(texts[-1]) - 30 - 60, 40))
    out = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    found = {(r.doc_id, r.other_id, r.start, r.other_start) for r in out if r.words == 60 and r.identity == 1}
    assert found == set(pairs) and len(out) == len(pairs)


def brute_alike(a, b, n=50, identity=0.8):
    """Whether some n or more words of a, moved along, equal those of b in a share of ``identity``."""
    for shift in range(n - len(b), len(a) - n + 1):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        gain = np.r_[0, np.cumsum((np.array(a[lo:hi]) == np.array(b[lo - shift : hi - shift])) - identity)]
        low = np.minimum.accumulate(gain)
        if (gain[n:] >= low[: len(gain) - n] - 1e-9).any():
            return True
    return False


def test_no_pair_is_lost_between_many_holders(spark):
    """Texts with changed passages whose parts stand in 70 and in 20 other texts: all pairs, as brute force has them."""
    rng = random.Random(31)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    texts = []
    for copies, changed in ((70, 4), (20, 5)):
        p = some(64)
        for _ in range(copies):
            texts += [some(12) + p[:33] + some(12), some(12) + p[31:] + some(12)]
        for _ in range(6):
            q = list(p)
            for j in rng.sample(range(64), changed):
                q[j] = some(1)[0]
            texts.append(some(15) + q + some(15))
    want = {(i, j) for i in range(len(texts)) for j in range(i) if set(texts[i]) & set(texts[j]) and brute_alike(texts[i], texts[j])}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(max(r.doc_id, r.other_id), min(r.doc_id, r.other_id)) for r in chaining.repeated_passages(docs).collect()}
    assert got == want and len(want) >= 30


def test_dense_places_by_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        x = np.array(sorted(rng.sample(range(150), rng.randrange(0, 40))), np.int64)
        want = np.zeros(len(x), bool)
        for i in range(len(x)):
            for j in range(i, len(x)):
                if j - i + 1 >= max(7, 0.2 * (x[j] - x[i] + 4) - 3 - 1e-9):
                    want[i : j + 1] = True
        assert chaining.dense(x, 50, 0.8).tolist() == want.tolist()


def test_run_hashes():
    words = np.random.default_rng(5).integers(0, 1 << 32, 200).astype(np.uint32)
    for run in (1, 2, 7, 50):
        h = chaining.run_hashes(words, run)
        assert len(h) == 201 - run and len(set(h.tolist())) == len(h)
        assert np.array_equal(chaining.run_hashes(words[30:120], run), h[30 : 121 - run])
    assert len(chaining.run_hashes(words[:9], 10)) == 0


def test_word_hashes_and_seeds_by_plain_loops():
    rng = np.random.default_rng(8)
    pool = ["a", "B", "bc", "Straße", "x" * 300, "ß", "İ", "naïve", "bb", "cb"]
    gaps = [" ", "\n", "\t\x0b", "  ", " ", "\x1c"]
    texts = ["".join(str(rng.choice(pool)) + str(rng.choice(gaps)) for _ in range(int(rng.integers(0, 60)))) for _ in range(80)] + ["", " ", "a", "a b c"]
    column = pa.array(["head", *texts]).slice(1)
    plain = [[w.decode() for w in t.encode().lower().split()] for t in texts]
    hashes, sizes = [], []
    for data, ends in chaining.text_blocks(column):
        h, n = chaining.word_hashes(data, ends)
        hashes.append(h)
        sizes.append(n)
    words, sizes = np.concatenate(hashes), np.concatenate(sizes)
    assert sizes.tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, words.tolist(), strict=True))) == len(set(flat)) == len(set(words.tolist()))
    seeds, places, count, again, held = chaining.numbered_minimizers(words, sizes)
    at = np.cumsum(held) - held
    where = np.cumsum(sizes) - sizes
    for i, n in enumerate(sizes.tolist()):
        w = words[where[i] : where[i] + n]
        kmers = [tuple(w[j : j + chaining.K].tolist()) for j in range(n - chaining.K + 1)]
        mine = places[at[i] : at[i] + held[i]].tolist()
        # The seed of a place is its k-mer's: the same k-mer, the same number but for its count.
        assert [kmers[p] for p in mine] == [kmers[p] for p in sorted(mine)]
        alone = chaining.numbered_minimizers(w, np.array([n]))
        for whole, own in zip((seeds, places, count, again), alone, strict=False):
            assert whole[at[i] : at[i] + held[i]].tolist() == own.tolist()
        for lo in range(max(len(kmers) - chaining.WINDOW + 1, 0)):
            assert any(lo <= p < lo + chaining.WINDOW for p in mine)
        seen: dict[tuple[int, ...], int] = {}
        for j, p in enumerate(mine):
            assert count[at[i] + j] == seen.get(kmers[p], 0)
            seen[kmers[p]] = seen.get(kmers[p], 0) + 1
        assert [bool(a) for a in again[at[i] : at[i] + held[i]]] == [seen[kmers[p]] > 1 for p in mine]


def test_long_texts_are_hashed_in_parts():
    words = [f"w{i % 5000}" for i in range(300_000)]
    words[1000] = "y" * (3 << 20)  # longer than a block by itself
    text = " ".join(words).encode()
    h, n = chaining.word_hashes(np.frombuffer(text, np.uint8), np.array([len(text)]))
    assert n.tolist() == [len(words)] and len(set(h.tolist())) == 5001
    assert h[0] == h[5000] and h[999] == h[5999] and h[1001] == h[6001]
