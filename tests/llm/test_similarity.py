import hashlib
import os
import random

import numpy as np
import pytest
import xxhash

from lemmary.llm import prefix_hash as ph
from lemmary.llm import simhash
from lemmary.llm.common import components, made, release, written


def brute_fingerprint(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_groups(odd, odd_rows, empty):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(odd_rows)
    texts = {(d, f"{brute_fingerprint(t):016x}") for d, t in odd_rows}
    assert {(r.doc_id, r.fingerprint) for r in rows} == texts
    prints = [brute_fingerprint(t) for _, t in odd_rows]
    groups = brute_components(prints, 2)
    low = {}
    for g, (d, _) in zip(groups, odd_rows, strict=True):
        if d is not None:
            low[g] = min(low.get(g, d), d)
    want = {(d, f"{p:016x}", low.get(g)) for (d, _), p, g in zip(odd_rows, prints, groups, strict=True)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == want
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("most", [4, simhash.BUCKET_LIMIT])
def test_links_lose_nothing(spark, most):
    """Dense clusters in few buckets; a limit of 4 sends them through the path for hot buckets."""
    rng = random.Random(9)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    label = {r.node: r.label for r in components(simhash.links(frame, most=most)).collect()}
    groups = brute_components(prints, 2)
    want = {}
    for g, s in zip(groups, signed, strict=True):
        want.setdefault(g, set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(label.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_dense_groups_below_the_similarity(spark, monkeypatch):
    """Copies of one text with a few changed words each: all are near, only some are at 0.8. Small keys are parted as large ones are."""
    rng = random.Random(19)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, rows = some(90), []
    for _ in range(150):
        own = list(base)
        for i in rng.sample(range(90), rng.randrange(1, 9)):
            own[i] = some(1)[0]
        rows.append(" ".join(own))
    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(rows))]
    assert 20 < len(set(want)) < 140
    for most in (simhash.BUCKET_LIMIT, 16):
        monkeypatch.setattr(simhash.parted, "__defaults__", (most,))
        out = simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)).collect()
        group = {r.doc_id: r.group for r in out}
        first = {}
        for i, g in sorted(group.items()):
            first.setdefault(g, i)
        assert [first[group[i]] for i in range(len(rows))] == want


def test_parted_keys_lose_no_pair(spark):
    rows = [(1, i, 40) for i in range(40)] + [(2, i, 3) for i in range(3)] + [(3, 7, 1)]
    met = simhash.parted(spark.createDataFrame(rows, "key long, id long, n long"), 8).collect()
    by_key = {}
    for r in met:
        by_key.setdefault(r.key, set()).add(r.id)
    pairs = {(a, b) for own in by_key.values() for a in own for b in own if a < b}
    assert pairs == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert max(len(own) for own in by_key.values()) <= 16


def test_release_keeps_what_is_read(spark):
    first = written(spark.range(5), "first")
    before = made()
    one, two = written(spark.range(7), "one"), written(spark.range(9), "two")
    folder = os.path.dirname(one.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    assert release(spark, [p for p in made() if p not in before], keep=two) == 1
    assert two.count() == 9 and first.count() == 5 and not os.path.exists(folder)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(7, 7)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_near_copies(spark, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(300)]
        texts.append(" ".join(base))
        close = list(base)
        for i in rng.sample(range(300), 4):
            close[i] = word()
        texts.append(" ".join(close))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "alone", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = {r.doc_id for r in simhash.keep_one_of_near(docs).collect()}
    for i in range(0, 120, 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        assert len(a & b) / len(a | b) >= 0.8
        assert (i in kept) + (i + 1 in kept) == 1
    assert {900, 901, 902} <= kept
    assert simhash.keep_one_of_near(empty).count() == 0


def test_prefix_spans():
    rng = random.Random(5)
    text = "".join(rng.choice("abc é\U0001f600") for _ in range(500))
    a, b = ph.PrefixHash(text), ph.PrefixHash(text[100:400] + "zz" + text[:50])
    for _ in range(200):
        i, j, n = rng.randrange(500), rng.randrange(350), rng.randrange(60)
        other = text[100:400] + "zz" + text[:50]
        if i + n <= 500 and j + n <= len(other):
            assert ph.span_equal(a, i, b, j, n) == (text[i : i + n] == other[j : j + n])
    assert ph.longest_common_extension(a, 100, b, 0) == 300
    assert a.spans(12)[7] == a.span(7, 19)


def test_fingerprint_by_plain_loops():
    """Every part of a fingerprint from sums and powers of plain integers."""
    p, rng = 2**31 - 1, random.Random(6)
    mix = lambda x: ((x * 0x9E3779B97F4A7C15 % 2**64) ^ (x * 0x9E3779B97F4A7C15 % 2**64 >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
    for n in (0, 1, 5, 11, 12, 13, 40, 400):
        text = "".join(rng.choice("abcdé 😀") for _ in range(n))
        whole = lambda t, base: sum((ord(c) + 1) * pow(base, i, p) for i, c in enumerate(t)) % p
        if not text:
            assert ph.fingerprint(text) == "0---"
            continue
        w = min(ph.SPAN, n)
        low = {}
        for i in range(n - w + 1):
            x = mix(whole(text[i : i + w], ph.BASES[0]))
            low[x >> 58] = min(low.get(x >> 58, 2**64), x & (2**58 - 1))
        sketch = "".join(f"{low[c] & 0xFFFF:04x}" if c in low else "...." for c in range(ph.CLASSES))
        places, k = [], 0
        while int(2 ** (k / 4)) <= n:
            places.append(int(2 ** (k / 4)))
            k += 1
        grid = "".join(f"{whole(text[:i], ph.BASES[0]) & 0xFFFFFF:06x}" for i in sorted(set(places)))
        assert ph.fingerprint(text) == f"{n:x}-{whole(text, ph.BASES[0]):08x}{whole(text, ph.BASES[1]):08x}-{sketch}-{grid}"


def test_likeness_follows_what_is_shared():
    rng = random.Random(16)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    near = lambda a, b: ph.likeness(ph.fingerprint(a), ph.fingerprint(b))
    for _ in range(30):
        a, b = text(3000), text(3000)
        assert near(a, a) == 1 and near(a, b) < 0.1 and near(a, "") == 0 and near("", "") == 1
        assert near(a, a[:1500] + "inserted" + a[1500:]) > 0.85
        assert near(a, a[1500:] + a[:1500]) > 0.85  # halves swapped
        assert 0.55 < near(a, a[:2000] + text(1000)) < 0.8  # the common beginning
        assert 0.15 < near(a, text(1500) + a[1500:]) < 0.55  # half of the spans: a third of both sets


def test_edit_likeness(spark, odd, odd_rows, empty):
    out = ph.edit_likeness(odd, slices=4).collect()
    assert len(out) == len(odd_rows)
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), ph.fingerprint(t), ph.fingerprint(edited)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([tuple(r[:5]) for r in out], key=key) == sorted(want, key=key)
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
        if r.n_chars > 300:
            assert r.near_edited > 0.45
    assert ph.edit_likeness(empty).count() == 0
    one = ph.edit_likeness(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_mixed_bits_differ():
    h = np.arange(100, dtype=np.uint64)
    assert simhash.fold_bits(simhash.mixed(h, 1)) != simhash.fold_bits(simhash.mixed(h, 2))
    assert simhash.fold_bits(np.zeros(0, np.uint64)) == 0


def test_repeated_lines_count_once(spark):
    """A line repeated 60 times neither links different texts nor parts texts with the same shingles."""
    rng = random.Random(21)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    line, rows, kept = some(8), [], set()
    for i in range(0, 80, 4):
        a, b, own = some(204), some(204), some(204)
        same = own + line * 2
        rows += [(i, a + line * 60), (i + 1, b + line * 60), (i + 2, same), (i + 3, own + line * 60)]
        kept |= {i, i + 1, i + 2}
        assert shingles(" ".join(same)) == shingles(" ".join(rows[-1][1]))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in simhash.keep_one_of_near(docs).collect()} == kept


def test_line_is_at_the_similarity(spark):
    """Pairs of 8 words against 8 and one more (0.8 exactly) and of long texts at 0.81 join, pairs at 0.75 do not."""
    rng = random.Random(31)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows, kept = [], set()
    for i in range(0, 360, 6):
        a, b, c = some(8), some(204), some(204)
        rows += [(i, a), (i + 1, a + some(1)), (i + 2, b), (i + 3, b + some(46)), (i + 4, c), (i + 5, c + some(66))]
        kept |= {i, i + 2, i + 4, i + 5}
        like = [len(x & y) / len(x | y) for x, y in ((shingles(" ".join(rows[i + j][1])), shingles(" ".join(rows[i + j + 1][1]))) for j in (0, 2, 4))]
        assert like[0] == 0.8 and 0.81 < like[1] < 0.82 and 0.75 < like[2] < 0.76
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in simhash.keep_one_of_near(docs).collect()} == kept
