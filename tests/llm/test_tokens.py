import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lemmary.llm import bpe, chunks, packing, sstable
from lemmary.llm.chunks import library_encoder


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def strange_texts():
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "é", "é", "́", "ß", "'s", "'LL", "123", "4", "!?", "|", "<|endoftext|>", "<|startoftext|>", "日本", "\U0001f600", "‍", "Σ", "ς", "İ", "\x00", "᠎", "​", "x" * 300]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_chunks_encode_like_whole_texts(vocab, name, spaces):
    texts = strange_texts()
    flat, ends = library_encoder(vocab(name), spaces).encode(texts)
    want = [e.ids for e in tokenizer(vocab(name)).encode_batch(texts, add_special_tokens=False)]
    for i, ids in enumerate(want):
        assert flat[ends[i] : ends[i + 1]].tolist() == ids, repr(texts[i])


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_every_code_point_encodes_like_the_library(vocab, name, spaces):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    flat, ends = library_encoder(vocab(name), spaces).encode(texts)
    want = [e.ids for e in tokenizer(vocab(name)).encode_batch(texts, add_special_tokens=False)]
    assert [hex(ord(texts[i][1])) for i, ids in enumerate(want) if flat[ends[i] : ends[i + 1]].tolist() != ids] == []


def test_other_splits_are_refused(vocab):
    with pytest.raises(ValueError):
        library_encoder(vocab("byte_bpe_50k.json"), "dropped")
    with pytest.raises(ValueError):
        bpe.RankArrayBPE(vocab("word_bpe_49k.json"))


def test_rank_array_equals_library(vocab):
    path = vocab("byte_bpe_50k.json")
    own, lib = bpe.RankArrayBPE(path), tokenizer(path)
    for text in strange_texts() + ["ab" * 700, "lo" * 130 + "l"]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == ids, repr(text)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    for word in [b"lollapalooza" * 40, b"aaaaaaaaab" * 30, bytes(range(256))]:
        assert own.merge_short(word) == own.merge_long(word)


def test_encode_and_decode_frames(odd, odd_rows, empty, vocab):
    path = vocab("byte_bpe_50k.json")
    lib = tokenizer(path)
    out = bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()
    want = sorted((t or "", tuple(lib.encode(t or "", add_special_tokens=False).ids)) for _, t in odd_rows)
    assert sorted((r.decoded, tuple(r.ids)) for r in out) == want
    assert bpe.encode_documents(empty, path).count() == 0


def test_pack_fills_windows():
    rng = random.Random(3)
    pieces = [(i, 0, rng.choice([1, 5, 90, 513, 2000, 4096, 9000])) for i in range(300)]
    windows, rest = packing.pack(pieces)
    assert not rest
    sizes = [sum(p[2] for p in w) for w in windows]
    assert all(s <= 4096 and s & (s - 1) == 0 for s in sizes)
    spans = defaultdict(list)
    for w in windows:
        for d, s, n in w:
            spans[d].append((s, n))
    for d, _, n in pieces:
        at = 0
        for s, m in sorted(spans[d]):
            assert s == at
            at += m
        assert at == n
    steps = packing.step_groups(windows)
    load = defaultdict(int)
    for w, k in zip(windows, steps, strict=True):
        load[k] += sum(p[2] for p in w)
    assert max(load.values()) <= packing.STEP_TOKENS


def test_pack_documents(odd, odd_rows, empty, vocab):
    path = vocab("word_bpe_49k.json")
    lib = tokenizer(path)
    out = packing.pack_documents(odd, path, group_tokens=700).collect()
    by_sequence = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_sequence[r.sequence_id].append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].window and at <= 4096 and at & (at - 1) == 0
    got = defaultdict(list)
    for r in out:
        got[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for d, t in odd_rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(got[d, len(ids)])
        joined = [i for _, p in pieces for i in p]
        assert joined[: len(ids)] == ids or len(joined) % len(ids) == 0
    assert sum(r.length for r in out) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert packing.pack_documents(empty, path).count() == 0


def test_shards_round_trip(spark, odd, odd_rows, empty, vocab):
    path = vocab("byte_bpe_50k.json")
    lib = tokenizer(path)
    shards = sstable.write_shards(odd, path, shards=5)
    rows = sstable.read_shards(spark, shards).orderBy("start").collect()
    key = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in odd_rows), key=key)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = sorted((key(d), tuple([*lib.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in odd_rows)
    assert sorted((key(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    found = [x for s in shards for x in sstable.Shard(s["path"]).get(5)]
    assert len(found) == 2 and not any(sstable.Shard(s["path"]).get(999) for s in shards)
    assert sstable.read_shards(spark, sstable.write_shards(empty, path)).count() == 0


def test_shards_refuse_what_does_not_fit(spark, empty, vocab):
    path = vocab("byte_bpe_50k.json")
    with pytest.raises(ValueError):
        sstable.write_shards(empty, path, end_id=1 << 16, id_width=2)
    with pytest.raises(TypeError):
        sstable.write_shards(empty.selectExpr("string(doc_id) doc_id", "text"), path)
    docs = spark.createDataFrame([(3, "a b"), (1, "c")], "doc_id int, text string")
    shards = sstable.write_shards(docs, path, end_id=70_000)
    rows = sstable.read_shards(spark, shards).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4")[-1]) for r in rows) == [(1, 70_000), (3, 70_000)]


def test_shards_follow_the_bytes(spark, vocab):
    docs = spark.range(300).selectExpr("id * 7 - 500 doc_id", "repeat(concat('word ', id, ' '), 40) text")
    shards = sstable.write_shards(docs, vocab("byte_bpe_50k.json"), shard_bytes=5000)
    assert len(shards) > 20 and sum(s["docs"] for s in shards) == 300
    rows = sorted(sstable.read_shards(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i * 7 - 500 for i in range(300)]


def test_shard_file(tmp_path):
    writer = sstable.ShardWriter(str(tmp_path / "a.sst"), 2)
    values = {i: np.arange(i % 50, dtype="<u2").tobytes() for i in range(-3000, 30000, 7)}
    writer.add(sstable.key_of(None), b"\1\0")
    for i, v in values.items():
        writer.add(sstable.key_of(i), v)
    writer.close()
    shard = sstable.Shard(str(tmp_path / "a.sst"))
    assert len(shard.places) > 1 and shard.docs == len(values) + 1
    assert [sstable.id_of(k) for k, _ in shard] == [None, *values]
    for i in (-3000, 4, 11, 29998, 5):
        got = shard.get(i)
        assert [g.tobytes() for g in got] == ([values[i]] if i in values else [])
    data = (tmp_path / "a.sst").read_bytes()
    (tmp_path / "b.sst").write_bytes(data[:100] + b"x" + data[101:])
    with pytest.raises(ValueError):
        list(sstable.Shard(str(tmp_path / "b.sst")))


def test_lean_tasks_hold_nothing_for_other_operators(vocab):
    own = library_encoder(vocab("word_bpe_49k.json"), "dropped")
    assert list(chunks.lean(lambda x: x, encodes=True)(iter([1, 2]))) == [1, 2]
    assert library_encoder(vocab("word_bpe_49k.json"), "dropped") is own  # the next packing task has it
    seen = list(chunks.lean(lambda x: (len(chunks._LOADED) for _ in x))(iter([1, 2])))
    assert seen == [0, 0]
    held = chunks.give_back
    held()
    before = int(open("/proc/self/statm").read().split()[1])
    parts = [bytes(50_000) for _ in range(2_000)]
    keep = parts[::200]
    del parts
    held()
    assert int(open("/proc/self/statm").read().split()[1]) - before < 10_000 and len(keep) == 10  # pages of 4 kB, of 25,000
