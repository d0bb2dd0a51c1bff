import os
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lemmary.llm import toxicity
from lemmary.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup_and_secrets import BASE
from tests.llm.test_models import union
from tests.llm.test_similarity import shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_stages(spark, tmp_path, vocab):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.collect(), docs.collect())
    rows, out = kept["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 0").collect()}
    clean = [r for r in rows if r.doc_id in toxic]
    left = {r.doc_id for r in out}
    assert sum(r.doc_id in left for r in clean) / len(clean) > 0.95
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = toxicity.Scorer(model).score([r.text or "" for r in rows])
    cut = [model.thresholds.get(r.lang or "", model.threshold) for r in rows]
    assert sorted(left) == sorted(r.doc_id for r, x, y in zip(rows, scores, cut, strict=True) if x < y)
    rows, out = kept["exact_dedup"]
    largest = defaultdict(int)
    for r in rows:
        largest[r.text or ""] = max(largest[r.text or ""], r.doc_id)
    assert {r.doc_id for r in out} == set(largest.values())
    rows, out = kept["simhash"]
    left = {r.doc_id for r in out}
    sets = [shingles(r.text or "") if (r.text or "").split() else set() for r in rows]
    group = union((i, j) for i in range(len(rows)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    groups = defaultdict(set)
    for i, r in enumerate(rows):
        groups[group(i)].add(r.doc_id)
    assert all(len(own & left) == 1 for own in groups.values())
    rows, out = kept["secret_scan"]
    texts = {r.doc_id: r for r in out}
    for r in rows:
        found = [m for k, p, ok in BASE for m in p.finditer(r.text) if ok(m)]
        new = texts[r.doc_id]
        assert new.n_chars == len(new.text) if found else (new.text == r.text or "[REDACTED]" in new.text)
        for m in found:
            assert m.group() not in new.text
    rows, out = kept["packing"]
    lib = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    for r in rows:
        ids = [*lib.encode(r.text, add_special_tokens=False).ids, 2]
        pieces = sorted((p.start, p.ids) for p in out if p.doc_id == r.doc_id)
        assert [i for _, p in pieces for i in p] == ids
    assert all(p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) for p in out)


def test_queries_run_over_whole_tables(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in QUERIES:
        if name not in ("op2_packing", "op10_chaining"):
            assert QUERIES[name](spark, DATA).count() == n, name
