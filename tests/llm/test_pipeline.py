"""The stages in a row, each against a plain version of its decision."""

import hashlib
import os
import re

import pytest

DATA = "/root/testdata/sf0.001"
WS = re.compile("[\x20\x09-\x0d]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def shingles(t):
    w = [x for x in WS.split(t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark):
    import corpus_pipeline
    from weftgraph.plans.shared import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        seen[name] = docs.toPandas()
        if name != "sentencepiece":
            assert docs.columns == columns
    first = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert set(seen["language_id"].doc_id) == {i for i, t in zip(first.doc_id, first.text, strict=True) if any(map(str.isalpha, t))}
    kept = {}
    for i, t in sorted(zip(seen["language_id"].doc_id, seen["language_id"].text, strict=True)):
        kept.setdefault(hashlib.sha256(WS.sub(" ", t).encode()).hexdigest(), i)
    assert set(seen["exact_dedup"].doc_id) == set(kept.values())
    sets = sorted((i, shingles(t)) for i, t in zip(seen["exact_dedup"].doc_id, seen["exact_dedup"].text, strict=True))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(sets[a][0]), root(sets[b][0])
                up[max(p, q)] = min(p, q)
    assert set(seen["jaccard_join"].doc_id) == {i for i in up if root(i) == i}
    total = sum(len(t.split()) for t in seen["jaccard_join"].text)
    assert sum(len(t.split()) for t in seen["mix_sources"].text) == pytest.approx(1.5 * total, rel=0.05)
    assert len(seen["sentencepiece"]) == len(seen["mix_sources"]) and seen["sentencepiece"].round_trip.all()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
