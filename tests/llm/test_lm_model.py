"""The language model against plain softmax sums, and its independence of partitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from test_operators import prose, table
from weftgraph.llm import lm


def test_it_is_normalised_and_learns(spark):
    rng = np.random.default_rng(0)
    k = 12
    freq = rng.dirichlet(np.ones(k))
    p = lm.Parameters.start(freq, k, 6, 1)
    trainer = lm.Trainer(p, freq, 0.1, 8, 1, shared=32)
    u = rng.integers(0, k, 6000)
    v, w = rng.integers(0, k, 6000), (u + 1) % k
    score = lambda: lm.log10_tokens(p, lm.log_normalisers(spark, p, 5, 7), v, u, w).mean()
    before = score()
    for _ in range(5):
        for a in range(0, 6000, 500):
            trainer.step(v[a : a + 500], u[a : a + 500], w[a : a + 500])
    assert score() > before + 0.3
    z = lm.log_normalisers(spark, p, 5, 7)
    for a, b in ((0, 3), (5, 5)):
        assert (10 ** lm.log10_tokens(p, z, np.full(k, a), np.full(k, b), np.arange(k))).sum() == pytest.approx(1, abs=1e-4)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, prose(rng, rng.randint(0, 80), 60) + rng.choice(["", " " + "long" * 40]), None, None) for i in range(120)]


def test_scores_equal_plain_softmax_sums(spark, rows, monkeypatch):
    seen = {}
    normal = lm.log_normalisers

    def keep(spark, p, *a):
        seen["p"] = p
        return normal(spark, p, *a)

    monkeypatch.setattr(lm, "log_normalisers", keep)
    got = {r["doc_id"]: r for r in lm.score_documents(table(spark, rows), head=40, outputs=25, batch=64, rounds=2, least_shards=2).collect()}
    p = seen["p"]
    words = {i: [*t.lower().encode().split(), b" "] for i, t, *_ in rows}
    words = {i: [w if len(w) <= 64 else b" " + lm.hashlib.sha256(w).digest() for w in ws] for i, ws in words.items()}
    c = Counter(w for i, ws in words.items() if not got[i]["held_out"] for w in ws)
    ranked = sorted((w for w in c if w != b" "), key=lambda w: (-c[w], w))
    top = [w for w in ranked if c[w] >= 1][:25]
    out_of = {w: 1 + i for i, w in enumerate(top)} | {b" ": 0}
    output = lambda w: out_of.get(w, 1 + len(top) + lm.group_of(w))
    context = lambda w: 0 if w == b" " else output(w)
    group_n, group_v = Counter(), Counter()
    for w in c:
        if w not in out_of:
            group_n[lm.group_of(w)] += c[w]
            group_v[lm.group_of(w)] += 1
    for i, ws in words.items():
        total, u, v = 0.0, 0, 0
        for w in ws:
            s = ((p.q[u] * p.c[0] + p.q[v] * p.c[1]).astype(float) * p.r).sum(axis=1) + p.b
            total += (s[output(w)] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
            if w not in out_of:
                g = lm.group_of(w)
                total += math.log10((c[w] + 1) / (group_n[g] + group_v[g] + 1))
            u, v = context(w), u
        assert got[i]["score"] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_neither_partitions_nor_head_size_change_scores(spark, rows):
    docs = table(spark, rows)
    run = lambda d, head: {r["doc_id"]: r["score"] for r in lm.score_documents(d, head=head, outputs=20, batch=64, rounds=2, least_shards=3).collect()}
    one = run(docs.repartition(1), 40)
    assert run(docs.repartition(7), 40) == pytest.approx(one, rel=1e-5)


def test_a_model_of_contexts_beats_the_base_score(spark):
    rng = random.Random(4)
    own = [(i, " ".join(f"{x}{rng.randint(0, 30)}{x}" for _ in range(60)), None, None) for i in range(240) for x in ["ab" if i % 2 else "cd"]]
    got = [r for r in lm.score_documents(table(spark, own), outputs=40, rate=0.1, batch=64, rounds=2, least_shards=2).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.15 * sum(r["n_tokens"] for r in got)


def test_words_of_over_64_bytes_go_by_their_digest():
    long, other = b"x" * 65, b"x" * 66
    got = lm.tokens(long + b" a " + other + b" " + long)
    assert got[0] == got[3] != got[2] and got[1] == b"a" and all(len(w) == 33 for w in (got[0], got[2]))


def test_head_holds_at_most_what_it_should(spark):
    own = spark.createDataFrame([(bytes([97 + i % 26, 97 + i // 26]), 3 + 5000 * (i < 4) + i % 3) for i in range(60)], "word binary, c long")
    assert lm.frequent(own, 10).num_rows == 4 and lm.frequent(own, 60).num_rows == 60 and lm.frequent(own, 3).num_rows == 0 and lm.frequent(own, 25).num_rows == 23
