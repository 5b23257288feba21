"""Nodes inside long chains are not walked from; what paths pass is the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import chains, learn, measures, paths
from weftgraph.operators.graph import Graph, LocalGraph, Packed
from weftgraph.sources.edges import graph_from_edgelist


def passed(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By a walk from each node."""
    g, out = LocalGraph([str(i) for i in range(n)], a, b, np.ones(a.size)), np.zeros(n)
    for s in range(n):
        dist, count, levels = g.bfs(s)
        delta = np.zeros(n)
        for w in (w for level in levels[:0:-1] for w in level):
            for v in g.neighbours[g.start[w] : g.start[w + 1]]:
                if dist[v] == dist[w] - 1:
                    delta[v] += count[v] / count[w] * (1 + delta[w])
            out[w] += delta[w]
    return out


def chained(rng: np.random.Generator) -> tuple[int, np.ndarray, np.ndarray]:
    """A few nodes with random edges, chains and loops between them, tails, and sometimes a circle apart."""
    n = core = int(rng.integers(1, 6))
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, core, (int(rng.integers(0, 8)), 2)) if p[0] != p[1]}
    for _ in range(int(rng.integers(1, 5))):
        i, j = map(int, rng.integers(0, core, 2))
        run = [i, *range(n, n + int(rng.integers(2, 14)))]
        n += len(run) - 1
        pairs |= set(zip(run, run[1:] + ([j] if rng.random() < 0.8 else []), strict=False))
    if rng.random() < 0.4:
        size = int(rng.integers(5, 11))
        pairs |= {(n + k, n + (k + 1) % size) for k in range(size)}
        n += size
    a, b = np.sort(rng.permutation(n)[np.array(sorted({tuple(sorted(p)) for p in pairs}))], axis=1).T.copy()
    return n, a, b


def test_sums_are_those_of_walks_from_each_node():
    rng, found = np.random.default_rng(3), 0
    for _ in range(60):
        n, a, b = chained(rng)
        x, got = Packed(n, a, b), np.zeros(n)
        c = chains.chains_of(x)
        found += c.p.size
        for lo, hi, s, e, inside in chains.blocks_of(x, c):
            got[x.node[lo:hi]] += chains.passed_from_chains(x, c, np.arange(s, e), lo, hi) if inside else chains.passed_from_sources(x, c.sources[s:e], lo, hi)
        assert got == pytest.approx(passed(n, a, b), abs=1e-9)
    assert found > 60


def graph(spark, a: np.ndarray, b: np.ndarray) -> Graph:
    return graph_from_edgelist(spark.createDataFrame([(f"{i:03d}", f"{j:03d}", 1.0 + (i + j) % 5) for i, j in zip(a.tolist(), b.tolist(), strict=True)], "source string, target string, weight double"))


def test_betweenness_walks_from_the_ends_only(spark, monkeypatch):
    ring = np.arange(200)
    a, b = np.append(ring, 0), np.append((ring + 1) % 200, 100)
    x = Packed(200, np.minimum(a, b), np.maximum(a, b))
    c = chains.chains_of(x)
    assert c.sources.size == 0 and c.p.size == 2 and c.own.sum() == 2
    monkeypatch.setattr(paths, "path_sums", lambda g: 1 / 0)
    got = {r["node"]: r["betweenness"] for r in paths.betweenness(graph(spark, a, b)).collect()}
    want = passed(200, np.minimum(a, b), np.maximum(a, b)) / (199 * 198)
    assert [got[f"{i:03d}"] for i in range(200)] == pytest.approx(want)


def test_features_need_no_join_of_triangles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a, b = np.array(sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 40, (200, 2)) if p[0] != p[1]})).T
    g = graph(spark, a, b)
    monkeypatch.setattr(measures, "WEDGES", 50)
    got = measures.weighted_clustering(g).join(measures.clustering(g).select("node", F.col("weighted_clustering").alias("want")), "node").collect()
    assert len(got) == g.n and [r["weighted_clustering"] for r in got] == pytest.approx([r["want"] for r in got]) and max(r["want"] for r in got) > 0
    monkeypatch.setattr(measures, "triangles", lambda g: 1 / 0)
    assert learn.node_features(graph(spark, a, b)).count() == g.n


def test_columns_times_the_matrix():
    rng = np.random.default_rng(2)
    a, b = np.array([[0, 1], [1, 4], [0, 4], [4, 5]]).T
    g, x, y = LocalGraph([str(i) for i in range(7)], a, b, np.ones(4)), rng.normal(size=4), rng.normal(size=(7, 3))
    assert g.multiply_columns(x, y) == pytest.approx(np.column_stack([g.multiply(x, c) for c in y.T]))
