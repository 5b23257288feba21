"""Blocks of sources are walked together: the same hops, paths and flows as one walk for each source."""

import numpy as np
import pytest

from weftgraph.operators import paths, structure
from weftgraph.operators.graph import Graph, LocalGraph, Packed


def made(n=300, seed=1):
    """Random parts, a star, a long chain and nodes without an edge."""
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(map(int, rng.integers(0, 100, 2)))) for _ in range(160)} | {(100, i) for i in range(101, 160)} | {(i, i + 1) for i in range(200, 260)}
    e = np.array(sorted(p for p in pairs if p[0] != p[1]))
    return LocalGraph([f"{i:03}" for i in range(n)], e[:, 0], e[:, 1], np.ones(len(e)))


@pytest.mark.parametrize("width", [7, 64, 1000])
def test_blocks_equal_single_walks(width):
    g = made()
    p = Packed(g.n, g.a, g.b)
    hops, flow, done = np.zeros(g.n), np.zeros(g.n), []
    for lo, hi, s, e in p.blocks(width):
        for _, hop, at, c in p.hop_counts(lo, hi, s, e):
            hops[p.node[at]] += hop * c
        dist, count, delta, _ = p.passed(lo, hi, s, e)
        flow[p.node[lo:hi]] += delta.sum(axis=1)
        for j in range(e - s):
            d, c, _ = g.bfs(int(p.node[s + j]))
            own = p.node[lo:hi]
            assert (dist[:, j] == d[own]).all() and (count[:, j] == c[own]).all()
            done.append(int(p.node[s + j]))
    assert sorted(done) == sorted(p.node.tolist())
    assert hops.tolist() == [float(g.bfs(i)[0].clip(0).sum()) for i in range(g.n)]
    assert flow[230] == 2 * 30 * 30 and flow[100] == 59 * 58


def test_efficiency_and_parts_after_removals():
    g = made()
    alive = np.ones(g.n, dtype=bool)
    alive[[3, 100, 230]] = False
    want = sum((1.0 / d[d > 0]).sum() for d in (g.bfs(s, alive)[0] for s in np.flatnonzero(alive)))
    assert g.efficiency(alive) == pytest.approx(want / (alive.sum() * (alive.sum() - 1)))
    parts = g.parts(alive)
    assert (parts[~alive] == -1).all() and parts[0] == 0
    for s in (0, 101, 210, 250):
        assert ((parts == parts[s]) == (g.bfs(s, alive)[0] >= 0)).all()


def test_a_graph_without_cuts_is_not_walked(spark, monkeypatch):
    monkeypatch.setattr(paths, "path_sums", lambda g: 1 / 0)
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "src string, dst string, weight double")
    nodes, edges = structure.bridge_analysis(Graph(ring))
    assert nodes.collect() == [] and edges.collect() == [] and "betweenness" in nodes.columns and "edge_betweenness" in edges.columns
