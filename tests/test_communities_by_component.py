"""Communities are merged one component at a time, outside the driver, as the whole graph would merge them."""

import numpy as np

from weftgraph.operators import communities
from weftgraph.operators.graph import Graph, LocalGraph


def test_components_merge_as_the_whole_graph(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = {(f"{c}{min(p):02}", f"{c}{max(p):02}"): float(rng.integers(1, 9)) for c in "abc" for p in rng.integers(0, 30, (90, 2)).tolist() if p[0] != p[1]}
    g = Graph(spark.createDataFrame([(*k, w) for k, w in rows.items()], "src string, dst string, weight double"))
    local = g.local()
    want = {local.names[i]: local.names[k] for i, k in enumerate(communities.greedy_merge(local))}
    monkeypatch.setattr(communities, "WAITING", 10)
    assert [local.names[k] for k in communities.greedy_merge(local)] == list(want.values())  # outdated offers go
    monkeypatch.setattr(LocalGraph, "__getstate__", lambda self: 1 / 0, raising=False)  # no graph is sent to tasks whole
    calls = []
    real = communities.greedy_merge
    monkeypatch.setattr(communities, "greedy_merge", lambda *a: calls.append(a) or real(*a))
    got = {r["node"]: r["label"] for r in communities._merged_by_component(g).collect()}
    assert got == want and calls == []  # nothing merges in the driver
