"""Edges are put in order as numbers, after they have been fetched."""

import numpy as np

from weftgraph.operators.graph import Graph
from weftgraph.operators.structure import cuts


def test_no_sort_of_names_before_they_are_fetched(spark, monkeypatch):
    rows = [("b", "é", 2.0), ("a", "z", 1.0), ("a", "b", 3.0), ("Z", "a", 4.0), ("é", "\U0001f600", 5.0), ("é", "￮", 6.0)]
    g = Graph(spark.createDataFrame(rows, "src string, dst string, weight double"))
    monkeypatch.setattr(type(g.edges), "orderBy", lambda *a, **k: 1 / 0)
    local = g.local()
    assert local.names == ["Z", "a", "b", "z", "é", "￮", "\U0001f600"]  # code points
    assert [(local.names[a], local.names[b], w) for a, b, w in zip(local.a, local.b, local.weight, strict=True)] == sorted(rows)
    nodes, edges, k = cuts(local)
    assert k == 1 and {local.names[i] for i, _, _ in nodes} == {"a", "b", "é"} and len(edges) == 6 and all(isinstance(e, int) and not isinstance(e, np.integer) for e, _ in edges)
