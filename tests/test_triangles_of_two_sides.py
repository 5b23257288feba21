"""Wedges are only made around middle corners: none in a graph of two sides, all that close elsewhere."""

import itertools

import numpy as np
import pytest

from weftgraph.operators import measures
from weftgraph.operators.graph import Graph


def graph(spark, pairs):
    return Graph(spark.createDataFrame([(f"{a:03}", f"{b:03}", 1.0 + (a + b) % 3) for a, b in sorted(pairs)], "src string, dst string, weight double"))


@pytest.fixture
def made(monkeypatch):
    tables, write = {}, measures.materialize

    def seen(df, name="table"):
        tables[name] = write(df, name)
        return tables[name]

    monkeypatch.setattr(measures, "materialize", seen)
    return tables


def test_a_graph_of_two_sides_has_no_middles(spark, made):
    g = graph(spark, {(a, 100 + (a * 7 + k) % 9) for a in range(60) for k in range(4)})
    assert measures.triangles(g).count() == 0
    assert made["oriented"].count() == 240 and made["middles"].count() == 0 and made["ends"].count() == 0


def test_all_triangles_of_a_random_graph(spark):
    pairs = {tuple(sorted(map(int, p))) for p in np.random.default_rng(4).integers(0, 30, (140, 2)) if p[0] != p[1]}
    got = sorted(tuple(sorted((r["a"], r["b"], r["c"]))) for r in measures.triangles(graph(spark, pairs)).collect())
    want = [c for c in itertools.combinations(range(30), 3) if all(p in pairs for p in itertools.combinations(c, 2))]
    assert len(want) > 50 and got == [tuple(f"{x:03}" for x in c) for c in want]
