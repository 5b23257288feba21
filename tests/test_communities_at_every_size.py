"""Communities are the greedy ones whatever the size, found with few offers; rows of an edge list are read once."""

import heapq

import numpy as np
import pandas as pd

from weftgraph.operators import communities, graph, measures
from weftgraph.operators.graph import LocalGraph
from weftgraph.sources import edges


def drawn(n: int, m: int, seed: int) -> LocalGraph:
    rng = np.random.default_rng(seed)
    pairs = np.unique(np.sort(rng.integers(0, n, (m, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    return LocalGraph([f"{i:04}" for i in range(n)], pairs[:, 0], pairs[:, 1], rng.integers(1, 9, len(pairs)).astype(float))


def test_no_other_communities_beyond_the_size_of_kernels(spark, monkeypatch):
    local = drawn(72, 700, 2)
    rows = pd.DataFrame({"source": [local.names[i] for i in local.a], "target": [local.names[i] for i in local.b], "weight": local.weight})

    def found() -> tuple[dict, dict]:
        g = edges.graph_from_edgelist(spark.createDataFrame(rows))
        parts = {r["node"]: r["community"] for r in communities.community_table(g).collect()}
        return parts, {r["metric"]: round(r["value"], 9) for r in measures.network_statistics_table(g).collect()}

    below = found()
    monkeypatch.setattr(graph, "KERNEL_EDGES", 100)
    monkeypatch.setattr(communities, "KERNEL_EDGES", 100, raising=False)
    assert found() == below


def merged_by_all_gains(g: LocalGraph) -> np.ndarray:
    """The definition: all gains anew before each merge."""
    total = g.weight.sum()
    share = np.zeros((g.n, g.n))
    share[g.a, g.b] = share[g.b, g.a] = g.weight / (2 * total)
    near = share != 0
    ends, label = share.sum(axis=1), np.arange(g.n)
    while True:
        gain = np.where(near & ~np.eye(g.n, dtype=bool), 2 * (share - np.outer(ends, ends)), 0.0)
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] <= 1e-15:
            return label
        label[label == label[j]] = label[i]
        near[i] |= near[j]
        share[i] += share[j]
        share[:, i], near[:, i] = share[i], near[i]
        share[j] = share[:, j] = 0
        near[j] = near[:, j] = False
        ends[i] += ends[j]
        ends[j] = 0


def test_few_offers_and_the_pairs_of_the_definition(monkeypatch):
    local = drawn(60, 200, 5)
    local.weight = np.random.default_rng(6).random(local.a.size) + 0.1  # no ties
    got, want = communities.greedy_merge(local), merged_by_all_gains(local)
    assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(got.tolist())) == len(set(want.tolist()))
    offers = []
    push = heapq.heappush
    monkeypatch.setattr(heapq, "heappush", lambda heap, x: offers.append(x) or push(heap, x))
    large = drawn(600, 8000, 7)
    communities.greedy_merge(large)
    assert len(offers) < 6 * large.a.size


def test_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("c", "c", None), ("b", "c", 4.0)], "source string, target string, weight double").mapInPandas(count, "source string, target string, weight double")
    g = edges.graph_from_edgelist(rows)
    assert {tuple(r) for r in g.edges.collect()} == {("a", "b", 3.0), ("b", "c", 4.0)} and g.m == 2
    assert seen.value == 4
