"""Random graphs as tables: one task makes each, from its own seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.graph import Graph, LocalGraph


def small_world(n: int, k: int, p: float, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Watts and Strogatz 1998: a ring with ``k`` neighbours, ends rewired with probability ``p``; drawn again until connected."""
    while True:
        near = [set() for _ in range(n)]
        for d in range(1, k // 2 + 1):
            for i in range(n):
                near[i].add((i + d) % n)
                near[(i + d) % n].add(i)
        for d in range(1, k // 2 + 1):
            for i in range(n):
                j = (i + d) % n
                if rng.random() < p and len(near[i]) < n - 1:
                    t = int(rng.integers(n))
                    while t == i or t in near[i]:
                        t = int(rng.integers(n))
                    if j in near[i]:
                        near[i].remove(j)
                        near[j].remove(i)
                        near[i].add(t)
                        near[t].add(i)
        edges = [(i, j) for i in range(n) for j in near[i] if i < j]
        a, b = np.array(edges).T
        if LocalGraph([str(i) for i in range(n)], a, b, np.ones(a.size)).parts().max() == 0:
            return edges


def preferential_attachment(n: int, m: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Barabási and Albert 1999: each new node links to ``m`` different nodes, in proportion to their degrees."""
    edges = [(0, i) for i in range(1, m + 1)]
    ends = [x for e in edges for x in e]
    for new in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[int(rng.integers(len(ends)))])
        edges += [(t, new) for t in sorted(chosen)]
        ends += [x for t in sorted(chosen) for x in (t, new)]
    return edges


def demo_graph_dataset(spark: SparkSession, seed: int = 42) -> tuple[Graph, DataFrame]:
    """24 labelled graphs of 26 to 38 nodes: twelve small worlds ("modular"), twelve with hubs ("hub-dominated")."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].to_list():
                rng = np.random.default_rng([seed, i])
                n = int(rng.integers(26, 39))
                edges = small_world(n, 4, float(rng.uniform(0.05, 0.20)), rng) if i < 12 else preferential_attachment(n, 2, rng)
                names = [(min(str(a), str(b)), max(str(a), str(b))) for a, b in edges]
                yield pd.DataFrame({"graph": f"graph_{i + 1:02d}", "src": [x for x, _ in names], "dst": [y for _, y in names], "weight": 1.0})

    edges = spark.range(0, 24, 1, 4).mapInPandas(make, "graph string, src string, dst string, weight double")
    labels = spark.createDataFrame([(f"graph_{i + 1:02d}", "modular" if i < 12 else "hub-dominated") for i in range(24)], "graph string, label string")
    return Graph(edges, group="graph"), labels


def example_networks(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two edge lists of 32 rows, of a reference and a changed condition, and labels of their 22 nodes; our own data."""
    rng = np.random.default_rng(7)
    base = sorted({(f"n{min(a, b):02d}", f"n{max(a, b):02d}") for a, b in preferential_attachment(22, 2, rng)})[:32]
    nodes = [f"n{i:02d}" for i in range(22)]
    present = set(base)
    for x in nodes:
        if not any(x in e for e in present):
            base[-1 - nodes.index(x) % 4] = (min(x, "n00"), max(x, "n00"))
    changed = base[:24] + [(nodes[i], nodes[i + 3]) for i in range(3, 19, 2)]
    row = lambda es, w: spark.createDataFrame([(a, b, str(w + i % 3)) for i, (a, b) in enumerate(es[:32])], "source string, target string, weight string")
    labels = spark.createDataFrame([(x, "core" if i < 11 else "edge", float(i % 5)) for i, x in enumerate(nodes)], "node string, label string, score double")
    return row(base, 1), row(changed, 2), labels
