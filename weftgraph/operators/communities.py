"""Communities by greedy modularity, and the quality of any partition."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph, LocalGraph, ratio
from weftgraph.plans.shared import materialize


#: Offers that wait at least before outdated ones are thrown away.
WAITING = 100_000


def greedy_merge(g: LocalGraph, total: float | None = None) -> np.ndarray:
    """Community numbers: merge the pair of communities that raises modularity most, until none does.

    ``total`` is the weight of the whole graph where ``g`` holds some of its components: what merges in one depends on no other.
    """
    total = g.weight.sum() if total is None else total
    label = np.arange(g.n)
    if not g.a.size or total <= 0:
        return label
    share: list[dict[int, float]] = [{} for _ in range(g.n)]
    ends = np.zeros(g.n)
    for a, b, w in zip(g.a.tolist(), g.b.tolist(), (g.weight / (2 * total)).tolist(), strict=True):
        share[a][b] = share[a].get(b, 0.0) + w
        share[b][a] = share[b].get(a, 0.0) + w
        ends[a] += w
        ends[b] += w
    alive = [True] * g.n
    members: list[list[int]] = [[i] for i in range(g.n)]
    # A pair's gain only rises when it takes over weight, where strengths don't fall; so offers made before are bounds, and are corrected when their turn comes.
    bounds = bool((g.weight >= 0).all())
    heap: list[tuple[float, int, int]] = []

    def offer(i: int, j: int) -> None:
        a, b = (i, j) if i < j else (j, i)
        gain = 2 * (share[a][b] - ends[a] * ends[b])
        if gain > 1e-15:
            heapq.heappush(heap, (-gain, a, b))

    for i in range(g.n):
        for j in share[i]:
            if i < j:
                offer(i, j)
    most = max(2 * len(heap), WAITING)
    while heap:
        if len(heap) > most:
            heap = [x for x in set(heap) if alive[x[1]] and alive[x[2]]]
            heapq.heapify(heap)
            most = max(2 * len(heap), WAITING)
        loss, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]):
            continue
        if 2 * (share[i][j] - ends[i] * ends[j]) != -loss:
            if not heap or heap[0] != (loss, i, j):
                offer(i, j)
            continue
        if len(share[i]) < len(share[j]):
            i, j = j, i
        own = share[i]
        for k, w in share[j].items():
            if k != i:
                own[k] = share[k][i] = own.get(k, 0.0) + w
                del share[k][j]
        own.pop(j, None)
        ends[i] += ends[j]
        members[i] += members[j]
        alive[j] = False
        for k in share[j] if bounds else own:
            if k != i:
                offer(i, k)
        share[j] = {}
    for c in (c for c in range(g.n) if alive[c]):
        label[members[c]] = min(members[c])
    return label


def merge_mutually(graph: Graph, max_rounds: int = 200) -> DataFrame:
    """(node, label) for graphs of any size: in each round every community names its best partner, and pairs that
    name each other merge. Each round is a join and two aggregations on the contracted graph."""
    total = graph.links.agg(F.sum("weight")).first()[0] or 0.0
    label = materialize(graph.degrees.select("node", F.col("node").alias("label")), "labels")
    ends = label.join(graph.degrees, "node")
    for _ in range(max_rounds if total > 0 else 0):
        a = ends.groupBy("label").agg((F.sum("strength") / (2 * total)).alias("a"))
        x, y = label.withColumnsRenamed({"node": "u", "label": "x"}), label.withColumnsRenamed({"node": "v", "label": "y"})
        e = graph.both.join(x, "u").join(y, "v").filter("x <> y").groupBy("x", "y").agg((F.sum("weight") / (2 * total)).alias("e"))
        gain = e.join(a.withColumnsRenamed({"label": "x", "a": "ax"}), "x").join(a.withColumnsRenamed({"label": "y", "a": "ay"}), "y").withColumn("gain", F.round(2 * (F.col("e") - F.col("ax") * F.col("ay")), 15)).filter("gain > 0")
        # Ties go to the pair whose names sort last, from both ends alike, so the best pair of all always merges.
        best = gain.groupBy("x").agg(F.max(F.struct("gain", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))).alias("m"))
        pairs = best.groupBy("m.p", "m.q").count().filter("count = 2").select("p", "q")
        pairs = materialize(pairs, "merges")
        if pairs.isEmpty():
            break
        label = materialize(label.join(pairs.withColumnRenamed("q", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        ends = label.join(graph.degrees, "node")
    return label


def _merged_by_component(graph: Graph) -> DataFrame:
    """(node, label) as ``greedy_merge`` of the whole graph gives them, one component a group, in tasks."""
    total = graph.links.agg(F.sum("weight")).first()[0] or 0.0

    def merge(e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values(["src", "dst"])
        names = sorted(set(e["src"]) | set(e["dst"]))
        at = {x: i for i, x in enumerate(names)}
        g = LocalGraph(names, e["src"].map(at).to_numpy(dtype=np.int64), e["dst"].map(at).to_numpy(dtype=np.int64), e["weight"].to_numpy(dtype=float))
        return pd.DataFrame({"node": names, "label": [names[i] for i in greedy_merge(g, total)]})

    nodes = graph.components
    links = graph.links.join(nodes.withColumnsRenamed({"node": "src"}), "src")
    # Dealt by a number for each component, which adaptive plans don't fold.
    tasks = graph.spark.sparkContext.defaultParallelism * 4
    found = links.repartition(tasks, "component").groupBy("component").applyInPandas(merge, "node string, label string")
    return materialize(graph.degrees.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def community_table(graph: Graph) -> DataFrame:
    """(node, community) of the greedy merges, at every size: communities are numbered from 1, the largest first, ties by smallest node."""

    def make() -> DataFrame:
        labels = _merged_by_component(graph)
        sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first"))
        # One row a community in the window.
        numbered = sizes.withColumn("community", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), "first")))
        return materialize(labels.join(numbered.select("label", "community"), "label").select("node", "community"), "communities")

    return graph._once("communities", make)


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("community").agg(F.count("*").alias("size")).orderBy("community")


def modularity(graph: Graph, communities: DataFrame) -> DataFrame:
    """One row (modularity): Newman's weighted Q of a (node, community) partition; 0 without edges."""
    total = graph.links.agg(F.sum("weight").alias("w"))
    inside = graph.links.join(communities.withColumnsRenamed({"node": "src", "community": "c"}), "src").join(communities.withColumnsRenamed({"node": "dst", "community": "d"}), "dst").filter("c = d").groupBy("c").agg(F.sum("weight").alias("inner"))
    ends = graph.degrees.join(communities, "node").groupBy(F.col("community").alias("c")).agg(F.sum("strength").alias("ends"))
    parts = ends.join(inside, "c", "left").join(F.broadcast(total))
    q = ratio(F.coalesce("inner", F.lit(0.0)), F.col("w")) - ratio(F.col("ends"), 2 * F.col("w")) ** 2
    return parts.agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("modularity"))
