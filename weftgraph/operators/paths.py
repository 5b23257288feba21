"""Shortest paths: hop distances, closeness, betweenness, efficiency, diameter.

One plan for graphs of any size (frontier joins, one round a hop), and kernels for graphs that fit a checked size:
tasks take blocks of source nodes and walk the broadcast adjacency for all of a block at once, inside their components. They send back
sums; only ``all_pairs`` has a row for each pair. Hops alone are walked with sources as bits, numbers of paths with sources as columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import chains
from weftgraph.operators.graph import COLUMNS, WORDS, Graph, Packed, ratio
from weftgraph.plans.shared import materialize


def all_pairs(graph: Graph, max_hops: int = 1000) -> DataFrame:
    """(s, v, d, paths): hops and numbers of shortest paths of all connected ordered pairs, and of each node to itself."""
    keys = graph.keys
    if not keys and graph.fits:
        return _pairs_by_walks(graph)
    both = materialize(graph.both.select(*keys, "u", "v"), "arcs")
    nodes = graph.degrees.select(*keys, F.col("node").alias("s"))
    seen = frontier = materialize(nodes.select(*keys, "s", F.col("s").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "hop0")
    for hop in range(1, max_hops + 1):
        step = frontier.select(*keys, "s", F.col("v").alias("u"), "paths").join(both, [*keys, "u"]).groupBy(*keys, "s", "v").agg(F.sum("paths").alias("paths"))
        step = step.join(seen.select(*keys, "s", "v"), [*keys, "s", "v"], "left_anti").select(*keys, "s", "v", F.lit(hop).alias("d"), "paths")
        frontier = materialize(step, "hop")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"paths longer than {max_hops} hops")


def _sums_by_join(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``path_sums`` returns, from frontier joins and a backward pass over the pairs, farthest first."""
    pairs = materialize(all_pairs(graph), "pairs")
    both = graph.both.select("u", "v")
    deepest = pairs.agg(F.max("d")).first()[0] or 0
    flow = None
    edge_parts = []
    below = pairs.filter(F.col("d") == deepest).select("s", "v", "paths", F.lit(0.0).alias("delta"))
    node_parts = [below.select("s", "v", "delta")]
    for d in range(deepest, 0, -1):
        down = below.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        up = pairs.filter(F.col("d") == d - 1).select("s", "v", "paths")
        step = up.join(both.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").join(down, ["s", "w"]).withColumn("part", F.col("paths") * F.col("share"))
        flow = materialize(step.select("s", "v", "w", "part"), "flow")
        edge_parts.append(flow.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"), "part"))
        sums = flow.groupBy("s", "v").agg(F.sum("part").alias("delta"))
        below = materialize(up.join(sums, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")), "below")
        node_parts.append(below.select("s", "v", "delta"))
    nodes = node_parts[0]
    for x in node_parts[1:]:
        nodes = nodes.unionByName(x)
    passed = nodes.filter("s <> v").groupBy(F.col("v").alias("node")).agg(F.sum("delta").alias("passed"))
    reach = pairs.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("reach"), F.sum("d").cast("double").alias("hops"), F.sum(F.when(F.col("d") > 0, 1.0 / F.nullif("d", F.lit(0)))).alias("inverse"), F.max("d").cast("long").alias("far"))
    edges = edge_parts[0] if edge_parts else graph.links.select("src", "dst", F.lit(0.0).alias("part"))
    for x in edge_parts[1:]:
        edges = edges.unionByName(x)
    return reach.withColumn("inverse", F.coalesce("inverse", F.lit(0.0))), passed, edges.groupBy("src", "dst").agg(F.sum("part").alias("passed"))


def _packed(graph: Graph) -> tuple[list[str], Packed]:
    g = graph.local()
    return graph._once("packed", lambda: (g.names, Packed(g.n, g.a, g.b)))


def _blocks(graph: Graph, packed: Packed, width: int) -> DataFrame:
    """(lo, hi, s, e) of all blocks of sources, dealt over tasks."""
    rows = pd.DataFrame(packed.blocks(width), columns=["lo", "hi", "s", "e"])
    tasks = max(1, min(len(rows), graph.spark.sparkContext.defaultParallelism * 4))
    return graph.spark.createDataFrame(rows, "lo long, hi long, s long, e long").repartitionByRange(tasks, "s")


def _pairs_by_walks(graph: Graph) -> DataFrame:
    names, packed = _packed(graph)
    alone = sorted(set(range(len(names))) - set(packed.node.tolist()))
    shared = graph.spark.sparkContext.broadcast((pa.array([names[i] for i in packed.node], pa.string()), packed))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                dist, paths, _ = x.walks(*row.values())
                for j in range(dist.shape[1]):
                    to = np.flatnonzero(dist[:, j] >= 0)
                    source = pa.repeat(own[row["s"] + j], to.size)
                    yield pa.RecordBatch.from_arrays([source, own.take(pa.array(to + row["lo"])), pa.array(dist[to, j]), pa.array(paths[to, j])], names=["s", "v", "d", "paths"])

    schema = "s string, v string, d int, paths double"
    out = _blocks(graph, packed, packed.width(COLUMNS)).mapInArrow(walk, schema)
    return out.unionByName(graph.spark.createDataFrame([(names[i], names[i], 0, 1.0) for i in alone], schema)) if alone else out


def reach_sums(graph: Graph) -> DataFrame:
    """Per node (node, reach, hops, inverse, far): reachable nodes with itself, the sums of d and 1 / d over them, the largest d."""

    def make() -> DataFrame:
        if not graph.fits:
            return path_sums(graph)[0]
        names, packed = _packed(graph)
        shared = graph.spark.sparkContext.broadcast(packed)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = shared.value
            reach, hops, far = (np.zeros(x.node.size, dtype=np.int64) for _ in range(3))
            inverse = np.zeros(x.node.size)
            for batch in batches:
                for block in batch.itertuples(index=False):
                    for _, hop, at, c in x.hop_counts(*block):
                        reach[at] += c
                        hops[at] += c * hop
                        inverse[at] += c / hop
                        far[at] = np.maximum(far[at], hop)
            some = np.flatnonzero(reach)
            yield pd.DataFrame({"id": x.node[some], "reach": reach[some], "hops": hops[some], "inverse": inverse[some], "far": far[some]})

        found = _blocks(graph, packed, 64 * WORDS).mapInPandas(walk, "id long, reach long, hops long, inverse double, far long")
        found = materialize(found.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("reach", "hops", "inverse")], F.max("far").alias("far")), "reach")
        node = graph.spark.createDataFrame(pd.DataFrame({"id": np.arange(len(names)), "node": names}), "id long, node string")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return node.join(found, "id", "left").select("node", (zero("reach") + 1).alias("reach"), zero("hops").cast("double").alias("hops"), zero("inverse").cast("double").alias("inverse"), zero("far").alias("far"))

    return graph._once("reach_sums", make)


def path_sums(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per node as ``reach_sums``, per node (node, passed), per edge (src, dst, passed).

    passed sums over ordered pairs the share of their shortest paths through a node between them, or through an edge.
    """

    def make() -> tuple[DataFrame, DataFrame, DataFrame]:
        if not graph.fits:
            return _sums_by_join(graph)
        spark = graph.spark
        names, packed = _packed(graph)
        shared = spark.sparkContext.broadcast(packed)

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = shared.value
            node_sum, edge_sum = np.zeros(x.node.size), np.zeros(x.a.size)
            order = np.argsort(x.a, kind="stable")
            starts = x.a[order]
            for batch in batches:
                for lo, hi, s, e in batch.itertuples(index=False):
                    dist, paths, delta, share = x.passed(lo, hi, s, e)
                    node_sum[lo:hi] += delta.sum(axis=1)
                    edges = order[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
                    for some in np.array_split(edges, edges.size // 4096 + 1):
                        a, b = x.a[some] - lo, x.b[some] - lo
                        step = dist[b] - dist[a]
                        edge_sum[some] += np.where(step == 1, paths[a] * share[b], np.where(step == -1, paths[b] * share[a], 0.0)).sum(axis=1)
            for kind, ids, sums in ((1, x.node, node_sum), (2, np.arange(x.a.size), edge_sum)):
                some = np.flatnonzero(sums)
                yield pd.DataFrame({"kind": kind, "id": ids[some], "passed": sums[some]})

        found = _blocks(graph, packed, packed.width(COLUMNS)).mapInPandas(walk, "kind int, id long, passed double")
        found = materialize(found.groupBy("kind", "id").agg(F.sum("passed").alias("passed")), "paths")
        g = graph.local()
        node = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(names)), "node": names}), "id long, node string")
        ends = spark.createDataFrame(pd.DataFrame({"id": np.arange(g.a.size), "src": [names[i] for i in g.a], "dst": [names[i] for i in g.b]}), "id long, src string, dst string")
        sums = lambda kind: found.filter(F.col("kind") == kind).select("id", "passed")
        passed = node.join(sums(1), "id", "left").select("node", F.coalesce("passed", F.lit(0.0)).alias("passed"))
        edges = ends.join(sums(2), "id", "left").select("src", "dst", F.coalesce("passed", F.lit(0.0)).alias("passed"))
        return reach_sums(graph), passed, edges

    return graph._once("path_sums", make)


def node_passes(graph: Graph) -> DataFrame:
    """Per node (node, passed) of ``path_sums``, without what passes the edges and without walks from inside long chains."""

    def make() -> DataFrame:
        if not graph.fits or "path_sums" in graph._made:
            return path_sums(graph)[1]
        names, packed = _packed(graph)
        found = chains.chains_of(packed)
        shared = graph.spark.sparkContext.broadcast((packed, found))

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, c = shared.value
            sums = np.zeros(x.node.size)
            for batch in batches:
                for lo, hi, s, e, inside in batch.itertuples(index=False):
                    sums[lo:hi] += chains.passed_from_chains(x, c, np.arange(s, e), lo, hi) if inside else chains.passed_from_sources(x, c.sources[s:e], lo, hi)
            some = np.flatnonzero(sums)
            yield pd.DataFrame({"id": x.node[some], "passed": sums[some]})

        blocks = pd.DataFrame(chains.blocks_of(packed, found), columns=["lo", "hi", "s", "e", "inside"])
        tasks = max(1, min(len(blocks), graph.spark.sparkContext.defaultParallelism * 4))
        dealt = graph.spark.createDataFrame(blocks, "lo long, hi long, s long, e long, inside long").repartitionByRange(tasks, "inside", "s")
        sums = materialize(dealt.mapInPandas(walk, "id long, passed double").groupBy("id").agg(F.sum("passed").alias("passed")), "passes").toPandas()
        passed = np.zeros(len(names))
        passed[sums["id"].to_numpy()] = sums["passed"].to_numpy()
        return graph.table(passed=passed)

    return graph._once("node_passes", make)


def closeness(graph: Graph) -> DataFrame:
    """(node, closeness): reachable share times reachable nodes over hops (Wasserman and Faust)."""
    n = graph.n
    r = F.col("reach") - 1
    return reach_sums(graph).select("node", (ratio(r, F.col("hops")) * ratio(r, F.lit(n - 1))).alias("closeness"))


def betweenness(graph: Graph) -> DataFrame:
    n = graph.n
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return node_passes(graph).select("node", (F.col("passed") * scale).alias("betweenness"))


def edge_betweenness(graph: Graph) -> DataFrame:
    n = graph.n
    return path_sums(graph)[2].select("src", "dst", (F.col("passed") / F.lit(float(n * (n - 1)))).alias("edge_betweenness"))


def global_efficiency(graph: Graph) -> DataFrame:
    """One row: the mean of 1 / hops over all ordered pairs, 0 for pairs that aren't connected."""
    n = graph.n
    return reach_sums(graph).agg((F.coalesce(F.sum("inverse"), F.lit(0.0)) / F.lit(float(max(n * (n - 1), 1)))).alias("global_efficiency"))


def largest_component_paths(graph: Graph) -> DataFrame:
    """One row (largest_component_diameter, largest_component_mean_path) of the largest component; the smallest label wins a tie."""
    sizes = graph.components.groupBy("component").agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.desc("size"), "component").limit(1)
    inside = graph.components.join(F.broadcast(largest), "component").join(reach_sums(graph), "node")
    return inside.agg(F.coalesce(F.max("far"), F.lit(0)).cast("double").alias("largest_component_diameter"), ratio(F.sum("hops"), F.max("size") * (F.max("size") - 1)).alias("largest_component_mean_path"))
