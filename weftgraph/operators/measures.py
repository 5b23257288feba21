"""Whole-network descriptors, all joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.graph import KERNEL_EDGES, Graph, LocalGraph, ratio
from weftgraph.operators.paths import global_efficiency, largest_component_paths
from weftgraph.plans.shared import materialize


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c, product) of each triangle once; product multiplies its weights, each over the graph's largest.

    Edges point from the end with fewer neighbours to the other, so the wedges at a hub are few. The middle corner of a triangle has edges in and
    out: only edges between such middles and the corners next to them make wedges, so a graph of two sides makes none.
    """

    def make() -> DataFrame:
        k = graph.keys
        d = graph.degrees.select(*k, "node", "degree")
        top = graph.links.groupBy(*k).agg(F.max("weight").alias("top")) if k else graph.links.agg(F.max("weight").alias("top"))
        e = graph.links.join(d.withColumnsRenamed({"node": "src", "degree": "ds"}), [*k, "src"]).join(d.withColumnsRenamed({"node": "dst", "degree": "dd"}), [*k, "dst"])
        e = e.join(F.broadcast(top), k) if k else e.join(F.broadcast(top))
        up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
        o = materialize(e.select(*k, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"), F.greatest("ds", "dd").alias("d"), ratio(F.col("weight"), F.col("top")).alias("w")), "oriented")
        met = materialize(o.select(*k, F.col("y").alias("x")).distinct(), "targets")
        middle = materialize(o.select(*k, "x").join(met, [*k, "x"], "left_semi").distinct(), "middles")
        last = o.select(*k, F.col("x").alias("y"), F.col("y").alias("z"), F.col("w").alias("w3")).join(middle.withColumnRenamed("x", "y"), [*k, "y"], "left_semi")
        ends = materialize(last.select(*k, "z").distinct(), "ends")
        first = o.select(*k, "x", "y", F.col("d").alias("d1"), F.col("w").alias("w1")).join(middle.withColumnRenamed("x", "y"), [*k, "y"], "left_semi")
        far = o.select(*k, "x", F.col("y").alias("z"), F.col("d").alias("d2"), F.col("w").alias("w2")).join(ends, [*k, "z"], "left_semi")
        wedge = first.join(far, [*k, "x"]).filter("d1 < d2 OR (d1 = d2 AND y < z)")
        closed = wedge.join(last, [*k, "y", "z"])
        return materialize(closed.select(*k, F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("product")), "triangles")

    return graph._once("triangles", make)


def clustering(graph: Graph) -> DataFrame:
    """(node, triangles, clustering, weighted_clustering); nodes with fewer than two neighbours have 0."""
    k = graph.keys
    corner = triangles(graph).select(*k, F.explode(F.array("a", "b", "c")).alias("node"), F.cbrt("product").alias("root"))
    sums = corner.groupBy(*k, "node").agg(F.count("*").alias("t"), F.sum("root").alias("r"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return graph.degrees.join(sums, [*k, "node"], "left").select(
        *k, "node", F.coalesce("t", F.lit(0)).cast("long").alias("triangles"), ratio(2.0 * F.coalesce("t", F.lit(0)), pairs).alias("clustering"), ratio(2.0 * F.coalesce("r", F.lit(0.0)), pairs).alias("weighted_clustering")
    )


#: Wedges that are looked at together.
WEDGES = 1 << 20


def weighted_clustering(graph: Graph) -> DataFrame:
    """(node, weighted_clustering) of ``clustering``. Of a graph that fits, tasks take runs of edges and look up what closes their wedges in the sorted edges."""
    if graph.group or not graph.fits:
        return clustering(graph).select("node", "weighted_clustering")
    g, spark = graph.local(), graph.spark
    degree = np.diff(g.start)
    rank = np.empty(g.n, dtype=np.int64)
    rank[np.argsort(degree, kind="stable")] = np.arange(g.n)
    x, y = np.minimum(rank[g.a], rank[g.b]), np.maximum(rank[g.a], rank[g.b])
    order = np.lexsort((y, x))
    top = g.weight.max() if g.weight.size else 0.0
    shared = spark.sparkContext.broadcast((g.n, x[order], y[order], g.weight[order] / top if top else np.zeros(order.size)))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, x, y, w = shared.value
        code, start, root = x * n + y, np.searchsorted(x, np.arange(n + 1)), np.zeros(n)
        for batch in batches:
            for lo, hi in batch.itertuples(index=False):
                counts = start[y[lo:hi] + 1] - start[y[lo:hi]]
                e = np.repeat(np.arange(lo, hi), counts)
                far = np.arange(e.size) + np.repeat(start[y[lo:hi]] - np.cumsum(counts) + counts, counts)
                key = x[e] * n + y[far]
                by = np.minimum(np.searchsorted(code, key), code.size - 1)
                shut = code[by] == key
                e, far, by = e[shut], far[shut], by[shut]
                r = np.cbrt(w[e] * w[far] * w[by])
                for corner in (x[e], y[e], y[far]):
                    root += np.bincount(corner, weights=r, minlength=n)
        some = np.flatnonzero(root)
        yield pd.DataFrame({"id": some, "root": root[some]})

    ends = np.cumsum(np.bincount(x, minlength=g.n)[y[order]]) // WEDGES
    cuts = [*np.flatnonzero(np.diff(ends, prepend=-1)).tolist(), ends.size]
    runs = pd.DataFrame({"lo": cuts[:-1], "hi": cuts[1:]})
    tasks = max(1, min(len(runs), spark.sparkContext.defaultParallelism * 4))
    found = spark.createDataFrame(runs, "lo long, hi long").repartitionByRange(tasks, "lo").mapInPandas(close, "id long, root double").groupBy("id").agg(F.sum("root").alias("root")).toPandas()
    sums = np.zeros(g.n)
    sums[found["id"].to_numpy()] = found["root"].to_numpy()
    pairs = degree * (degree - 1)
    return graph.table(weighted_clustering=np.divide(2.0 * sums[rank], pairs, out=np.zeros(g.n), where=pairs > 0))


def _grouped(df: DataFrame, graph: Graph, *aggs) -> DataFrame:
    return df.groupBy(*graph.keys).agg(*aggs) if graph.keys else df.agg(*aggs)


def _joined(graph: Graph, *tables: DataFrame) -> DataFrame:
    """Tables of one row (or one a graph) side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, graph.keys) if graph.keys else out.join(F.broadcast(t))
    return out


def assortativity(graph: Graph) -> DataFrame:
    """(degree_assortativity): Pearson correlation of end degrees over both directions; NaN where undefined."""
    k = graph.keys
    d = graph.degrees.select(*k, "node", F.col("degree").cast("double").alias("g"))
    e = graph.links.join(d.withColumnsRenamed({"node": "src", "g": "x"}), [*k, "src"]).join(d.withColumnsRenamed({"node": "dst", "g": "y"}), [*k, "dst"])
    n, s, q, p = 2 * F.count("*"), F.sum(F.col("x") + F.col("y")), F.sum(F.col("x") ** 2 + F.col("y") ** 2), 2 * F.sum(F.col("x") * F.col("y"))
    value = F.try_divide(n * p - s * s, n * q - s * s)
    return _grouped(e, graph, F.when(F.count("*") >= 2, F.coalesce(value, F.lit(float("nan")))).otherwise(F.lit(float("nan"))).alias("degree_assortativity"))


def counts(graph: Graph) -> DataFrame:
    """(nodes, edges, density) of the graph as it is, directed or not."""
    nodes = _grouped(graph.degrees, graph, F.count("*").alias("nodes"))
    edges = _grouped(graph.arcs, graph, F.count("*").alias("edges"))
    n = F.col("nodes")
    return _joined(graph, nodes, edges).withColumn("density", ratio((1 if graph.directed else 2) * F.col("edges").cast("double"), n * (n - 1)))


def component_measures(graph: Graph) -> DataFrame:
    sizes = graph.components.groupBy(*graph.keys, "component").agg(F.count("*").alias("size"))
    return _grouped(sizes, graph, F.count("*").alias("components"), ratio(F.max("size"), F.sum("size")).alias("largest_component_fraction"))


def clustering_measures(graph: Graph) -> DataFrame:
    """(average_clustering, average_weighted_clustering, transitivity)."""
    c = clustering(graph).join(graph.degrees, [*graph.keys, "node"])
    return _grouped(c, graph, F.avg("clustering").alias("average_unweighted"), F.avg("weighted_clustering").alias("average_clustering"), ratio(2.0 * F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1))).alias("transitivity"))


SUMMARY = ("nodes", "edges", "density", "components", "largest_component_fraction", "average_clustering", "transitivity", "degree_assortativity")


def network_summary(graph: Graph) -> DataFrame:
    """One row of eight measures; counts and density of the graph as given, the rest of its undirected projection."""
    return _joined(graph, counts(graph), component_measures(graph), clustering_measures(graph), assortativity(graph)).select(*graph.keys, *SUMMARY)


def degree_measures(graph: Graph) -> DataFrame:
    return _grouped(graph.degrees, graph, F.avg("degree").alias("average_degree"), F.max("degree").alias("maximum_degree"), F.stddev_pop("degree").alias("degree_std"), F.avg("strength").alias("average_strength"))


#: Interpretations of the statistics table (fixed values).
MEANINGS = {
    "nodes": "Number of entities in the network.",
    "edges": "Number of observed interactions.",
    "density": "Fraction of possible interactions that are present.",
    "components": "Number of disconnected network regions.",
    "largest_component_fraction": "Fraction of nodes in the largest connected region.",
    "average_clustering": "Mean weighted tendency for neighbors to connect.",
    "transitivity": "Global fraction of connected triples that form triangles.",
    "degree_assortativity": "Preference for nodes to connect to similarly connected nodes.",
    "average_degree": "Mean number of interactions per node.",
    "maximum_degree": "Largest interaction count for any node.",
    "degree_std": "Variation in interaction counts.",
    "average_strength": "Mean sum of edge weights per node.",
    "global_efficiency": "Average inverse shortest-path distance.",
    "modularity": "Separation strength of detected communities.",
    "largest_component_diameter": "Longest shortest path in the largest component.",
    "largest_component_mean_path": "Mean shortest path within the largest component.",
}


def long_form(row: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "metric", value)


def network_statistics_table(graph: Graph, communities: DataFrame | None = None) -> DataFrame:
    """(metric, value, interpretation), sixteen rows, all of the undirected projection."""
    from weftgraph.operators.communities import community_table, modularity

    g = Graph(graph.links, isolated=graph.isolated, _made={k: v for k, v in graph._made.items() if k not in ("arcs", "links")}) if graph.directed else graph
    parts = communities if communities is not None else community_table(g)
    row = _joined(g, network_summary(g), degree_measures(g), global_efficiency(g), modularity(g, parts), largest_component_paths(g))
    meaning = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    return long_form(row, list(MEANINGS)).withColumn("interpretation", meaning[F.col("metric")])


def _walked(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
    """Components and the sum of 1 / hops of one graph, whose size was checked."""
    names = sorted(set(e["src"]) | set(e["dst"]))
    at = {x: i for i, x in enumerate(names)}
    g = LocalGraph(names, e["src"].map(at).to_numpy(), e["dst"].map(at).to_numpy(), e["weight"].to_numpy())
    sizes = np.bincount(g.parts())
    return pd.DataFrame({"graph": [key[0]], "components": [sizes.size], "largest_component_fraction": [sizes.max() / g.n], "inverse": [g.efficiency() * g.n * (g.n - 1)]})


def graph_feature_table(graphs: Graph) -> DataFrame:
    """Twelve features of every graph of a collection: the same pipelines, with the graph in each key.

    Hops of graphs up to a checked size are walked one graph a group; beyond it as frontier joins keyed by graph.
    """
    from weftgraph.operators.paths import all_pairs

    k = graphs.keys
    largest = counts(graphs).agg(F.max("edges")).first()[0] or 0
    if largest <= KERNEL_EDGES:
        walked = graphs.links.groupBy(*k).applyInPandas(_walked, f"graph string, components long, largest_component_fraction double, inverse double")
        tables = (walked.withColumnRenamed("graph", k[0]),)
    else:
        tables = (component_measures(graphs), all_pairs(graphs).filter("d > 0").groupBy(*k).agg(F.sum(1.0 / F.col("d")).alias("inverse")))
    row = _joined(graphs, counts(graphs), degree_measures(graphs), clustering_measures(graphs), assortativity(graphs), *tables)
    n = F.col("nodes")
    return row.select(*k, n.cast("double").alias("nodes"), F.col("edges").cast("double").alias("edges"), "density", "average_degree", "degree_std", F.col("maximum_degree").cast("double").alias("maximum_degree"), F.col("average_unweighted").alias("average_clustering"), "transitivity", F.nanvl("degree_assortativity", F.lit(0.0)).alias("assortativity"), F.col("components").cast("double").alias("components"), "largest_component_fraction", ratio(F.col("inverse"), n * (n - 1)).alias("global_efficiency"))
