"""k-cores, articulation nodes and bridges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.centrality import node_metrics
from weftgraph.operators.communities import community_table
from weftgraph.operators.graph import Graph, LocalGraph, ratio
from weftgraph.operators.paths import betweenness, edge_betweenness
from weftgraph.plans.shared import materialize


def core_numbers(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(node, core): peeling on arrays up to a checked size, beyond it h-index iteration. Each round a node takes the largest h such that h neighbours have h or more.

    The values fall from the degrees to the core numbers (Lü et al. 2016). A hub's neighbours are first counted by value,
    capped at its own value, so the window runs over distinct values, not over neighbours.
    """
    if graph.fits:
        return graph.table(core=graph.local().cores())
    return _cores_by_join(graph, max_rounds)


def _cores_by_join(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    both = materialize(graph.both.select("u", "v"), "arcs")
    core = materialize(graph.degrees.select("node", F.col("degree").alias("core")), "core")
    for _ in range(max_rounds):
        near = both.join(core.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), F.col("core").alias("near"))
        near = near.join(core, "node").groupBy("node", F.least("near", "core").alias("value")).agg(F.count("*").alias("c"), F.max("core").alias("own"))
        many = F.sum("c").over(Window.partitionBy("node").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
        h = near.withColumn("many", many).groupBy("node").agg(F.max(F.least("many", "value")).alias("h"))
        done = materialize(core.join(h, "node", "left").select("node", F.col("core").alias("old"), F.coalesce("h", F.lit(0)).cast("long").alias("core")), "core")
        core = done.drop("old")
        if done.filter("core <> old").isEmpty():
            return core
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def core_periphery_table(graph: Graph) -> DataFrame:
    """(node, core_number, core_score, role, degree): the innermost nodes first."""
    core = core_numbers(graph)
    top = core.agg(F.max("core").alias("top"))
    score = ratio(F.col("core"), F.greatest(F.col("top"), F.lit(1)))
    role = F.when(F.col("core") == F.col("top"), "maximal core").when(F.col("score") >= 0.5, "inner shell").otherwise("periphery")
    out = core.join(F.broadcast(top)).join(graph.degrees, "node").withColumn("score", score)
    return out.select("node", F.col("core").alias("core_number"), F.col("score").alias("core_score"), role.alias("role"), "degree").orderBy(F.desc("core_number"), F.desc("degree"), "node")


def cuts(g: LocalGraph) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], int]:
    """([(node, pieces it falls apart into, largest remaining piece overall)], [(edge, components after)], components).

    One depth-first walk (Hopcroft and Tarjan) with subtree sizes: each subtree that can't get past a node is a piece.
    """
    start, neighbours, edge = g.start.tolist(), g.neighbours.tolist(), g.edge.tolist()
    seen, low, size = [-1] * g.n, [0] * g.n, [1] * g.n
    clock, nodes, edges, roots = 0, [], [], []
    pieces: dict[int, list[int]] = {}
    comp_of: list[int] = [-1] * g.n
    comp_size: list[int] = []
    for root in range(g.n):
        if seen[root] >= 0:
            continue
        roots.append(root)
        first = clock
        seen[root] = low[root] = clock
        clock += 1
        comp_of[root] = len(comp_size)
        stack = [(root, -1, start[root])]
        while stack:
            u, by, at = stack[-1]
            if at < start[u + 1]:
                stack[-1] = (u, by, at + 1)
                v, e = neighbours[at], edge[at]
                if e == by:
                    continue
                if seen[v] < 0:
                    seen[v] = low[v] = clock
                    clock += 1
                    comp_of[v] = len(comp_size)
                    stack.append((v, e, start[v]))
                else:
                    low[u] = min(low[u], seen[v])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p], size[p] = min(low[p], low[u]), size[p] + size[u]
                    if low[u] >= seen[p]:
                        pieces.setdefault(p, []).append(size[u])
                    if low[u] > seen[p]:
                        edges.append(by)
        comp_size.append(clock - first)
    k = len(comp_size)
    by_size = sorted(comp_size, reverse=True)
    for p, own in pieces.items():
        whole = comp_size[comp_of[p]]
        rest = whole - 1 - sum(own)
        parts = own + ([rest] if rest else [])
        if len(parts) > 1:
            other = by_size[1] if by_size[0] == whole and k > 1 else by_size[0] if by_size[0] != whole else 0
            nodes.append((p, k - 1 + len(parts), max(*parts, other)))
    return nodes, [(e, k + 1) for e in edges], k


def bridge_analysis(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Articulation nodes (node, betweenness, components_after_removal, largest_component_after) and bridges
    (source, target, edge_betweenness, components_after_removal), the most disruptive first."""
    g = graph.local("bridge_analysis")
    nodes, edges, _ = cuts(g)
    spark = graph.spark
    at = spark.createDataFrame(pd.DataFrame([(g.names[i], c, s) for i, c, s in nodes], columns=["node", "components_after_removal", "largest_component_after"]), "node string, components_after_removal long, largest_component_after long")
    by = spark.createDataFrame(pd.DataFrame([(g.names[g.a[e]], g.names[g.b[e]], c) for e, c in edges], columns=["source", "target", "components_after_removal"]), "source string, target string, components_after_removal long")
    # Flows are walked from all nodes, so only where a cut needs them.
    none = lambda name, *key: spark.createDataFrame([], ", ".join([*[f"{k} string" for k in key], f"{name} double"]))
    between = betweenness(graph) if nodes else none("betweenness", "node")
    at = at.join(between, "node", "left").select("node", "betweenness", "components_after_removal", "largest_component_after").orderBy(F.desc("components_after_removal"), F.desc("betweenness"), "node")
    flows = (edge_betweenness(graph) if edges else none("edge_betweenness", "src", "dst")).withColumnsRenamed({"src": "source", "dst": "target"})
    by = by.join(flows, ["source", "target"], "left").select("source", "target", "edge_betweenness", "components_after_removal").orderBy(F.desc("components_after_removal"), F.desc("edge_betweenness"), "source", "target")
    return at, by


def structural_node_table(graph: Graph, communities: DataFrame | None = None) -> DataFrame:
    """Centralities, community (of the given partition, else of ``community_table``), core role and articulation of every node."""
    parts = communities if communities is not None else community_table(graph)
    cut = bridge_analysis(graph)[0].select("node", F.lit(True).alias("is_articulation"))
    out = node_metrics(graph).join(parts, "node", "left").join(core_periphery_table(graph).drop("degree"), "node", "left").join(cut, "node", "left")
    return out.withColumn("is_articulation", F.coalesce("is_articulation", F.lit(False)))
