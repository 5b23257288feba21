"""What differs between two networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.communities import community_table
from weftgraph.operators.graph import Graph, ratio
from weftgraph.operators.measures import SUMMARY, long_form, network_summary
from weftgraph.plans.shared import materialize


def _node_side(graph: Graph, tag: str) -> DataFrame:
    """(node, degree_, centrality_): degrees of the graph as it is, in and out if directed; centralities of its projection."""
    raw = graph.degrees.select("node", "degree")
    if graph.directed:
        ends = graph.arcs.select(F.col("src").alias("node")).unionByName(graph.arcs.select(F.col("dst").alias("node")))
        raw = ends.groupBy("node").agg(F.count("*").alias("degree"))
    n = graph.n
    central = F.col("k") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return raw.join(graph.degrees.select("node", F.col("degree").alias("k")), "node").select("node", F.col("degree").alias(f"degree_{tag}"), central.alias(f"centrality_{tag}"))


def compare_networks(a: Graph, b: Graph) -> tuple[DataFrame, DataFrame]:
    """(metric, network_a, network_b, change) and, over all nodes of either, (node, degree_a, degree_b, degree_change,
    centrality_change, status, absolute_change)."""
    x = long_form(network_summary(a), list(SUMMARY), "network_a")
    y = long_form(network_summary(b), list(SUMMARY), "network_b")
    overall = x.join(y, "metric").withColumn("change", F.col("network_b") - F.col("network_a"))
    nodes = _node_side(a, "a").join(_node_side(b, "b"), "node", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(F.col("degree_a").isNull(), "gained").when(F.col("degree_b").isNull(), "lost").otherwise("shared")
    change = zero("degree_b") - zero("degree_a")
    nodes = nodes.select("node", zero("degree_a").alias("degree_a"), zero("degree_b").alias("degree_b"), change.alias("degree_change"), (zero("centrality_b") - zero("centrality_a")).alias("centrality_change"), status.alias("status"), F.abs(change).alias("absolute_change"))
    return overall, nodes.orderBy(F.desc("absolute_change"), "node")


def aligned(counts: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(community_b, community_b_aligned) for every community of B: one-to-one with the labels of A, the largest overlaps first.

    Works on the contingency table, one row for each pair of communities that share a node: in each round every pair
    that is the best left for both of its labels is matched, which gives what taking the best pair again and again does.
    Labels of B that find no partner get new ones, after the largest of A.
    """
    left = materialize(counts, "overlaps")
    matched = None
    rank = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "community_a", "community_b"))
    while not left.isEmpty():
        best = left.withColumn("ra", rank("community_a")).withColumn("rb", rank("community_b")).filter("ra = 1 and rb = 1").select("community_a", "community_b")
        best = materialize(best, "matches")
        matched = best if matched is None else matched.unionByName(best)
        left = materialize(left.join(best.select("community_a"), "community_a", "left_anti").join(best.select("community_b"), "community_b", "left_anti"), "overlaps")
    labels = b.select(F.col("community").alias("community_b")).distinct()
    if matched is None:
        return labels.withColumn("community_b_aligned", F.col("community_b"))
    top = a.agg(F.max("community").alias("top"))
    rest = labels.join(matched, "community_b", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("community_b")))
    rest = rest.join(F.broadcast(top)).select("community_b", (F.col("top") + F.col("nth")).cast("int").alias("community_b_aligned"))
    return matched.select("community_b", F.col("community_a").alias("community_b_aligned")).unionByName(rest)


def partition_agreement(common: DataFrame) -> DataFrame:
    """One row (common_nodes, adjusted_rand_index, normalized_mutual_information) of (node, community_a, community_b)."""
    cell = materialize(common.groupBy("community_a", "community_b").agg(F.count("*").cast("double").alias("c")), "cells")
    two = lambda c: F.sum(c * (c - 1) / 2)
    row, col = (cell.groupBy(k).agg(F.sum("c").alias("c")) for k in ("community_a", "community_b"))
    ab = cell.agg(F.sum("c").alias("n"), two(F.col("c")).alias("s"))
    part = lambda t, tag: t.agg(two(F.col("c")).alias(f"p{tag}"), F.sum(F.col("c") * F.ln("c")).alias(f"h{tag}"), F.count("*").alias(f"k{tag}"))
    mutual = cell.agg(F.sum(F.col("c") * F.ln("c")).alias("hab"))
    t = ab.join(F.broadcast(part(row, "a"))).join(F.broadcast(part(col, "b"))).join(F.broadcast(mutual))
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    expected = ratio(F.col("pa") * F.col("pb"), pairs)
    spread = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when(F.abs(spread) < 1e-12, F.lit(1.0)).otherwise(F.try_divide(F.col("s") - expected, spread))
    ha, hb = F.ln(n) - F.col("ha") / n, F.ln(n) - F.col("hb") / n
    mi = F.ln(n) + (F.col("hab") - F.col("ha") - F.col("hb")) / n
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(1.0)).otherwise(ratio(F.greatest(mi, F.lit(0.0)), (ha + hb) / 2))
    some = F.coalesce(n, F.lit(0.0)) > 0
    undefined = F.lit(float("nan"))
    return t.select(F.coalesce(n, F.lit(0.0)).cast("long").alias("common_nodes"), F.when(some, ari).otherwise(undefined).alias("adjusted_rand_index"), F.when(some, nmi).otherwise(undefined).alias("normalized_mutual_information"))


def compare_partitions(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary, assignments and flows of two (node, community) tables over their common nodes."""
    common = materialize(a.withColumnRenamed("community", "community_a").join(b.withColumnRenamed("community", "community_b"), "node"), "common")
    counts = common.groupBy("community_a", "community_b").agg(F.count("*").alias("count"))
    rows = common.join(F.broadcast(aligned(counts, a, b)), "community_b").withColumn("reassigned", F.col("community_a") != F.col("community_b_aligned"))
    rows = materialize(rows.select("node", "community_a", "community_b", "community_b_aligned", "reassigned"), "assignments")
    share = rows.agg(F.coalesce(F.avg(F.col("reassigned").cast("int")), F.lit(float("nan"))).alias("fraction_reassigned"))
    flows = rows.groupBy("community_a", "community_b_aligned").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "community_a", "community_b_aligned")
    return partition_agreement(common).join(F.broadcast(share)), rows.orderBy(F.desc("reassigned"), "node"), flows


def differential_community_analysis(a: Graph, b: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    return compare_partitions(community_table(a), community_table(b))
