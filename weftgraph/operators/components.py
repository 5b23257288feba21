"""Connected components by smallest label, with pointer jumping between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.shared import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", group: str | None = None, max_rounds: int = 100) -> DataFrame:
    """(group?, node, component) for every node of an undirected edge table; component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so long
    chains shorten by half. Every round is written to the shared folder; only a count of changes reaches the
    driver. Messages are minima, so they are combined before they are shuffled. Null ends are ignored.
    """
    keys = [group] if group else []
    e = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = materialize(e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    start = both.groupBy(*keys, F.col("src").alias("node")).agg(F.min("dst").alias("m"))
    labels = materialize(start.select(*keys, "node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(*keys, F.col("node").alias("src"), "component"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        parents = labels.select(*keys, F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = step.join(parents, [*keys, "component"]).select(*keys, "node", "old", F.least("component", "up").alias("component"))
        done = materialize(jumped, "labels")
        labels = done.drop("old")
        if done.filter(F.col("old") != F.col("component")).isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
