"""Edges that keep arriving: the canonical edge table as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.edges import number, stripped


def streamed_edges(rows: DataFrame, *, directed: bool = False, source: str = "source", target: str = "target", weight: str = "weight", time: str | None = None, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window?, src, dst, weight) of a stream of edge rows, cleaned as in a batch; rows without a numeric weight are left out.

    With ``time``, weights are summed by window and late rows are dropped after ``delay``, so state is bounded.
    """
    value = number(weight) if weight in rows.columns else F.lit(1.0)
    clean = rows.select(*([F.col(time).alias("at")] if time else []), stripped(source).alias("a"), stripped(target).alias("b"), value.alias("weight"))
    clean = clean.filter("a <> '' and b <> '' and a <> b and weight is not null")
    ends = [F.col("a").alias("src"), F.col("b").alias("dst")] if directed else [F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")]
    keys = [F.window("at", window).alias("window")] if time else []
    return (clean.withWatermark("at", delay) if time else clean).groupBy(*keys, *ends).agg(F.sum("weight").alias("weight"))
