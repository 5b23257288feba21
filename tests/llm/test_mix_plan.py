"""Slots of the mix, made from few rows, are never broadcast: their number grows with the words."""

from pyspark.sql import functions as F

from weftgraph.llm import mixing


def test_slots_are_not_broadcast(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 50).alias("text"), F.lit("s").alias("source"))
    pieces = mixing.mix_sources(docs)[1]
    assert pieces.count() >= 300
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "b#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
