"""Exact dedup by progressive refinement: length, then a prefix's hash, then the full hash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.text import SPACE_RUN, text_or_empty
from weftgraph.plans.shared import materialize, salted_join

_RUN = re.compile(rb"[\x20\x09-\x0D]+")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, slots: int = 1 << 21, digests: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept (and text_sha256 with ``digests``).

    Texts are equal when identical after each white-space run became one space. The row
    with the smallest id of a group stays. Defined cases: a null text is empty; rows that
    repeat an id and a text count each, and one of them stays; a null id sorts after all others;
    an empty table gives no rows; other columns are ignored, whatever their names.

    1. Lengths are counted; a length that occurs once is settled.
    2. Rows of the other lengths are counted by (length, hash of the first ``prefix_chars``).
    3. Only rows whose pair occurs twice have their full content hashed. They are told apart by a
       bitmap of ``slots`` bytes whose size doesn't grow with the input (a false hit only costs a hash),
       so no text is shuffled.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(text_or_empty("__text"), SPACE_RUN, " ")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    light = rows.select("__id", norm.alias("__n")).select("__id", F.length("__n").alias("len"), F.xxhash64(F.substring("__n", 1, prefix_chars)).alias("ph"))
    light = materialize(light, "lengths")
    lens = light.groupBy("len").count().filter("count > 1").select("len")
    pairs = salted_join(light, lens, ["len"], ["__id"], how="left_semi").groupBy("len", "ph").count().filter("count > 1")
    hit = pairs.select(F.pmod(F.xxhash64("len", "ph"), F.lit(slots)).cast("int").alias("slot")).distinct().toPandas()["slot"]
    bitmap = np.zeros(slots, dtype=np.uint8)
    bitmap[hit.to_numpy()] = 1
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value)
        for batch in batches:
            ids, slot, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            again = bits[slot] == 1
            digest = [hashlib.sha256(_RUN.sub(b" ", x.as_py())).hexdigest() if y or digests else None for x, y in zip(texts, again, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(again), pa.array(digest, pa.string())], names=["__id", "again", "sha"])

    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("again", T.BooleanType()), T.StructField("sha", T.StringType())])
    keyed = rows.withColumn("__n", norm).select("__id", F.pmod(F.xxhash64(F.length("__n"), F.xxhash64(F.substring("__n", 1, prefix_chars))), F.lit(slots)).cast("int").alias("slot"), text_or_empty("__text").cast("binary").alias("__text"))
    full = materialize(keyed.mapInArrow(hashed, schema), "digests")
    alone = full.filter("not again").select("__id", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    members = full.filter("again").groupBy("sha", "__id").agg(F.count("*").alias("m"))
    groups = members.groupBy("sha").agg(F.min("__id").alias("keep_id"), F.sum("m").alias("group_size"))
    grouped = salted_join(members, groups, ["sha"], ["__id"]).withColumn("nth", F.explode(F.expr("sequence(1L, m)")))
    grouped = grouped.select("__id", "keep_id", "group_size", (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "sha")
    out = alone.unionByName(grouped)
    return out.select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", *([F.col("sha").alias("text_sha256")] if digests else []))
