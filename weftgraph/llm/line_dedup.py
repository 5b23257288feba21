"""Line dedup with DataFrame functions only: explode, hash, count documents, drop, reassemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.text import lower_ascii, row_key, strip_spaces, text_or_empty
from weftgraph.plans.shared import salted_join


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return lower_ascii(strip_spaces(line))


def key_hash(key: Column) -> Column:
    """128 bits of a key: two keys meet by chance in 1e11 lines with a probability under 1e-16."""
    return F.unhex(F.md5(key))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, max_docs: int = 2) -> DataFrame:
    """Each row of ``docs`` as id, text (without its dropped lines), n_lines, n_dropped.

    A key of at least ``min_chars`` code points in more than ``max_docs`` documents loses all its lines
    but those of the largest id that holds it; the other lines stay in their order, joined by \\n.
    Defined cases: a null or empty text is one empty line; rows that repeat an id are one
    document for counting, and each is rewritten; rows with a null id count as one document, smaller than
    all others; an empty table gives no rows; other columns are ignored.

    Lines are exploded with their positions and travel as 16-byte hashes; hot ones are dealt over salts, and counts are summed before
    they are shuffled. A document is reassembled from the stretches between the positions it loses, in one pass over its lines; its text is shuffled
    once, to meet them.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).withColumn("__k", row_key(F.col("__id"), F.col("__text")))
    lines = rows.select("__k", "__id", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.filter(F.length("key") >= min_chars).select("__k", "__id", "pos", key_hash(F.col("key")).alias("h"))
    over = lines.select("__id", "h").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("__id").alias("last")).filter(F.col("n") > max_docs).select("h", "last")
    lost = salted_join(lines, over, ["h"], ["__k"]).filter(~F.col("__id").eqNullSafe(F.col("last")))
    lost = lost.groupBy("__k").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    whole = rows.join(lost, "__k", "left").withColumn("n_lines", F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1)
    return whole.select(
        F.col("__id").alias(id_col), F.when(F.col("gone").isNull(), F.col("__text")).otherwise(reassembled(F.split("__text", "\n", -1), F.col("gone"))).alias("text"), F.col("n_lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped")
    )


def reassembled(lines: Column, gone: Column) -> Column:
    """The lines between the sorted positions ``gone``, joined by \\n: one slice for each stretch, so the work is linear in the lines."""
    ends = lambda g: F.concat(F.array(F.lit(-1)), g)

    def stretches(x: Column) -> Column:
        return F.flatten(F.transform(F.arrays_zip(ends(x["gone"]).alias("a"), F.concat(x["gone"], F.array(F.size(x["lines"]))).alias("b")), lambda z: F.slice(x["lines"], z["a"] + 2, z["b"] - z["a"] - 1)))

    # Bound once: a plain reference inside the lambda would split the text for each stretch.
    return F.array_join(F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), stretches), 1), "\n")
