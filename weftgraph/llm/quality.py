"""Quality rules: features of each text, and lines that too many documents of one host share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.text import small_parts, text_or_empty
from weftgraph.plans.shared import materialize, salted_join

_SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"
_LONGS = pa.list_(pa.int64())


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    v = len(ids)
    if v == n:
        return 0
    pair = a[:-1] * v + a[1:]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * v + a[2:]
    order = np.argsort(window, kind="stable")
    same = np.diff(window[order]) == 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def text_features(text: str) -> tuple[int, int, int, int, int, list[bytes], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hash and words of each distinct normalised line."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    lines: dict[bytes, int] = {}
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if parts := line.lower().split():
            again += line in seen
            seen.add(line)
            key = b" ".join(parts)
            lines[key] = lines.get(key, 0) + len(parts)
    hashes = [hashlib.blake2b(k, digest_size=16).digest() for k in lines]
    return len(words), chars, symbols, again, repeated_words(words), hashes, list(lines.values())


def without_lines(text: str, gone: set[bytes]) -> str:
    """``text`` without the lines whose normalised hash is in ``gone``."""
    key = lambda line: hashlib.blake2b(b" ".join(line.encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest()
    return "\n".join(line for line in text.split("\n") if key(line) not in gone) if gone else text


def _left(text: pd.Series, gone: pd.Series) -> pd.Series:
    return pd.Series([without_lines(t, set() if g is None else set(g)) for t, g in zip(text, gone, strict=True)], dtype=object)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = 2, line_share: float = 0.0, depleted: float = 0.5, min_words: int = 50, repeat_percent: int = 50, salts: int = 16, texts: bool = False
) -> DataFrame:
    """Each row of ``docs`` as id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept.

    A normalised line (without white space at its ends, runs of it as one space, A-Z in lower case) of a host is above the limits when more than ``line_docs`` of the
    host's documents hold it, and more than ``line_share`` of them (by default any share: the limit is the same in hosts of any size). It is removed from all of those but the one with the
    smallest id. A document that loses more than ``depleted`` of its words is rejected, as is one that fails
    the base rules. Defined cases: a null or empty text has no words and fails; a null host is a host of its own; repeated
    rows count as one document and are judged alike; rows with a null id count as one document; an empty table gives no
    rows; other columns are ignored.

    With ``texts`` a last column, text, has what is left of each text (null: empty): its lines that weren't removed, as they were, joined by \n; lines without a word stay.

    Lines travel as 128-bit hashes, once a document; counts are summed before they are shuffled and hot lines are dealt over salts.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), text_or_empty(text_col).alias("__text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([rows.schema["__id"], rows.schema["__host"], *[T.StructField(c, T.LongType()) for c in names], T.StructField("hashes", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.LongType())), *([T.StructField("__text", T.StringType())] if texts else [])])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in small_parts(batch.column(2)):
                cols = list(zip(*map(text_features, texts), strict=True))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.list_(pa.binary())), pa.array(cols[6], _LONGS), *([part.column(2)] if "__text" in schema.names else [])], names=schema.names)

    feats = materialize(rows.mapInArrow(features, schema), "lines")
    held = feats.select("__id", "__host", F.explode(F.arrays_zip("hashes", "sizes")).alias("x")).select("__id", "__host", F.col("x.hashes").alias("h"), F.col("x.sizes").alias("words"))
    hosts = feats.select("__host", "__id").distinct().groupBy("__host").agg(F.count("*").alias("docs"))
    counts = held.select("__host", "h", "__id").distinct().groupBy("__host", "h").agg(F.count("*").alias("n"), F.min("__id").alias("first")).filter(F.col("n") > line_docs)
    counts = counts.join(hosts.withColumnRenamed("__host", "__hh"), F.col("__host").eqNullSafe(F.col("__hh"))).filter(F.col("n") > F.col("docs") * line_share).select("__host", "h", "first")
    lost = salted_join(held, counts, ["__host", "h"], ["__id"], salts).filter(~F.col("__id").eqNullSafe(F.col("first")))
    lost = lost.groupBy("__id", "__host", "h").agg(F.max("words").alias("words")).groupBy("__id", "__host").agg(F.sum("words").alias("lost_words"), *([F.collect_list("h").alias("__gone")] if texts else []))
    lost = lost.withColumnsRenamed({"__id": "__lid", "__host": "__lhost"})
    out = feats.join(lost, F.col("__id").eqNullSafe(F.col("__lid")) & F.col("__host").eqNullSafe(F.col("__lhost")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    gone = F.coalesce("lost_words", F.lit(0).cast("long"))
    return out.select(F.col("__id").alias(id_col), *names, failed.alias("base_failed"), gone.alias("lost_words"), (~failed & (gone <= depleted * F.col("n_words"))).alias("kept"), *([F.pandas_udf(_left, "string")("__text", "__gone").alias("text")] if texts else []))
