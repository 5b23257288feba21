"""The thin queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language, line_dedup, lm, mixing, pii, quality, sentencepiece, shingle_join, suffix_dedup

#: Folder with the tokenizer files; a parameter of the encoder, never copied here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir))
    plain = F.filter("spans", lambda s: ~s["disguised"])
    counts = [F.size(F.filter("plain", (lambda k: lambda s: s["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    out = found.withColumn("plain", plain)
    return out.select("doc_id", *counts, F.sha2(_span_text(F.col("plain")), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix_sources(_documents(spark, sf_dir)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), digests=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language.identify(docs, language.learn_held_out(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(_documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece.encode_documents(_documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "round_trip")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_pii": op2_pii,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_suffix_array": op7_suffix_array,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_rules": op10_quality_rules,
}
