"""The stages of the corpus pipeline: each applies an operator to all its documents and lets its decision take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language, mixing, sentencepiece, shingle_join
from weftgraph.llm.queries import TOKENIZERS
from weftgraph.llm.text import SPACE_RUN, named, row_key, text_or_empty


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that can be told, go; a null lang gets the one told.

    Defined cases: null and empty texts go; null ids and sources stay, repeated rows are judged alike; where nothing is labelled, no
    language is learned and all go; an empty table gives no rows; other columns, whatever their names, stay as they are.
    """
    return language.keep_identified(docs, language.learn_held_out(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of equal texts stays.

    Defined cases: null and empty texts are equal; of rows that repeat an id and a text one stays, the least by its other columns as JSON;
    a null id is the largest; an empty table gives no rows; other columns, whatever their names, stay as they are. Each text is shuffled once.
    """
    kept = exact_dedup.exact_dedup(docs, digests=True).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("__k"))
    sha = F.sha2(F.regexp_replace(text_or_empty("text"), SPACE_RUN, " "), 256)
    others = [named(c) for c in docs.columns if c != "text"]
    rows = docs.select(row_key(F.col("doc_id"), sha).alias("__k"), F.to_json(F.struct(*others)).alias("__order"), F.struct(*map(named, docs.columns)).alias("__row"))
    one = rows.join(kept, "__k", "left_semi").groupBy("__k").agg(F.min_by("__row", "__order").alias("__row"))
    return one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays: five-word shingles, similarity 0.8 or more.

    Defined cases: texts without a word are linked with nothing and stay; rows that share an id are one document and stay or go together, so do
    all rows without an id; an empty table gives no rows; other columns, whatever their names, stay as they are.
    """
    groups = shingle_join.jaccard_components(docs, shingle=5, percent=80)
    stay = groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(row_key(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).alias("__k")).distinct()
    rows = docs.select(row_key(F.col("doc_id")).alias("__k"), F.struct(*map(named, docs.columns)).alias("__row"))
    return rows.join(stay, "__k", "left_semi").select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: one row for each document and epoch.

    Defined cases: null and empty texts are never in the mix; a null source is a source; null ids are ids; repeated rows each have words of their own; an
    empty table gives no rows; other columns, whatever their names, stay as they are, but n_chars follows the text.
    """
    return mixing.mixed_texts(docs, mixing.mix_sources(docs)[1])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and round_trip of every row of the mix.

    Defined cases: null and empty texts have no ids; null ids are passed on; repeated rows are each encoded; an empty table gives no rows; other columns are left out.
    """
    return sentencepiece.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
