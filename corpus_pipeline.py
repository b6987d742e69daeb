"""From raw documents to tokens: five stages, each one text operator over everything the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.

Defined cases: null texts, and texts without a letter, leave in the first stage; a null language is filled in there. Of a group of near duplicates the
smallest id stays; rows that repeat an id stay or go together. Rows without an id take no part in the comparisons between
documents and stay. A text of which nothing is left after the third stage stays as an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxspark.llm import decontamination, language_id, near_dup, sentence_pieces, suffix_dedup
from rxspark.llm.common import read, small_batches, stored

ORACLE_SQL = None  # language codes, suffix arrays and pieces are beyond SQL; tests compare with brute force


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and give those without a language the one that the model finds: every text with a
    letter gets some learned language. If none was learned, letters decide alone."""
    small_batches(spark)  # for this and the later stages
    model = language_id.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model)
    found = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component of near duplicates."""
    found = near_dup.linked_classes(docs)
    later = found.filter(F.col("id") != F.col("component")).select(F.col("id").alias("_later")).distinct()
    return docs.join(later, docs["doc_id"] == F.col("_later"), "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every 100-byte passage that also stands earlier."""
    cut = suffix_dedup.suffix_dedup(docs, as_text=True)
    changed = {"text": F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns(changed).select(*docs.columns)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit, with begin and end), and whether they decode to the text again."""
    vocabulary = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    done = sentence_pieces.encode(docs, vocabulary)
    return done.withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_overlaps),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
