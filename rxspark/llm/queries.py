"""Queries of the text operators over the test tables: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxspark.llm import (
    decontamination, language_id, lattice_model, near_dup, periodic_runs, quality_classifier, quality_rules, resampling, sentence_pieces, sharding,
    sql, toxicity, url_filter,
)
from rxspark.llm.common import fold, read, small_batches, stored
from rxspark.llm.suffix_dedup import suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op12_sharding": sql.SHARDING, "op13_importance_resampling": sql.RESAMPLING}


def query(make: Callable[[SparkSession, str], DataFrame]):
    QUERIES[make.__name__] = make
    return make


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, length=100).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    found = language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte")


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_dup.linked_classes(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"),
    )


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    done = sentence_pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, keep=["doc_id"])
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    done = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return done.drop("text")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stored(quality_classifier.with_statistics(docs, keep=["doc_id"]), "statistics")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = quality_classifier.fit(stats.filter(~held_out).withColumnRenamed("doc_id", "id"), labels)
    return quality_classifier.score(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    done = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return done.select("page_id", "host", "path", "rule", "verdict", "difference")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    labels = labels.filter(fold(F.col("id"), 5) != 0)
    odds = toxicity.fit(docs, labels)
    found = stored(toxicity.passages(docs, odds, keep=["doc_id"]), "passages")
    return toxicity.score(found, labels).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_significant"
    )


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    counts = lattice_model.count(docs.filter(~held_out))
    lattice = lattice_model.fit(counts, sentence_pieces.load(public_tokenizers.path("piece_bpe_32k.model")))
    done = lattice_model.score(docs, counts, lattice, keep=["doc_id"])
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _made_periodic(doc_id: Column, text: Column) -> Column:
    """The text; for ids whose checksum ends in 0, with everything from some word on replaced by repetitions of its first words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    periods = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.slice(F.concat(F.slice(words, F.lit(1), a), periods), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs, keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div (-longest.period)").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign(sharding.measured(docs).drop("text"), ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position"
    )


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gain = resampling.gains(resampling.count(docs), resampling.count(read(spark, sf_dir, "benchmark")))
    done = resampling.draw(resampling.weigh(docs, gain, keep=["doc_id"]))
    return done.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
