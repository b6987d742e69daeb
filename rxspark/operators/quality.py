"""Profiling of the catalogue and the thesaurus, each in one aggregation pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rxspark.rules import SEVERITY_RANK

PROFILED = [
    "brand_name", "dci", "labo_name", "atc_code", "price_ppv", "price_hospital", "toxicity_class",
    "product_type", "therapeutic_class",
]


def _unpivot(one_row: DataFrame, name: str, columns: list[str], *value_names: str) -> DataFrame:
    """One row of struct columns to one row per column."""
    entries = [F.struct(F.lit(c).alias(name), *[F.col(c)[v].alias(v) for v in value_names]) for c in columns]
    return one_row.select(F.inline(F.array(*entries)))


def fill_rates(drugs: DataFrame, columns: list[str] = PROFILED) -> DataFrame:
    total = F.count(F.lit(1))
    aggs = [
        F.struct(
            F.count(c).alias("filled"),
            total.alias("total"),
            F.bround(100.0 * F.count(c) / F.nullif(total, F.lit(0)), 1).alias("fill_pct"),
        ).alias(c)
        for c in columns
    ]
    return _unpivot(drugs.agg(*aggs), "column_name", columns, "filled", "total", "fill_pct")


def toxicity_distribution(drugs: DataFrame) -> DataFrame:
    return drugs.groupBy("toxicity_class").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("toxicity_class").asc_nulls_first()
    )


def product_type_distribution(drugs: DataFrame) -> DataFrame:
    return drugs.groupBy("product_type").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.col("product_type").asc_nulls_first()
    )


def multi_molecule_share(drugs: DataFrame) -> DataFrame:
    multi, total = F.count_if(F.contains(F.col("dci"), F.lit("|"))), F.count(F.lit(1))
    return drugs.agg(
        multi.alias("multi"), total.alias("total"),
        F.bround(100.0 * multi / F.nullif(total, F.lit(0)), 1).alias("multi_pct"),
    )


def thesaurus_stats(rows: DataFrame) -> DataFrame:
    """Totals, distinct sides, rows per severity (zeros shown), rows with texts."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    stats = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("dci_a").alias("distinct_a"),
        F.count_distinct("dci_b").alias("distinct_b"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        filled("mechanism").alias("with_mechanism"),
        filled("recommendation").alias("with_recommendation"),
    )
    names = stats.columns
    return stats.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names]))
    )


def level_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level_fr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level_fr")


def severity_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "severity")


def top_molecules(rows: DataFrame, k: int = 5) -> DataFrame:
    return (
        rows.groupBy("dci_a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dci_a").limit(k)
    )


def load_reconciliation(raw: DataFrame) -> DataFrame:
    """Thesaurus rows read, removed as repeats of a pair, and added by the symmetric closure.

    One pass: an unordered pair knows how many rows it has and which of its two orders occur.
    """
    forward = F.col("dci_a") <= F.col("dci_b")
    pairs = raw.groupBy(F.least("dci_a", "dci_b").alias("lo"), F.greatest("dci_a", "dci_b").alias("hi")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(forward.cast("int")).alias("ab"), F.max((~forward).cast("int")).alias("ba")
    )
    one = pairs.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("read"), F.coalesce(F.sum(F.col("ab") + F.col("ba")), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), 1).otherwise(2)), F.lit(0)).alias("closed"),
    )
    return one.select(
        "read", (F.col("read") - F.col("kept")).alias("removed"), "kept",
        (F.col("closed") - F.col("kept")).alias("added"), "closed",
    )
