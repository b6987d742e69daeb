"""Catalogue files: raw CSV in, clean Parquet and CSV out, and the checks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rxspark.functions.text import parse_flag, strip
from rxspark.operators.catalogue import DRUG_COLUMNS
from rxspark.rules import CATALOGUE_HEADERS

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_raw_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. Quoted texts hold line breaks, so a file is one task: split the
    catalogue into many files to read it in parallel."""
    return spark.read.options(**CSV_OPTIONS, multiLine="true").csv(path)


def rename_headers(raw: DataFrame) -> DataFrame:
    """French headers to column names; all 17 must be there."""
    missing = [h for h in CATALOGUE_HEADERS if h not in raw.columns]
    if missing:
        raise ValueError(f"missing catalogue columns: {missing}")
    return raw.withColumnsRenamed(CATALOGUE_HEADERS)


def ingest_gate(raw: DataFrame) -> DataFrame:
    """One row: number of records and whether there is at least one."""
    n = F.count(F.lit(1))
    return raw.agg(n.alias("records"), (n >= 1).alias("ok"))


def require_records(raw: DataFrame) -> DataFrame:
    if raw.isEmpty():
        raise ValueError("the catalogue holds no record")
    return raw


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Doubled quotes, so any CSV reader undoes them."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in DRUG_COLUMNS] + [T.StructField("_bad", T.StringType())]
)


def flagged_catalogue(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Clean CSV as text, every record, with ``_malformed``: more fields than columns. Records with fewer lack the last ones."""
    rows = (
        spark.read.options(**{**CSV_OPTIONS, "header": str(header).lower()}, multiLine="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        .schema(CLEAN_SCHEMA)
        .csv(path)
    )
    fields = F.regexp_count(F.regexp_replace("_bad", r'"(?:[^"]|"")*"', ""), F.lit(",")) + 1
    return rows.withColumn("_malformed", F.coalesce(fields > len(DRUG_COLUMNS), F.lit(False))).drop("_bad")


def read_clean_catalogue(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Clean CSV as text without malformed records."""
    return flagged_catalogue(spark, path, header).filter("NOT _malformed").drop("_malformed")


def has_id() -> Column:
    """Whether the id is a whole number; file footers have none."""
    return F.coalesce(F.col("id").rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))


def coerce_drugs(rows: DataFrame) -> DataFrame:
    """Typed drugs. Rows without an id drop out."""
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("float"))
    typed = {
        "id": strip(F.col("id")).try_cast("bigint"),
        "price_ppv": number("price_ppv"),
        "price_hospital": number("price_hospital"),
        "is_psychoactive": parse_flag(F.col("is_psychoactive").cast("string")),
    }
    return rows.filter(has_id()).withColumns(
        {c: e for c, e in typed.items() if c in rows.columns}
    )


def write_audit_csv(audit: DataFrame, path: str, mark: bool = False) -> None:
    """The export as CSV; with ``mark``, every file begins with a byte order mark, by which spreadsheets know UTF-8."""
    rows = export_columns(audit)
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode("overwrite").options(**CSV_OPTIONS, emptyValue="").csv(path)


def export_columns(audit: DataFrame) -> DataFrame:
    """The eight export columns; nulls become empty text."""
    # fixed values: export headers and date format
    headers = {
        "id": "ID", "created_at": "Date", "decision": "Décision", "alert_type": "Type alerte",
        "alert_severity": "Sévérité", "alert_title": "Titre alerte", "justification": "Justification",
        "justification_valid": "Validation sémantique",
    }
    shown = {c: F.col(c).cast("string") for c in headers}
    shown["created_at"] = F.date_format("created_at", "dd/MM/yyyy HH:mm:ss")
    return audit.select(*[F.coalesce(shown[c], F.lit("")).alias(h) for c, h in headers.items()])


