"""Keyed loads, written as new versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from rxspark.sources import catalogue_files


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Existing rows stay as they are; new keys are added, the first row of a repeated new key wins."""
    if order:
        rest = [c for c in incoming.columns if c != key]
        incoming = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    added = incoming.select(*existing.columns).join(existing.select(key), key, "left_anti")
    return existing.unionByName(added)


def load_components(existing: DataFrame, incoming: DataFrame, drugs: DataFrame) -> DataFrame:
    """Molecules of known drugs replace those on the same (drug, position); others stay."""
    valid = accepted_components(incoming, drugs)
    kept = existing.join(valid.select("drug_id", "position"), ["drug_id", "position"], "left_anti")
    return kept.unionByName(valid.select(*existing.columns))


def accepted_components(incoming: DataFrame, drugs: DataFrame) -> DataFrame:
    known = drugs.select(F.col("id").alias("drug_id"))
    return incoming.filter(F.col("dci").isNotNull()).join(known, "drug_id", "left_semi").withColumn(
        "dci", F.trim("dci")
    )


def component_report(incoming: DataFrame, drugs: DataFrame) -> DataFrame:
    """Rows read, kept and skipped, in one pass over the molecules."""
    known = drugs.select(F.col("id").alias("drug_id"), F.lit(True).alias("known")).distinct()
    good = F.col("known").isNotNull() & F.col("dci").isNotNull()
    read = F.count(F.lit(1))
    return incoming.join(known, "drug_id", "left").agg(
        read.alias("read"), F.count_if(good).alias("kept"), (read - F.count_if(good)).alias("skipped")
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Incoming rows overwrite ``updated`` of the row with the same keys, or are added."""
    new = incoming.select(*keys, F.struct(*updated).alias("_new"))
    joined = existing.join(new, keys, "full_outer")
    is_new = F.col("_new").isNotNull()
    return joined.select(
        *[
            F.when(is_new, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in updated else F.col(c)
            for c in existing.columns
        ]
    )


def upsert_report(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Dry run: how many rows would be added, updated and left alone."""
    sides = existing.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        incoming.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    per_key = sides.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return per_key.agg(
        F.count_if((F.col("o") == 0) & (F.col("n") == 1)).alias("added"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("updated"),
        F.count_if((F.col("o") == 1) & (F.col("n") == 0)).alias("unchanged"),
    )


def load_catalogue(path: str, existing: DataFrame, out: str, header: bool = True) -> dict[str, int]:
    """Load the clean CSV into the drugs ``existing``, write the new version to ``out`` and count what became of every record.

    ``read`` and ``malformed`` records of the file; those with ``no_id``; ``duplicate`` ids in the file, of which the first
    record stays; ids ``present`` before, which stay as they are; and ``inserted`` ones. The counts are observed while the table is written:
    the file and the table are read once.
    """
    spark = existing.sparkSession
    records, ids, rows = Observation(), Observation(), Observation()
    flagged = catalogue_files.flagged_catalogue(spark, path, header).withColumn("_order", F.monotonically_increasing_id())
    flagged = flagged.observe(
        records, F.count(F.lit(1)).alias("records"), F.count_if(F.col("_malformed")).alias("malformed"),
        F.count_if(~F.col("_malformed") & ~catalogue_files.has_id()).alias("no_id"),
    )
    typed = catalogue_files.coerce_drugs(flagged.filter("NOT _malformed").drop("_malformed"))
    rest = [c for c in existing.columns if c != "id"]
    new = typed.groupBy("id").agg(F.min_by(F.struct(*rest), "_order").alias("_new"), F.count(F.lit(1)).alias("_copies"))
    new = new.observe(ids, F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate")).drop("_copies")
    old = existing.select("id", F.struct(*rest).alias("_old"))
    merged = old.join(new, "id", "full_outer").observe(
        rows, F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("present"),
        F.count_if(F.col("_old").isNull()).alias("inserted"), F.count(F.lit(1)).alias("total"),
    )
    kept = [F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col("_new")[c].cast(existing.schema[c].dataType)).alias(c) for c in rest]
    catalogue_files.write_parquet(merged.select("id", *kept), out)
    read = records.get["records"] - records.get["malformed"]
    return {"read": read, "malformed": records.get["malformed"], "no_id": records.get["no_id"], **ids.get, **rows.get}
