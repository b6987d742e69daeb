"""End-to-end jobs: publish the knowledge tables, then screen against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxspark.operators import catalogue, intake, screening, thesaurus
from rxspark.sources import catalogue_files


@dataclass
class Knowledge:
    drugs: DataFrame
    components: DataFrame
    profiles: DataFrame
    thesaurus: DataFrame


def publish_catalogue(raw: DataFrame, out: str, previous: str | None = None) -> None:
    """Clean the raw catalogue and write drugs, the map of their ids, molecules and drug profiles.

    Drugs keep the ids that they had in the catalogue published at ``previous``.

    Each table is written once and read back, so nothing is computed twice, and later joins see the
    true size of the files when Spark decides about a broadcast.
    """
    spark = raw.sparkSession
    clean = catalogue.clean_catalogue(catalogue_files.rename_headers(catalogue_files.require_records(raw)))
    drugs, ids = catalogue.keep_ids(clean, spark.read.parquet(f"{previous}/drug_ids") if previous else None)
    catalogue_files.write_parquet(drugs, f"{out}/drugs")
    catalogue_files.write_parquet(ids, f"{out}/drug_ids")
    drugs = spark.read.parquet(f"{out}/drugs")
    catalogue_files.write_parquet(catalogue.split_molecules(drugs), f"{out}/components")
    components = spark.read.parquet(f"{out}/components")
    catalogue_files.write_parquet(screening.drug_profiles(drugs, components), f"{out}/profiles")


def publish_thesaurus(words: DataFrame, out: str) -> None:
    """Rebuild, fix, deduplicate and close the interaction thesaurus. Source order is document, block, record."""
    rows = thesaurus.rebuild_interactions(words)
    order = F.struct("doc_id", "block", "record")
    numbered = rows.withColumn("ord", order).drop("doc_id", "block", "record")
    catalogue_files.write_parquet(thesaurus.build_thesaurus(numbered), f"{out}/thesaurus")


def load_knowledge(spark: SparkSession, path: str) -> Knowledge:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Knowledge(read("drugs"), read("components"), read("profiles"), read("thesaurus"))


def screen_all(
    knowledge: Knowledge, prescriptions: DataFrame, lines: DataFrame, patients: DataFrame, as_of: str, out: str
) -> None:
    """Check references, write the rejected prescriptions with their reasons, screen the others and write the alerts."""
    checked = intake.check_references(prescriptions, lines, patients, knowledge.drugs)
    catalogue_files.write_parquet(checked, f"{out}/checked")
    checked = prescriptions.sparkSession.read.parquet(f"{out}/checked")
    accepted = checked.filter("accepted").select(F.col("id").alias("prescription_id"))
    alerts = screening.screen(
        prescriptions, lines.join(accepted, "prescription_id", "left_semi"), patients, knowledge.profiles, knowledge.thesaurus, as_of
    )
    catalogue_files.write_parquet(alerts, f"{out}/alerts")
