"""Drug catalogue: raw text columns to clean drugs and their molecules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rxspark.functions import text
from rxspark.operators.scale import dense_ids
from rxspark.session import stored

# fixed values: columns of a drug, in the order of the catalogue file
DRUG_COLUMNS = [
    "id", "brand_name", "presentation", "dosage_raw", "dci", "labo_name", "therapeutic_class", "status",
    "atc_code", "price_ppv", "price_hospital", "toxicity_class", "product_type", "indications",
    "is_psychoactive", "contraindications", "min_age", "source_url",
]


def clean_columns(nfc: bool = True) -> dict[str, Column]:
    def clean(name: str) -> Column:
        return text.clean_text(F.col(name), nfc)

    return {
        "brand_name": clean("brand_name_raw"),
        "presentation": clean("presentation_raw"),
        "dosage_raw": clean("dosage_raw_raw"),
        "dci": clean("composition_raw"),
        "labo_name": clean("labo_raw"),
        "therapeutic_class": clean("class_raw"),
        "status": text.clean_status(F.col("status_raw")),
        "atc_code": text.clean_atc(F.col("atc_raw")),
        "price_ppv": text.parse_price(F.col("ppv_raw")),
        "price_hospital": text.parse_price(F.col("hospital_raw")),
        "toxicity_class": text.clean_toxicity(F.col("toxicity_raw")),
        "product_type": clean("nature_raw"),
        "indications": clean("indications_raw"),
        "is_psychoactive": text.parse_flag(F.col("psycho_raw")),
        "contraindications": clean("contra_raw"),
        "min_age": text.normalize_min_age(F.col("age_raw")),
        "source_url": text.clean_link(F.col("link_raw"), nfc),
    }


def clean_catalogue(raw: DataFrame, nfc: bool = True) -> DataFrame:
    """All cleaned columns in one projection; rows without a brand name are dropped (composing letters leaves no
    name blank, so the test needs no Python). A raw file is small for the work it makes: its rows are dealt out over all tasks first."""
    tasks = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), raw.sparkSession.sparkContext.defaultParallelism)
    named = raw.repartition(tasks).filter(text.clean_text(F.col("brand_name_raw"), nfc=False).isNotNull())
    return named.select(*[c.alias(n) for n, c in clean_columns(nfc).items()])


def number_drugs(clean: DataFrame) -> DataFrame:
    """Ids 1..n by brand, ATC code and dosage; every other column breaks ties. Rows are written first: a range sort reads them twice."""
    clean = stored(clean, "clean-drugs")
    first = ["brand_name", "atc_code", "dosage_raw"]
    rest = [c for c in DRUG_COLUMNS if c in clean.columns and c not in (*first, "id")]
    return dense_ids(clean, [F.col(c).asc_nulls_first() for c in [*first, *rest]]).select(*DRUG_COLUMNS)


NATURAL_KEY = ["brand_name", "presentation", "dosage_raw", "labo_name"]


def keep_ids(clean: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drugs with ids that stay from load to load, and the map to hand to the next load.

    Every row is a drug of its own, also if it equals another one. Rows are known by their natural key and, among those with
    equal keys, by an occurrence. A row takes the id of a known row of its key: first of one with the same
    content, then, so that a new price or class keeps an id, the next that is left. Other rows get a new occurrence, and an id from a
    hash of key and occurrence, hashed again while it is taken. Ids of rows that are gone stay reserved.

    The map has ``natural, occurrence, content, id``. Equal rows are counted before rows of one key are numbered.
    """
    rest = [c for c in DRUG_COLUMNS if c != "id" and c not in NATURAL_KEY]
    digest = lambda columns: F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)  # noqa: E731  (nulls leave no field)
    numbered = lambda keys, order, name: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias(name)
    rows = (
        clean.select(digest(NATURAL_KEY).alias("natural"), digest(rest).alias("content"), F.struct(*NATURAL_KEY, *rest).alias("drug"))
        .groupBy("natural", "content").agg(F.first("drug").alias("drug"), F.count(F.lit(1)).alias("copies"))
        .select("natural", "content", "drug", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    )
    rows = stored(rows, "catalogue-rows")
    if known is None:
        known = clean.sparkSession.createDataFrame([], ID_MAP)
    # the same content first, copy by copy
    old = stored(known.select("*", numbered(["natural", "content"], ["occurrence"], "copy")), "known-ids")
    same = stored(rows.join(old.select("natural", "content", "copy", "occurrence", "id"), ["natural", "content", "copy"], "left"), "same-content")
    # then what is left of the key on both sides, in order
    left_new = same.filter("id IS NULL").drop("occurrence", "id").select("*", numbered(["natural"], ["content", "copy"], "place"))
    left_old = old.join(same.filter("id IS NOT NULL").select("id"), "id", "left_anti").select(
        "natural", "occurrence", "id", numbered(["natural"], ["occurrence"], "place")
    )
    again = left_new.join(left_old, ["natural", "place"], "left")
    last = known.groupBy("natural").agg(F.max("occurrence").alias("last"))
    fresh = stored(
        again.filter("id IS NULL").drop("occurrence", "id").join(last, "natural", "left")
        .withColumn("occurrence", (F.coalesce("last", F.lit(0)) + numbered(["natural"], ["place"], "n")).cast("int"))
        .select("natural", "content", "copy", "drug", "occurrence"),
        "new-drugs",
    )
    fresh = _new_ids(fresh, known.select("id"))
    columns = ["natural", "content", "copy", "drug", "occurrence", "id"]
    all_ = stored(
        same.filter("id IS NOT NULL").select(*columns).unionByName(again.filter("id IS NOT NULL").select(*columns)).unionByName(fresh.select(*columns)),
        "drugs-with-ids",
    )
    drugs = all_.select("id", "drug.*").select(*DRUG_COLUMNS)
    gone = known.join(all_.select("id"), "id", "left_anti")
    return drugs, all_.select("natural", "occurrence", "content", "id").unionByName(gone.select("natural", "occurrence", "content", "id"))


ID_MAP = "natural string, occurrence int, content string, id long"


def _new_ids(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` with an id from ``natural`` and ``occurrence`` that no other row has and that is not ``taken``."""
    rows = rows.withColumn("id", F.xxhash64("natural", "occurrence"))
    while True:
        order = F.row_number().over(Window.partitionBy("id").orderBy("natural", "occurrence"))
        clash = rows.withColumn("n", order).join(taken.select("id", F.lit(True).alias("old")), "id", "left")
        clash = stored(clash.withColumn("bad", F.coalesce("old", F.lit(False)) | (F.col("n") > 1)).drop("n", "old"), "new-ids")
        if clash.filter("bad").isEmpty():
            return clash.drop("bad")
        rows = clash.withColumn("id", F.when(F.col("bad"), F.xxhash64("id", "natural", "occurrence")).otherwise(F.col("id"))).drop("bad")


def split_molecules(drugs: DataFrame) -> DataFrame:
    """One row per molecule with its dense position. Positions come from the array: no window."""
    parts = F.transform(F.split("dci", r"\|"), text.collapse_spaces)
    kept = F.filter(parts, lambda p: F.length(p) > 1)
    return drugs.select(F.col("id").alias("drug_id"), F.posexplode(kept).alias("_pos", "dci")).select(
        "drug_id", "dci", (F.col("_pos") + 1).alias("position")
    )
