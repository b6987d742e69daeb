"""Reads: searches, details, nested documents and latest lists, for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rxspark.functions.text import strip
from rxspark.operators.scale import collect_in_parts, grams, rarest
from rxspark.session import stored

BUCKETS = 64  # hash buckets of an owner's rows before they are ranked together

NAME_GRAM = 3
MIN_QUERY = 2  # characters


def name_grams(drugs: DataFrame) -> DataFrame:
    """Postings ``gram, id``: the strings of up to NAME_GRAM characters in a drug's brand and molecules, in lower case, and the
    empty one for every drug that has a name. Publish it once; searches then touch the drugs that share a gram with them.

    A table of drugs is small for the postings it makes, some 60 a drug: its rows are dealt out to all tasks first, so that no task
    writes, or later reads, most of them."""
    text = lambda c: F.coalesce(F.lower(c), F.lit(""))
    every = [grams(text(c), F.lit(n)) for c in ("brand_name", "dci") for n in range(1, NAME_GRAM + 1)]
    spark = drugs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    named = drugs.filter("brand_name IS NOT NULL OR dci IS NOT NULL").select("id", "brand_name", "dci").repartition(tasks)
    return named.select("id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *every))).alias("gram"))


def search_drugs(
    drugs: DataFrame, components: DataFrame, queries: DataFrame | list[str], limit: int = 8, postings: DataFrame | None = None, q: str = "q"
) -> DataFrame:
    """Brand or molecule contains the query (case-insensitive, ``%`` and ``_`` are wildcards, a backslash is itself), for a table
    (or a short list) of queries.

    Brands that start with the query come first, then by brand and id; ``limit`` drugs a query. Queries are stripped and answered once
    each; the service refuses those under MIN_QUERY characters as they come, so they are left out. A query meets the drugs that hold its
    rarest gram in an equi-join with ``postings`` (of ``name_grams``), and these alone are compared with its pattern.
    """
    if not 1 <= limit <= 20:
        raise ValueError("between 1 and 20 drugs a query can be asked for")
    if isinstance(queries, list):
        queries = drugs.sparkSession.createDataFrame([(x,) for x in queries], f"{q} string")
    postings = stored(name_grams(drugs), "name-grams") if postings is None else postings
    asked = queries.filter(F.length(q) >= MIN_QUERY).select(strip(F.col(q)).alias("q")).distinct()
    asked = asked.withColumn("_like", F.replace("q", F.lit("\\"), F.lit("\\\\")))
    literal = F.filter(F.split(F.lower("q"), "[%_]"), lambda p: p != "")
    size = F.least(F.coalesce(F.array_max(F.transform(literal, F.length)), F.lit(0)), F.lit(NAME_GRAM))
    longest = F.filter(literal, lambda p: F.length(p) >= size)
    probes = F.when(size == 0, F.array(F.lit(""))).otherwise(F.flatten(F.transform(longest, lambda p: grams(p, size))))
    asked = asked.withColumn("gram", F.explode(probes))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    candidates = rarest(asked, ["q", "_like"], "gram", counts).join(postings, "gram").select("q", "_like", "id")
    main = components.filter("position = 1").groupBy(F.col("drug_id").alias("id")).agg(F.min("dci").alias("main"))
    like = lambda c, before: F.expr(f"{c} ILIKE concat('{before}', _like, '%')")
    hits = candidates.join(drugs, "id").filter(like("brand_name", "%") | like("dci", "%"))
    prefix = F.coalesce(like("brand_name", ""), F.lit(False))
    place = F.row_number().over(Window.partitionBy("q").orderBy(prefix.desc(), "brand_name", "id"))
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    return (
        hits.withColumn("place", place).filter(F.col("place") <= limit)
        .join(main, "id", "left")
        .select(
            "q", F.col("place").alias("position"), "id", "brand_name", "presentation", "dosage_raw",
            F.coalesce(F.when(F.col("main") != "", F.col("main")), F.col("dci")).alias("dci"),
            "labo_name", "atc_code", nonzero("price_ppv"), nonzero("price_hospital"), "product_type", "indications", "min_age",
            F.coalesce("is_psychoactive", F.lit(False)).alias("is_psychoactive"),
        )
    )


def drug_details(drugs: DataFrame, components: DataFrame) -> DataFrame:
    """Drugs with their molecules by position. The molecules come from one text cell per drug."""
    parts = components.groupBy(F.col("drug_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "dci"))).alias("components")
    )
    empty = F.array().cast("array<struct<position:int,dci:string>>")
    return drugs.join(parts, "id", "left").withColumn("components", F.coalesce("components", empty))


def _uuid_text(q: Column) -> Column:
    """Canonical form of any accepted spelling of a UUID, else null."""
    digits = F.lower(F.regexp_replace(F.regexp_replace(q, "^(urn:)?(uuid:)?", ""), r"[{}-]", ""))
    groups = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), groups)


def search_patients(patients: DataFrame, queries: DataFrame) -> DataFrame:
    """A whole number looks up the id, else a UUID the FHIR id, else nothing. One row per match."""
    q = strip(F.col("q"))
    number = q.rlike(r"^[+-]?\d+$")
    asked = queries.select(
        "q",
        F.when(number, q.try_cast("bigint")).alias("id"),
        F.when(~number, _uuid_text(q)).alias("fhir_patient_id"),
    )
    columns = ["q", *patients.columns]
    by_id = asked.select("q", "id").filter(F.col("id").isNotNull()).join(patients, "id").select(*columns)
    by_uuid = (
        asked.select("q", "fhir_patient_id")
        .filter(F.col("fhir_patient_id").isNotNull())
        .join(patients, "fhir_patient_id")
        .select(*columns)
    )
    return by_id.unionByName(by_uuid)


ALERT_ITEM = ["alert_type", "severity", "title", "detail"]


def _whole(parts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One sorted array per key from the arrays of its parts; the array of an only part is sorted already."""
    lists = parts.groupBy(*keys).agg(F.collect_list(name).alias("_lists"))
    whole = F.when(F.size("_lists") > 1, F.sort_array(F.flatten("_lists"))).otherwise(F.get("_lists", F.lit(0)))
    return lists.select(*keys, whole.alias(name))


def prescription_documents(
    prescriptions: DataFrame, lines: DataFrame, alerts: DataFrame, size: int = 10_000
) -> DataFrame:
    """Header with its lines, each with its alerts, and the number of both: one row per prescription, each line once,
    at every size. Up to about ``size`` items are listed in one place before the lists of a key are put together;
    a whole document has to fit into a row."""
    alert_lists = _whole(
        collect_in_parts(
            alerts.withColumnRenamed("line_id", "id"), ["prescription_id", "id"], F.struct(*ALERT_ITEM), "detail", "alerts", size,
        ),
        ["prescription_id", "id"], "alerts",
    )
    empty = F.array().cast("array<struct<alert_type:string,severity:string,title:string,detail:string>>")
    full = lines.join(alert_lists, ["prescription_id", "id"], "left").withColumn("alerts", F.coalesce("alerts", empty))
    item = F.struct("id", "drug_id", "dci", "dose_mg", "alerts")
    nested = _whole(collect_in_parts(full, ["prescription_id"], item, "id", "lines", size), ["prescription_id"], "lines")
    counted = history_counts(prescriptions, lines, alerts)
    return counted.join(nested.withColumnRenamed("prescription_id", "id"), "id", "left")


def flatten_response(documents: DataFrame) -> DataFrame:
    """All alerts of each document in one list, beside the counts it has."""
    return documents.withColumn("alerts", F.flatten(F.transform("lines", lambda l: l["alerts"])))


def history_counts(prescriptions: DataFrame, lines: DataFrame, alerts: DataFrame) -> DataFrame:
    """Line and alert count per prescription, from one aggregation over both tables."""
    tagged = lines.select(F.col("prescription_id").alias("id"), F.lit(1).alias("l"), F.lit(0).alias("a")).unionByName(
        alerts.select(F.col("prescription_id").alias("id"), F.lit(0).alias("l"), F.lit(1).alias("a"))
    )
    counts = tagged.groupBy("id").agg(F.sum("l").alias("line_count"), F.sum("a").alias("alert_count"))
    return prescriptions.join(counts, "id", "left").fillna(0, ["line_count", "alert_count"])


def latest_per_owner(prescriptions: DataFrame, owner: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Newest prescriptions per patient or doctor. Ranks are limited per owner and hash bucket first, so a busy
    owner's rows never meet in one task, however many are skipped."""
    newest = [F.desc("created_at"), F.desc("id")]
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
    near = (
        prescriptions.withColumn("_bucket", bucket)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(owner, "_bucket").orderBy(*newest)))
        .filter(F.col("_rank") <= skip + limit)
        .drop("_bucket", "_rank")
    )
    order = Window.partitionBy(owner).orderBy(*newest)
    return (
        near.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= skip + limit)
        .filter(F.col("position") > skip)
    )


def doctor_overview(
    prescriptions: DataFrame, lines: DataFrame, alerts: DataFrame, limit: int = 30, size: int = 10_000
) -> DataFrame:
    """Newest prescriptions per doctor as documents. Lines and alerts of others never get nested."""
    if not 1 <= limit <= 100:
        raise ValueError("between 1 and 100 prescriptions a doctor can be asked for")
    latest = stored(latest_per_owner(prescriptions, "doctor_id", 0, limit), "latest")  # read three times, and of a true size
    wanted = latest.select(F.col("id").alias("prescription_id"))
    return prescription_documents(
        latest,
        lines.join(wanted, "prescription_id", "left_semi"),
        alerts.join(wanted, "prescription_id", "left_semi"),
        size,
    )
