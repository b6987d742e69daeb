"""Streaming queries, run to the end of their input, and the ignore score."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxspark.operators import scoring, screening
from rxspark.plans.queries_catalogue import closed_thesaurus
from rxspark.plans.queries_records import order_events
from rxspark.plans.queries_screening import ALERTS_CTE, VIEWS, patients, profiles
from rxspark.plans.registry import Inputs, query
from rxspark.session import work_path
from rxspark.sources.clinical_views import AS_OF
from rxspark.streaming import jobs


# one patient in 23 and one drug in 389 is not known to the service
_ACCEPTED = """, unknown_drugs AS (SELECT DISTINCT prescription_id, drug_id FROM fx_lines WHERE drug_id % 389 = 0),
  orders AS (SELECT p.id, p.patient_id % 23 = 0 AS no_patient, (SELECT string_agg(cast(drug_id AS varchar), ',' ORDER BY drug_id)
      FROM unknown_drugs u WHERE u.prescription_id = p.id) AS missing
    FROM fx_prescriptions p WHERE EXISTS (SELECT 1 FROM fx_lines l WHERE l.prescription_id = p.id))"""


def _screened_stream(x: Inputs) -> str:
    """Order events as a file stream, screened batch by batch against published knowledge; the folder with the outputs."""
    root = work_path(x.spark, "stream-screening")
    order_events(x).write.parquet(f"{root}/orders")
    closed_thesaurus(x).write.parquet(f"{root}/thesaurus")
    # every batch looks its drugs and patients up in these: they lie in buckets of their ids, so that no batch moves them
    known_drugs = screening.co_located(profiles(x).filter("drug_id % 389 <> 0"), "drug_id")
    known_patients = screening.co_located(patients(x).filter("id % 23 <> 0"), "id")
    read = x.spark.read.parquet
    events = x.spark.readStream.schema(read(f"{root}/orders").schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/orders")
    jobs.screen_events(
        events, known_patients, known_drugs, read(f"{root}/thesaurus"), AS_OF, f"{root}/alerts", f"{root}/rejected",
        f"{root}/checkpoint", trigger={"availableNow": True},
    ).awaitTermination()
    return root


@query(
    "stream_screening", [*VIEWS, "fx_interactions_raw"],
    ALERTS_CTE + _ACCEPTED + """ SELECT prescription_id, rule, alert_type, severity, title, detail FROM alerts
      JOIN orders o ON o.id = prescription_id WHERE NOT no_patient AND missing IS NULL""",
)
def _stream_screening(x: Inputs):
    """Alerts of the accepted orders."""
    return x.spark.read.parquet(f"{_screened_stream(x)}/alerts").select(
        "prescription_id", "rule", "alert_type", "severity", "title", "detail"
    )


@query(
    "stream_rejections", VIEWS,
    _ACCEPTED + """ SELECT id, concat_ws(',', CASE WHEN no_patient THEN 'patient_unknown' END,
      CASE WHEN missing IS NOT NULL THEN 'drugs_unknown' END) AS reasons, coalesce(missing, '') AS missing_drugs
    FROM orders WHERE no_patient OR missing IS NOT NULL""",
)
def _stream_rejections(x: Inputs):
    """Orders that the stream refuses, with their reasons."""
    return x.spark.read.parquet(f"{_screened_stream(x)}/rejected").select(
        "id", F.array_join("reasons", ",").alias("reasons"), F.array_join("missing_drugs", ",").alias("missing_drugs")
    )


def _audit_stream(x: Inputs, root: str, copies: int = 1):
    rows = x.view("fx_audit").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")
    rows.write.parquet(f"{root}/audit")
    schema = x.spark.read.parquet(f"{root}/audit").schema
    return x.spark.readStream.schema(schema).parquet(f"{root}/audit")


@query(
    "stream_alert_rates", ["fx_audit"],
    """, copies AS (SELECT date_trunc('minute', created_at) + to_minutes(cast(s AS bigint)) AS window_end, alert_type
      FROM fx_audit, range(1, 6) r(s))
    SELECT window_end, alert_type, count(*) / 5.0 AS per_minute FROM copies
    WHERE window_end <= (SELECT date_trunc('millisecond', max(created_at)) - INTERVAL 10 MINUTE FROM fx_audit) GROUP BY ALL""",
)
def _stream_rates(x: Inputs):
    """Sliding alert rates; a window is final once the watermark has passed its end."""
    root = work_path(x.spark, "stream-rates")
    rates = jobs.windowed_rates(_audit_stream(x, root), "created_at", ["alert_type"])
    jobs.append_to_parquet(rates, f"{root}/rates", f"{root}/checkpoint").awaitTermination()
    return x.spark.read.parquet(f"{root}/rates").withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("stream_audit_sink", ["fx_audit"], "SELECT id, decision, alert_type, created_at FROM fx_audit")
def _stream_audit(x: Inputs):
    """Every decision arrives twice, the second time up to two days later, and its first version is stored once."""
    root = work_path(x.spark, "stream-audit")
    rows = x.view("fx_audit").withColumn("created_at", F.col("created_at").cast("timestamp"))
    later = rows.withColumns({"created_at": F.timestamp_add("hour", F.col("id") % 50 + 1, "created_at"), "decision": F.lit("LATE")})
    # the first run holds some decisions in both versions, the others come again in the second
    for part, df in (("one", rows.unionByName(later.filter("id % 4 = 0"))), ("two", later.filter("id % 4 <> 0"))):
        df.write.parquet(f"{root}/audit/{part}")
        events = x.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/audit")
        jobs.audit_sink(events, "created_at", "id", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return x.spark.read.parquet(f"{root}/out").select("id", "decision", "alert_type", F.col("created_at").cast("timestamp_ntz"))


@query("ignore_scores")
def _ignore_scores(x: Inputs):
    """Model fitted on the whole audit log, then applied to it."""
    log = x.view("fx_audit")
    model = scoring.fit_ignore_model(log)
    return scoring.score_alerts(model, log.select("id", "alert_type", "alert_severity", "created_at"))
