"""Decision log: snapshots, override verdicts, history, feeds and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rxspark.functions.text import strip
from rxspark.operators import explain
from rxspark.rules import OFTEN_IGNORED_SCORE

# fixed values: decision -> shown action
ACTIONS = {"ACCEPTED": "ALERT_ACCEPTED", "IGNORED": "ALERT_IGNORED", "OVERRIDE": "OVERRIDE"}


def snapshot_decisions(decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Decisions with the alert's type, severity and title at decision time; unknown alerts drop out."""
    shown = alerts.select(
        F.col("id").alias("alert_id"), "alert_type", F.col("severity").alias("alert_severity"),
        F.col("title").alias("alert_title"),
    )
    return decisions.join(shown, "alert_id")


def unknown_alerts(decisions: DataFrame, alerts: DataFrame) -> DataFrame:
    return decisions.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_anti")


def stored_decisions(decisions: DataFrame, alerts: DataFrame, verdicts: DataFrame | None = None, key: str = "alert_id") -> DataFrame:
    """Decisions as the log keeps them: the alert's snapshot, and for override texts the verdict's label and feedback. A model that
    gave no answer (no ``verdicts``) leaves both empty, but for texts that are too short for it."""
    if verdicts is None:
        verdicts = decisions.select(key, F.lit(None).cast("string").alias("verdict")).limit(0)
    return snapshot_decisions(explain.judge_decisions(decisions, verdicts, key), alerts)


def bulk_decisions(payloads: DataFrame, alerts: DataFrame, verdicts: DataFrame | None = None, key: str = "alert_id") -> DataFrame:
    """Payloads hold an array of decisions per prescription; each is stored as a single decision is."""
    flat = payloads.select("prescription_id", "doctor_id", F.inline("decisions"))
    return stored_decisions(flat, alerts, verdicts, key)


def history(audit: DataFrame) -> DataFrame:
    """All decisions by prescription, newest first. A range sort on the full key: a prescription with
    very many decisions is split over several tasks."""
    return audit.orderBy("prescription_id", F.desc("created_at"), F.desc("id"))


def recent(audit: DataFrame, k: int = 50) -> DataFrame:
    """The newest ``k`` decisions; as in the service, more than 200 are refused."""
    if not 1 <= k <= 200:
        raise ValueError("between 1 and 200 decisions can be asked for")
    return audit.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def to_actions(audit: DataFrame, action: str | None = None) -> DataFrame:
    shown = F.col("decision")
    for decision, name in ACTIONS.items():
        shown = F.when(F.col("decision") == decision, name).otherwise(shown)
    filled = lambda c, default: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default))
    mapped = audit.select(
        "id", F.col("created_at").alias("timestamp"), shown.alias("action"),
        filled("alert_severity", "NONE").alias("severity"),
        filled("alert_title", "—").alias("detail"),
        filled("alert_type", "—").alias("drug"),
        F.col("justification").alias("justif"),
        "justification_valid",
    )
    return mapped if action in (None, "all") else mapped.filter(F.col("action") == action)


def completeness(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per prescription: every alert decided, overrides without a text, may it be confirmed.

    The last decision on an alert counts.
    """
    last = decisions.groupBy("alert_id").agg(
        F.max_by(F.struct("decision", "justification"), F.struct("created_at", "decision")).alias("d")
    )
    missing = (F.col("d.decision") == "OVERRIDE") & (strip(F.coalesce("d.justification", F.lit(""))) == "")
    return (
        alerts.select(F.col("id").alias("alert_id"), "prescription_id")
        .join(last, "alert_id", "left")
        .groupBy("prescription_id")
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            F.bool_and(F.col("d.decision").isNotNull()).alias("all_decided"),
            F.count_if(F.coalesce(missing, F.lit(False))).alias("overrides_missing_text"),
        )
        .withColumn("can_confirm", F.col("all_decided") & (F.col("overrides_missing_text") == 0))
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("prescription_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("MAJOR", "MODERATE", "MINOR")]
    )


def _js_round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def score_band(alerts: DataFrame) -> DataFrame:
    """Badge text from the ignore score: often ignored with its percentage, else relevant with the rest."""
    score = F.col("ai_ignore_proba")
    often = F.concat(F.lit("Souvent ignoré ("), _js_round(score * 100).cast("string"), F.lit("%)"))
    relevant = F.concat(F.lit("Pertinent ("), _js_round((1 - score) * 100).cast("string"), F.lit("%)"))
    return alerts.withColumn(
        "badge", F.when(score >= OFTEN_IGNORED_SCORE, often).when(score.isNotNull(), relevant)
    )
