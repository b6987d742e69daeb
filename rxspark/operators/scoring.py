"""Dose units, dose outliers and the ignore score of alerts."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

# fixed values: milligrams per unit
UNIT_MG = {"g": 1000.0, "mg": 1.0, "µg": 0.001, "μg": 0.001, "ug": 0.001, "mcg": 0.001}
_UNIT = r"(?i)^\s*(\d+(?:[.,]\d+)?)\s*(mg|mcg|µg|μg|ug|g)\b"


def dose_in_mg(c: Column) -> Column:
    """Milligrams of a dose text such as ``0,5 g`` or ``250 µg``; null if no known unit follows."""
    amount = F.translate(F.regexp_extract(c, _UNIT, 1), ",", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(c, _UNIT, 2))
    factor = F.lit(None).cast("double")
    for name, value in UNIT_MG.items():
        factor = F.when(unit == name, value).otherwise(factor)
    return amount * factor


def dose_outliers(lines: DataFrame, factor: float = 100.0, accuracy: int = 10_000) -> DataFrame:
    """Lines whose dose exceeds ``factor`` times the molecule's median. The median is a bounded sketch
    merged from partial results; a frequent molecule is no heavy group."""
    median = lines.groupBy("dci").agg(F.percentile_approx("dose_mg", 0.5, accuracy).alias("usual_mg"))
    return lines.join(median, "dci").filter(F.col("dose_mg") > F.col("usual_mg") * factor)


FEATURES = ["alert_type", "alert_severity", "hour", "weekday"]


def score_features(audit: DataFrame) -> DataFrame:
    return audit.withColumns(
        {
            "alert_type": F.coalesce("alert_type", F.lit("UNKNOWN")),
            "alert_severity": F.coalesce("alert_severity", F.lit("UNKNOWN")),
            "hour": F.hour("created_at").cast("string"),
            "weekday": F.dayofweek("created_at").cast("string"),
        }
    )


def fit_ignore_model(audit: DataFrame) -> PipelineModel:
    """Logistic regression of "ignored or overridden" on type, severity, hour and weekday.

    Audit rows with equal features are merged into one weighted row, so training works on the
    feature combinations, not on the log.
    """
    ignored = (F.col("decision") != "ACCEPTED").cast("double")
    grouped = (
        score_features(audit).withColumn("label", ignored)
        .groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    indexed = [f"{f}_ix" for f in FEATURES]
    encoded = [f"{f}_oh" for f in FEATURES]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=FEATURES, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
            VectorAssembler(inputCols=encoded, outputCol="features"),
            LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01),
        ]
    ).fit(grouped)


def score_alerts(model: PipelineModel, alerts: DataFrame) -> DataFrame:
    """``ai_ignore_proba`` with three decimals.

    The model's weights are looked up by feature value in built-in expressions: the stages' own functions carry objects that
    cannot always be sent to the tasks. A missing or unseen value has the weight of the unknown one.
    """
    indexer, encoder, _, regression = model.stages
    weights, start = [float(w) for w in regression.coefficients.toArray()], 0
    margin = F.lit(float(regression.intercept))
    for feature, labels, size in zip(FEATURES, indexer.labelsArray, encoder.categorySizes):
        own = weights[start:start + size]
        unknown = F.lit(own[len(labels)] if len(labels) < size else 0.0)
        known = F.create_map(*[F.lit(v) for pair in zip(labels, own) for v in pair])
        margin = margin + (F.coalesce(F.try_element_at(known, F.col(feature)), unknown) if labels else unknown)
        start += size
    kept = alerts.select(F.struct(*alerts.columns).alias("_alert"), *alerts.columns)  # features fill in nulls
    proba = F.round(1 / (1 + F.exp(-margin)), 3).cast("decimal(4,3)")
    return score_features(kept).select("_alert.*", proba.alias("ai_ignore_proba"))
