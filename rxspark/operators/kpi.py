"""Key figures and monitoring panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rxspark.operators.scale import previous_value

# fixed values: latency buckets in seconds, targets
LATENCY_BUCKETS = [0.1, 0.5, 1.0]
TARGETS = {"override_rate": 20.0, "compliance_rate": 80.0, "latency_ms": 300.0}


def _share(part: Column, total: Column, when_empty: float) -> Column:
    return F.coalesce(F.bround(100.0 * part / F.nullif(total, F.lit(0)), 1), F.lit(when_empty))


def system_kpis(users: DataFrame, prescriptions: DataFrame, audit: DataFrame, today: str) -> DataFrame:
    """One row of totals and rates. Each table is aggregated once; the one-row results meet in a union."""
    one = F.lit(1)
    active = lambda role: F.count_if((F.col("role") == role) & F.col("is_active"))
    parts = [
        users.agg(
            F.count(one).alias("total_users"), active("doctor").alias("active_doctors"),
            active("pharmacist").alias("active_pharmacists"),
        ),
        prescriptions.agg(
            F.count(one).alias("total_prescriptions"),
            F.count_if(F.col("created_at") >= F.lit(today).cast("date")).alias("prescriptions_today"),
        ),
        audit.agg(
            F.count(one).alias("total_audit_entries"),
            F.count_if(F.col("decision") == "OVERRIDE").alias("overrides"),
            F.count_if(F.col("decision") == "ACCEPTED").alias("accepted"),
        ),
    ]
    names = [c for p in parts for c in p.columns]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    row = merged.agg(*[F.max(n).alias(n) for n in names])
    total = F.col("total_audit_entries")
    return row.withColumns(
        {
            "override_rate": _share(F.col("overrides"), total, 0.0),
            "compliance_rate": _share(F.col("accepted"), total, 100.0),
        }
    ).drop("overrides", "accepted")


def top_alert_types(audit: DataFrame, k: int = 5) -> DataFrame:
    return (
        audit.filter(F.col("alert_type").isNotNull())
        .groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "alert_type").limit(k)
    )


def relative_share(top: DataFrame) -> DataFrame:
    """Share of each of the few top rows relative to the largest."""
    return top.withColumn("share_pct", 100.0 * F.col("n") / F.max("n").over(Window.partitionBy()))


def target_check(kpis: DataFrame, mean_latency: DataFrame) -> DataFrame:
    """The three targets, from the one-row KPI frame and a one-row ``latency_ms`` frame."""
    row = (
        kpis.select("override_rate", "compliance_rate")
        .unionByName(mean_latency.select("latency_ms"), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in TARGETS])
    )
    checks = []
    for name, target in TARGETS.items():
        value = F.col(name).cast("double")
        met = value > target if name == "compliance_rate" else value < target
        checks.append(
            F.struct(F.lit(name).alias("kpi"), value.alias("value"), F.lit(target).alias("target"), met.alias("ok"))
        )
    return row.select(F.inline(F.array(*checks)))


def _or_unknown(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("UNKNOWN")).alias(c)


def alert_counters(alerts: DataFrame) -> DataFrame:
    """Counts by (type, severity) with subtotals; a null label is a subtotal."""
    return (
        alerts.select(_or_unknown("alert_type"), _or_unknown("severity"))
        .cube("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))
    )


def enriched_counters(alerts: DataFrame) -> DataFrame:
    return (
        alerts.filter(F.coalesce("rag_explanation", F.lit("")) != "")
        .groupBy(_or_unknown("alert_type")).agg(F.count(F.lit(1)).alias("n"))
    )


def status_counters(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def decision_counters(audit: DataFrame) -> DataFrame:
    return (
        audit.select("decision", _or_unknown("alert_type"), _or_unknown("alert_severity"))
        .groupBy("decision", "alert_type", "alert_severity").agg(F.count(F.lit(1)).alias("n"))
    )


def override_rate(audit: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return audit.agg(
        (100.0 * F.count_if(F.col("decision") == "OVERRIDE") / F.nullif(total, F.lit(0))).alias("override_pct")
    )


def decision_breakdown(audit: DataFrame) -> DataFrame:
    return audit.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def per_minute(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Rows per minute and key."""
    return df.groupBy(F.date_trunc("minute", ts).alias("minute"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sliding_rate(df: DataFrame, ts: str, keys: list[str], minutes: int = 5) -> DataFrame:
    """Rows per minute over the sliding range that ends at ``window_end``.

    Rows are counted per minute first; only minute counts are copied to the windows they fall in.
    """
    shifts = F.sequence(F.lit(1), F.lit(minutes))
    copies = per_minute(df, ts, keys).withColumn("shift", F.explode(shifts))
    end = (F.col("minute") + F.make_dt_interval(mins=F.col("shift"))).alias("window_end")
    return copies.groupBy(end, *keys).agg((F.sum("n") / F.lit(float(minutes))).alias("per_minute"))


def _quantile(q: float, buckets: list[float]) -> Column:
    """Linear inside the first bucket that reaches the rank, in milliseconds; the open bucket answers its lower bound."""
    rank = F.col("total") * q
    value = F.lit(buckets[-1])
    for i in reversed(range(len(buckets))):
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        low = buckets[i - 1] if i else 0.0
        inside = F.nullif(F.col(f"le_{i}") - below, F.lit(0))
        share = F.coalesce((rank - below) / inside, F.lit(0.0))
        value = F.when(F.col(f"le_{i}") >= rank, F.lit(low) + share * (buckets[i] - low)).otherwise(value)
    return value * 1000.0


def histogram_quantiles(histograms: DataFrame, quantiles: list[float], buckets: list[float] = LATENCY_BUCKETS) -> DataFrame:
    """Histograms (``le_0, le_1, ...`` cumulative over the buckets, ``total``) with their quantiles; empty ones are left out."""
    columns = {f"p{round(q * 100)}_ms": _quantile(q, buckets) for q in quantiles}
    return histograms.filter(F.col("total") > 0).withColumns(columns).drop(*(f"le_{i}" for i in range(len(buckets))))


def latency_quantiles(
    requests: DataFrame, ts: str, latency_ms: str, quantiles: list[float], buckets: list[float] = LATENCY_BUCKETS,
    minutes: int = 5,
) -> DataFrame:
    """Quantiles per tumbling window from cumulative bucket counts of single requests.

    Only one count per (window, bucket) is kept, whatever the number of requests.
    """
    seconds = F.col(latency_ms) / 1000.0
    start = F.window(F.col(ts), f"{minutes} minutes").start.alias("window_start")
    counts = requests.groupBy(start).agg(
        *[F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(buckets)],
        F.count(latency_ms).alias("total"),
    )
    return histogram_quantiles(counts, quantiles, buckets)


def minute_histograms(
    samples: DataFrame, keys: list[str], series: list[str], ts: str = "ts", le: str = "le", value: str = "value",
    buckets: list[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """One mergeable histogram per minute and ``keys``, from samples of cumulative bucket counters.

    A counter is known by ``keys``, ``series`` (such as the instance) and ``le``, its upper bound as text (``+Inf`` counts all). Its
    growth between two samples falls into the minute of the later one; a drop is a restart from zero, and the first sample only a
    start. Samples of a counter look back inside an hour, hours pass on one row each, so no task holds a whole counter.
    """
    names = [*keys, *series, le]
    stepped = previous_value(samples.select(*names, ts, value), names, ts, value)
    step = F.when(F.col(value) < F.col("previous"), F.col(value)).otherwise(F.col(value) - F.col("previous"))
    bound = F.col(le).try_cast("double")
    grown = stepped.filter("previous IS NOT NULL").select(
        F.date_trunc("minute", ts).alias("minute"), *keys, bound.alias("bound"), (F.col(le) == "+Inf").alias("all"), step.alias("step")
    )
    of = lambda condition: F.sum(F.when(condition, F.col("step")).otherwise(0.0))
    return grown.groupBy("minute", *keys).agg(
        *(of(F.col("bound") == b).alias(f"le_{i}") for i, b in enumerate(buckets)), of(F.col("all")).alias("total")
    )


def sliding_histograms(histograms: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """Histograms of the last ``minutes`` minutes at every full minute (``window_end``) after which something was counted."""
    sums = [c for c in histograms.columns if c == "total" or c.startswith("le_")]
    shifts = F.sequence(F.lit(1), F.lit(minutes))
    copies = histograms.withColumn("shift", F.explode(shifts))
    end = (F.col("minute") + F.make_dt_interval(mins=F.col("shift"))).alias("window_end")
    return copies.groupBy(end, *keys).agg(*(F.sum(c).alias(c) for c in sums))


def sliding_latency_quantiles(
    samples: DataFrame, quantiles: list[float], handlers: str = "/api/.*", series: list[str] | None = None, minutes: int = 5,
    buckets: list[float] = LATENCY_BUCKETS,
) -> DataFrame:
    """Quantiles in milliseconds per ``handler`` over sliding ranges, one step a minute, from counters ``ts, handler, le, value``.

    ``handlers`` is a pattern for the whole name. All that is kept for a handler and minute is one number a bucket.
    """
    chosen = samples.filter(F.col("handler").rlike(f"^(?:{handlers})$"))
    histograms = minute_histograms(chosen, ["handler"], series or [], buckets=buckets)
    return histogram_quantiles(sliding_histograms(histograms, ["handler"], minutes), quantiles, buckets)


def status_class(requests: DataFrame) -> DataFrame:
    """Error requests with their class, 4xx or 5xx."""
    band = F.when(F.col("status").between(400, 499), "4xx").when(F.col("status").between(500, 599), "5xx")
    return requests.withColumn("status_class", band).filter(F.col("status_class").isNotNull())


def counter_rates(samples: DataFrame, name: str, series: str, ts: str, value: str) -> DataFrame:
    """Per-second increase of counters per minute, summed by name. A drop is a restart from zero."""
    stepped = previous_value(samples.select(name, series, ts, value), [name, series], ts, value)
    step = F.when(F.col(value) < F.col("previous"), F.col(value)).otherwise(F.col(value) - F.col("previous"))
    return (
        stepped.withColumn("step", step)
        .filter(F.col("step").isNotNull())
        .groupBy(F.date_trunc("minute", ts).alias("minute"), name)
        .agg((F.sum("step") / 60.0).alias("rate"))
    )
