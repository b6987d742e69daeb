"""Building blocks for large keys, checked against brute force with one dominant key."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from rxspark.operators import kpi, reads, scale


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), p, n, rng.randrange(3)) for p in range(60) for n in range(8)]
    df = spark.createDataFrame(rows, "g int, page int, line int, v int").distinct()
    rows = [tuple(r) for r in df.collect()]
    got = scale.running_totals(df, "g", "page", ["line", "v"], {"total": F.col("v"), "n": F.lit(1)}, span=7)
    totals, want = defaultdict(lambda: [0, 0]), {}
    for g, p, n, v in sorted(rows):
        totals[g][0] += v
        totals[g][1] += 1
        want[g, p, n, v] = tuple(totals[g])
    assert {(r.g, r.page, r.line, r.v): (r.total, r.n) for r in got.collect()} == want


def test_previous_value(spark):
    rng = random.Random(4)
    rows = sorted({("hot" if rng.random() < 0.5 else f"s{rng.randrange(3)}", rng.randrange(0, 200_000)) for _ in range(400)})
    df = spark.createDataFrame([(s, t, float(t % 97)) for s, t in rows], "s string, t long, v double").withColumn(
        "ts", F.timestamp_seconds("t"))
    got = {(r.s, r.t): r.previous for r in scale.previous_value(df, ["s"], "ts", "v").collect()}
    last, want = {}, {}
    for s, t in rows:
        want[s, t] = last.get(s)
        last[s] = float(t % 97)
    assert got == want


def test_counter_reset(spark):
    rows = [("a", "x", 0, 5.0), ("a", "x", 30, 8.0), ("a", "x", 70, 2.0), ("a", "y", 10, 1.0), ("a", "y", 40, 4.0)]
    df = spark.createDataFrame(rows, "name string, series string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.minute.minute: r.rate * 60 for r in kpi.counter_rates(df, "name", "series", "ts", "value").collect()}
    assert got == {0: 6.0, 1: 2.0}


def test_dense_ids(spark):
    rng = random.Random(5)
    names = [rng.choice(["hot", "a", "zz", None]) for _ in range(300)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int").repartition(7)
    got = scale.dense_ids(df, [F.col("n").asc_nulls_first(), F.col("i")]).collect()
    order = sorted(enumerate(names), key=lambda x: (x[1] is not None, x[1] or "", x[0]))
    assert {r.i: r.id for r in got} == {i: k + 1 for k, (i, _) in enumerate(order)}


def test_collect_in_parts_keeps_everything(spark):
    df = spark.createDataFrame([(1 if i % 3 else 2 + i % 5, i) for i in range(900)], "k int, v int")
    got = scale.collect_in_parts(df, ["k"], F.struct("v"), "v", "items", size=100).collect()
    assert sorted((r.k, x.v) for r in got for x in r["items"]) == sorted(map(tuple, df.collect()))
    parts = defaultdict(int)
    for r in got:
        parts[r.k] += 1
        assert len(r["items"]) < 250
    assert parts[1] > 3 and all(n == 1 for k, n in parts.items() if k != 1)


def test_documents_of_a_large_prescription(spark):
    prescriptions = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, patient_id long")
    lines = spark.createDataFrame([(i, 1 if i < 300 else 2, i, "x", 1.0) for i in range(303)],
                                  "id long, prescription_id long, drug_id long, dci string, dose_mg double")
    alerts = spark.createDataFrame([(1 if i < 250 else 2, 7 if i < 250 else 301, "T", "S", "t", str(i)) for i in range(252)],
                                   "prescription_id long, line_id long, alert_type string, severity string, title string, detail string")
    docs = reads.flatten_response(reads.prescription_documents(prescriptions, lines, alerts, size=50)).collect()
    found = defaultdict(lambda: [set(), 0])
    for d in docs:
        found[d.id][0] |= {l.id for l in d.lines or []}
        found[d.id][1] += d.alert_count
    assert (len(found[1][0]), found[1][1]) == (300, 250)
    assert (len(found[2][0]), found[2][1]) == (3, 2)
    assert (len(found[3][0]), found[3][1]) == (0, 0)


def test_documents_have_one_shape_at_every_size(spark):
    prescriptions = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, patient_id long")
    lines = spark.createDataFrame([(i, 1 if i < 300 else 2, i, "x", 1.0) for i in range(303)],
                                  "id long, prescription_id long, drug_id long, dci string, dose_mg double")
    alerts = spark.createDataFrame([(1 if i < 250 else 2, 7 if i < 250 else 301, "T", "S", "t", str(i)) for i in range(252)],
                                   "prescription_id long, line_id long, alert_type string, severity string, title string, detail string")
    small, large = (
        {r.id: r for r in reads.flatten_response(reads.prescription_documents(prescriptions, lines, alerts, size=n)).collect()}
        for n in (50, 10_000)
    )
    assert small == large and {i: (r.line_count, r.alert_count) for i, r in small.items()} == {1: (300, 250), 2: (3, 2), 3: (0, 0)}
    rows = reads.prescription_documents(prescriptions, lines, alerts, size=50).collect()
    assert len(rows) == 3
    for r in rows:
        assert [x.id for x in r.lines or []] == {1: [*range(300)], 2: [300, 301, 302], 3: []}[r.id]
    assert [len(x.alerts) for x in small[1].lines] == [250 if i == 7 else 0 for i in range(300)]


def test_contained_terms(spark):
    rng = random.Random(6)
    letters = "ab/—x "
    texts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 15))) for _ in range(80)}
    terms = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)} | {"b / a"}
    terms = {t for t in terms if t.strip("/—")}
    got = scale.contained_terms(
        spark.createDataFrame([(t,) for t in texts], "text string"), "text",
        spark.createDataFrame([(t,) for t in terms], "term string"), "term",
    )
    assert {tuple(r) for r in got.collect()} == {(x, t) for x in texts for t in terms if t in x}


def test_latency_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in [50.0, 50.0, 300.0, 700.0, 5000.0]], "ms double").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    r = kpi.latency_quantiles(df, "ts", "ms", [0.5, 0.99]).first()
    assert abs(r.p50_ms - 300.0) < 1e-6 and r.p99_ms == 1000.0


def test_sliding_quantiles_like_a_plain_evaluation(spark):
    """Counters with restarts, two instances and a handler outside the pattern, read every 20 seconds, against a scan by hand."""
    rng = random.Random(12)
    start, bounds = datetime.datetime(2024, 1, 1), ["0.1", "0.5", "1.0", "+Inf"]
    samples, growth = [], defaultdict(lambda: [0.0] * 4)
    for handler, instance in (("/api/a", "x"), ("/api/a", "y"), ("/api/b", "x"), ("/metrics", "x")):
        now, last = [0.0] * 4, None
        for i in range(270):
            now = [0.0] * 4 if rng.random() < 0.02 else now
            seen = [rng.choice([0.05, 0.3, 0.8, 3.0]) for _ in range(rng.randint(0, 3))]
            now = [n + sum(v <= float(b) for v in seen) for n, b in zip(now, bounds)]
            samples += [(start + datetime.timedelta(seconds=20 * i), handler, instance, b, v) for b, v in zip(bounds, now)]
            for k in range(4 if last else 0):
                growth[handler, i // 3][k] += now[k] if now[k] < last[k] else now[k] - last[k]
            last = now
    df = spark.createDataFrame(samples, "ts timestamp, handler string, instance string, le string, value double").repartition(3)
    got = {(r.handler, r.window_end): r for r in kpi.sliding_latency_quantiles(df, [0.5, 0.95], series=["instance"]).collect()}
    want = {}
    for handler in ("/api/a", "/api/b"):
        for end in range(1, 96):
            sums = [sum(growth[handler, m][k] for m in range(end - 5, end) if (handler, m) in growth) for k in range(4)]
            if sums[3]:
                values = []
                for q in (0.5, 0.95):
                    rank = q * sums[3]
                    k = next(k for k in range(4) if sums[k] >= rank)
                    low, high = ([0.0, 0.1, 0.5, 1.0][k], [0.1, 0.5, 1.0, 1.0][k])
                    below = sums[k - 1] if k else 0.0
                    values.append(1000 * (1.0 if k == 3 else low + (high - low) * (rank - below) / (sums[k] - below)))
                want[handler, start + datetime.timedelta(minutes=end)] = (sums[3], *values)
    assert got.keys() == want.keys()
    for key, (total, p50, p95) in want.items():
        assert got[key].total == total and abs(got[key].p50_ms - p50) < 1e-6 and abs(got[key].p95_ms - p95) < 1e-6


def test_hot_owner_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 else i, i) for i in range(100)], "id long, patient_id long, created_at long")
    plan = reads.latest_per_owner(df, "patient_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
