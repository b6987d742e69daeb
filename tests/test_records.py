"""Explanations, override verdicts, audit and intake on hand-made rows."""

import datetime as dt
import re

from pyspark.sql import functions as F

from rxspark.operators import audit, explain, intake, reads, screening
from rxspark.session import stored
from rxspark.sources import catalogue_files
from rxspark.streaming import jobs

ALERT = "alert_id long, prescription_id long, alert_type string, severity string, title string, detail string, patient_age int"


def prompts(spark, rows):
    df = spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], ALERT)
    return [r.prompt for r in explain.build_prompts(explain.text_context(df)).orderBy("alert_id").collect()]


def test_prompts(spark):
    got = prompts(spark, [
        ("INTERACTION", "MAJOR", "Interaction médicamenteuse — A / B", "texte", 30),
        ("ALLERGY", "MAJOR", "Allergie croisée — AMOX", "Le patient est allergique aux Pénicillines. X (DCI : Amoxicilline).", 30),
        ("ALLERGY", "MAJOR", "Allergie connue — amox", "Le patient a une allergie documentée à : amox, soja. Médicament prescrit : A.", 30),
        ("RENAL", "MAJOR", "Insuffisance rénale — GLUCOPHAGE", "clairance rénale est < 45 mL/min. Clairance du patient : 42.5 mL/min (IRC).", 30),
        ("REDUNDANT_DCI", "MODERATE", "Redondance de DCI — Metformine", "lignes de la prescription : ACOL, GLUCOPHAGE. Risque", 30),
        ("POSOLOGY", "MAJOR", "Âge insuffisant — {dci} SIROP", "autorisé à partir de 8 ans. Âge", 0),
        ("UNKNOWN", "MAJOR", "x", "y", 30),
        ("INTERACTION", "MAJOR", "sans tiret", None, 30),
    ])
    assert "l'association de A et B est classée \"interaction\"" in got[0] and "officielle : texte\n" in got[0]
    assert "Mécanisme : Non précisé" in got[0]
    assert "allergie aux Pénicillines.\n" in got[1] and "dont la DCI est Amoxicilline" in got[1]
    assert "allergique à amox, soja qui" in got[2]
    assert "42.5 mL/min" in got[3] and ": 45 mL/min" in got[3]
    assert "acidose lactique" in got[4] and "ACOL, GLUCOPHAGE. Risque" in got[4]
    assert "prescrire {dci} SIROP à un patient de inconnu ans" in got[5] and "à partir de 8 ans." in got[5]
    assert got[6] is None
    assert "molécule A et molécule B" in got[7]


def test_interaction_context_by_brute_force(spark):
    names = ["RAMI", "SPIRO", "OR", "LITHIUM", "MÉTO"]
    pairs = [(i, a, b) for i, (a, b) in enumerate([(0, 1), (1, 0), (2, 3), (3, 4), (0, 4), (1, 3)])]
    rows = [(i, names[a], names[b], "n", f"m{i}", None) for i, a, b in pairs]
    th = spark.createDataFrame(rows, "id long, dci_a string, dci_b string, level_fr string, mechanism string, recommendation string")
    keys = {1: ["RAMI", "SPIRO"], 2: ["LITHIUM"], 3: ["METO", "OR"], 4: ["SPIRO", "X"], 5: ["LITHIUM", "RAMI"]}
    ctx = spark.createDataFrame([(p, k) for p, k in keys.items()], "prescription_id long, line_keys array<string>")
    titles = ["Interaction — RAMI 5 / LITHIUMX", "Interaction — X / Y", "Interaction — MÉTO / ORAP", "Interaction — spiro / meto"]
    alerts = [(p * 10 + n, p, t) for p in keys for n, t in enumerate(titles)]
    got = explain.interaction_context(spark.createDataFrame(alerts, "alert_id long, prescription_id long, title string"), ctx, th)
    plain = lambda n: n.replace("É", "E")
    want = {}
    for i, p, title in alerts:
        if len(keys[p]) < 2:
            continue
        for r in rows:
            if (r[1] in keys[p] or r[2] in keys[p]) and (plain(r[1]) in title.upper() or plain(r[2]) in title.upper()):
                want[i] = r[4]
                break
    assert {r.alert_id: r.mechanism for r in got.collect()} == want and len(want) > 4


def test_explanations(spark):
    alerts = spark.createDataFrame([(1, "MAJOR"), (2, "MINOR"), (3, "MODERATE"), (4, "MAJOR"), (5, "MAJOR")], "alert_id long, severity string")
    good = "Risque d'hyperkaliémie par double blocage."
    answers = spark.createDataFrame([(1, f"  {good} "), (2, good), (3, "Ok."), (4, "x" * 801)], "alert_id long, answer string")
    got = {r.alert_id: r.rag_explanation for r in explain.attach_explanations(alerts, answers).collect()}
    assert got == {1: good, 2: None, 3: None, 4: None, 5: None}


def test_verdicts(spark):
    texts = {
        1: ("OVERRIDE", "ok", None), 2: ("OVERRIDE", "  ", None), 3: ("ACCEPTED", "long enough text", '{"valid": true}'),
        4: ("OVERRIDE", "long enough text", 'Voici {"valid": true, "feedback": "bien"} fin'),
        5: ("OVERRIDE", "long enough text", '{"valid": false,\n "feedback": "vague"}'), 6: ("OVERRIDE", "long enough text", "bla bla"),
        7: ("OVERRIDE", "long enough text", '{"feedback": 3}'), 8: ("OVERRIDE", "long enough text", None),
    }
    decisions = spark.createDataFrame([(i, d, j) for i, (d, j, _) in texts.items()], "alert_id long, decision string, justification string")
    answers = spark.createDataFrame([(i, v) for i, (_, _, v) in texts.items()], "alert_id long, verdict string")
    got = {r.alert_id: (r.justification_valid, r.justification_feedback) for r in explain.judge_decisions(decisions, answers).collect()}
    assert got[1][0] == "noise" and "courte" in got[1][1]
    assert [got[i] for i in (2, 3, 4, 5, 6, 7, 8)] == [
        (None, None), (None, None), ("valid", "bien"), ("noise", "vague"), (None, None), ("noise", "3"), (None, None)]


def test_bulk_audit_skips_unknown_alerts(spark):
    alerts = spark.createDataFrame([(1, "RENAL", "MAJOR", "t1"), (2, "ALLERGY", "MAJOR", "t2")], "id long, alert_type string, severity string, title string")
    payload = spark.createDataFrame([(9, 5, [(1, "ACCEPTED", None), (2, "OVERRIDE", "j"), (77, "IGNORED", None)])],
                                    "prescription_id long, doctor_id long, decisions array<struct<alert_id:long,decision:string,justification:string>>")
    rows = sorted(audit.bulk_decisions(payload, alerts).collect(), key=lambda r: r.alert_id)
    assert [(r.alert_id, r.alert_type, r.alert_severity, r.alert_title, r.doctor_id) for r in rows] == [
        (1, "RENAL", "MAJOR", "t1", 5), (2, "ALLERGY", "MAJOR", "t2", 5)]


def test_partial_update_with_explicit_null(spark):
    patients = spark.createDataFrame([(1, 50.0, True), (2, 60.0, False)], "id long, w double, p boolean")
    updates = spark.createDataFrame(
        [(1, 1, 51.0, None, ["w"]), (1, 2, None, False, ["w", "p"]), (1, 3, 99.0, True, [])],
        "id long, o int, w double, p boolean, set_fields array<string>")
    got = sorted(tuple(r) for r in intake.update_patients(patients, updates, ["w", "p"], "o").collect())
    assert got == [(1, None, False), (2, 60.0, False)]


def test_status(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(1,), (1,)], "prescription_id long")
    assert sorted((r.id, r.status, r.alert_count) for r in screening.prescription_status(p, a).collect()) == [(1, "alerts", 2), (2, "safe", 0)]


def test_late_rows_are_dropped_and_reruns_add_nothing(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "id long, ts timestamp, kind string"

    def add(name, rows):
        spark.createDataFrame([(i, start + dt.timedelta(minutes=m), "a") for i, m in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        rates = jobs.windowed_rates(stream, "ts", ["kind"], minutes=5, slide=5)
        jobs.append_to_parquet(rates, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        sink = jobs.audit_sink(stream, "ts", "id", str(tmp_path / "audit"), str(tmp_path / "cp2"))
        sink.awaitTermination()

    add("one", [(1, 1), (2, 2), (2, 2), (3, 40)])
    run()
    add("two", [(4, 3), (5, 41), (6, 90)])  # minute 3 is late by then
    run()
    run()
    rates = {(r.window_end - start).seconds // 60: r.per_minute for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rates == {5: 3 / 5, 45: 2 / 5}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == [1, 2, 3, 4, 5, 6]


def test_line_ids_of_large_orders(spark):
    big = 2**62
    lines = [(1, "a", 1.0, "mg"), (2, "b", 1.0, "mg")]
    events = spark.createDataFrame(
        [(big + i, lines) for i in range(3)],
        "id long, lines array<struct<drug_id:long,dci:string,dose_mg:double,dose_unit_raw:string>>",
    )
    ids = [r.id for r in intake.event_lines(events).orderBy("prescription_id", "drug_id").collect()]
    assert len(set(ids)) == 6 and ids == sorted(ids)


def test_verdicts_do_not_multiply_decisions(spark):
    decisions = spark.createDataFrame(
        [(1, "OVERRIDE", "une raison assez longue"), (1, "OVERRIDE", "une autre raison longue")], "alert_id long, decision string, justification string"
    )
    verdicts = spark.createDataFrame(
        [(1, '{"valid": true, "feedback": "b"}', 2), (1, '{"valid": false, "feedback": "a"}', 1)], "alert_id long, verdict string, arrived_at int"
    )
    got = explain.judge_decisions(decisions, verdicts).collect()
    assert len(got) == 2 and {(r.justification_valid, r.justification_feedback) for r in got} == {("valid", "b")}
    alerts = spark.createDataFrame([(1, "MAJOR")], "alert_id long, severity string")
    answers = spark.createDataFrame([(1, "x" * 30), (1, "y" * 40)], "alert_id long, answer string")
    assert [r.rag_explanation for r in explain.attach_explanations(alerts, answers).collect()] == ["y" * 40]


def test_refused_sizes(spark):
    import pytest

    from rxspark.operators import reads

    audit_rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id long, created_at timestamp")
    for k in (0, 201):
        with pytest.raises(ValueError):
            audit.recent(audit_rows, k)
    with pytest.raises(ValueError):
        reads.search_drugs(audit_rows, audit_rows, ["a"], 21)


def test_latest_of_a_busy_owner(spark):
    from rxspark.operators import reads

    rows = spark.range(6000).selectExpr("id", "1 AS patient_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id DIV 3) AS created_at")
    got = reads.latest_per_owner(rows, "patient_id", 2000, 5).orderBy("position").collect()
    assert [r.id for r in got] == [3999, 3998, 3997, 3996, 3995] and [r.position for r in got] == [2001, 2002, 2003, 2004, 2005]


def test_work_folder_on_a_cluster(spark, tmp_path):
    import pytest

    from rxspark.session import checkpoint_root

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "setCheckpointDir": lambda self, path: None})()

    with pytest.raises(ValueError):
        checkpoint_root(Session())
    Session.conf["spark.checkpoint.dir"] = str(tmp_path)
    assert checkpoint_root(Session()) == str(tmp_path)
    Session.conf.clear()
    Session.sparkContext.master = "local[4]"
    assert checkpoint_root(Session())


def test_drugs_keep_their_ids(spark, monkeypatch):
    """Equal keys and equal rows stay apart; a new price, new rows and rows that leave and return change no other id."""
    from rxspark.operators import catalogue

    base = {c: None for c in catalogue.DRUG_COLUMNS if c != "id"}
    schema = ", ".join(f"{c} {'double' if c == 'price_ppv' else 'string'}" for c in base)
    make = lambda brand, price, **more: {**base, "brand_name": brand, "dosage_raw": "1 mg", "price_ppv": price, **more}

    def load(rows, known=None):
        drugs, ids = catalogue.keep_ids(spark.createDataFrame(rows, schema).repartition(3), known)
        got = sorted((r.brand_name, r.price_ppv or 0, r.id) for r in drugs.collect())
        assert len(got) == len(rows) == len({i for *_, i in got})
        return got, ids

    one, ids = load([make("A", 1.0), make("A", 1.0), make("A", 2.0), make("B", 5.0), make("C", None)])
    assert load([make("A", 1.0), make("A", 1.0), make("A", 2.0), make("B", 5.0), make("C", None)], ids)[0] == one
    id_of = {(b, p): {i for x, y, i in one if (x, y) == (b, p)} for b, p, _ in one}
    two, ids = load([make("A", 2.0), make("A", 1.0), make("A", 9.0), make("A", 9.5), make("B", 6.0), make("D", 1.0), make("B", 5.0, presentation="x")], ids)
    ids2 = {(b, p): {i for x, y, i in two if (x, y) == (b, p)} for b, p, _ in two}
    assert ids2["A", 2.0] == id_of["A", 2.0] and ids2["A", 1.0] < id_of["A", 1.0]  # the same content
    assert ids2["A", 1.0] | ids2["A", 9.0] | ids2["A", 9.5] > id_of["A", 1.0]  # another price takes the id that is left
    assert ids2["B", 6.0] == id_of["B", 5.0] and not ids2["B", 5.0] & id_of["B", 5.0]  # another presentation is another drug
    three, _ = load([make("C", 3.0), make("D", 1.0)], ids)
    assert {i for b, _, i in three if b == "C"} == id_of["C", 0] and {i for b, _, i in three if b == "D"} == ids2["D", 1.0]
    # a taken id is passed over
    rows = spark.createDataFrame([("n", 1), ("n", 2)], "natural string, occurrence int")
    wanted = [r.id for r in catalogue._new_ids(rows, spark.createDataFrame([], "id long")).collect()]
    others = {r.id for r in catalogue._new_ids(rows, spark.createDataFrame([(wanted[0],)], "id long")).collect()}
    assert wanted[0] not in others and len(others) == 2


def test_byte_order_mark(spark, tmp_path):
    columns = ["id", "created_at", "decision", "alert_type", "alert_severity", "alert_title", "justification", "justification_valid"]
    audit = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), "IGNORED", None, None, "é", None, None)], ", ".join(
        f"{c} {'long' if c == 'id' else 'timestamp' if c == 'created_at' else 'string'}" for c in columns)).coalesce(1)
    for mark in (False, True):
        catalogue_files.write_audit_csv(audit, str(tmp_path / str(mark)), mark=mark)
        text = next((tmp_path / str(mark)).glob("part-*")).read_bytes()
        assert text.startswith(b"\xef\xbb\xbfID,Date" if mark else b"ID,Date")


def test_audit_log_is_complete(spark, tmp_path):
    """Repeats and rows that come days late: each decision is stored once."""
    start = dt.datetime(2024, 5, 1)
    schema = "id long, ts timestamp, kind string"

    def add(name, rows):
        data = [(i, start + dt.timedelta(days=d), "a") for i, d in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.audit_sink(stream, "ts", "id", str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()

    for name, rows in (("one", [(1, 9), (2, 11), (2, 9)]), ("two", []), ("three", [(1, 15), (3, 0)]), ("four", [(3, 2), (4, 20), (2, 0)])):
        add(name, rows)
        run()
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.id, (r.ts - start).days, str(r.day)) for r in log) == [
        (1, 9, "2024-05-10"), (2, 9, "2024-05-10"), (3, 0, "2024-05-01"), (4, 20, "2024-05-21"),
    ]
    # the look-up reads the folders of its hashes, of earlier batches only
    from pyspark.sql import types as T

    seen = jobs.stored_keys(spark, str(tmp_path / "log-keys"), "id", T.LongType(), [3, 5], 2)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "batch_id" in filters and "bucket" in filters
    assert {r.bucket for r in seen.collect()} <= {3, 5}


def test_reference_rows_of_a_batch(spark, monkeypatch):
    table = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, v string")
    ids = spark.createDataFrame([(3,), (3,), (None,), (7,), (99,)], "patient_id long")
    for most in (1000, 1):
        monkeypatch.setattr(jobs, "LOOKUP", most)
        assert sorted(r.id for r in jobs.only(table, "id", ids).collect()) == [3, 7]
        assert jobs.only(table, "id", ids.filter("patient_id = 99")).count() == 0


def test_rejected_orders(spark, tmp_path):
    """Orders with unknown references leave with their reasons and raise no alerts; the others are screened."""
    drugs = spark.createDataFrame(
        [(1, "A", "x", None, True, "", ""), (2, "B", "y", None, False, "", "")],
        "id long, brand_name string, dci string, min_age string, is_psychoactive boolean, contraindications string, indications string",
    )
    components = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (8, "z", 1)], "drug_id long, dci string, position int")
    patients = spark.createDataFrame(
        [(1, None, None, False, None, False, [])],
        "id long, birthdate date, creatinine_clearance double, is_pregnant boolean, gestational_weeks int, is_breastfeeding boolean, known_allergies array<string>",
    )
    thesaurus = spark.createDataFrame([], "id long, dci_a string, dci_b string, level_fr string, severity string, mechanism string, recommendation string")
    line = "struct<drug_id:bigint,dci:string,dose_mg:double,dose_unit_raw:string>"
    at = dt.datetime(2024, 1, 1)
    order = lambda i, patient, *drug: (i, patient, 5, at, None, [(d, "m", 1.0, "mg") for d in drug])
    schema = f"id long, patient_id long, doctor_id long, created_at timestamp, hook_event string, lines array<{line}>"
    for name, rows in (("one", [order(1, 1, 1), order(2, 9, 1), order(3, 1, 8, 7, 7)]), ("two", [order(4, 9, 7), order(5, 1, 2), order(6, None, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.screen_events(
            stream, patients, screening.drug_profiles(drugs, components), thesaurus, "2024-01-01", str(tmp_path / "alerts"), str(tmp_path / "rejected"),
            str(tmp_path / "cp"), trigger={"availableNow": True},
        ).awaitTermination()
    refused = {r.id: (r.reasons, r.missing_drugs) for r in spark.read.parquet(str(tmp_path / "rejected")).collect()}
    assert refused == {
        2: (["patient_unknown"], []), 3: (["drugs_unknown"], [7, 8]), 4: (["patient_unknown", "drugs_unknown"], [7]), 6: (["patient_unknown"], []),
    }
    assert [(r.prescription_id, r.rule) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == [(1, "psychoactive")]


def test_verdicts_by_json_type(spark):
    """As the service reads them: the truth of a value by its kind, its printed form, the last of repeated keys."""
    import json
    import re

    answers = [
        '{"valid": true, "feedback": "ok"}', '{"valid": "false", "feedback": null}', '{"valid": "", "feedback": true}', '{"valid": 0, "feedback": 12}',
        '{"valid": 0.0}', '{"valid": 2.5, "feedback": 1.5}', '{"valid": [], "feedback": ["a", 1, true, null]}', '{"valid": [0], "feedback": {"k": "v, w: x"}}',
        '{"valid": null}', '{"valid": false, "valid": true, "feedback": "x", "feedback": "y"}', '{}', "{bad", 'text', "", None,
        'Voici {"valid": {}, "feedback": "' + "é" * 300 + '"} fin', '{"valid": true} puis {"valid": false}', '{"valid": {"a": 1}, "feedback": "a}b{c"}',
    ]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, verdict string")
    got = {r.i: (r.valid, r.feedback) for r in explain.parse_verdicts(rows).collect()}
    for i, answer in enumerate(answers):
        try:
            parsed = json.loads(re.search(r"\{.*\}", answer or "", re.DOTALL).group())
            want = (bool(parsed.get("valid", False)), str(parsed.get("feedback", ""))[:200])
        except (AttributeError, ValueError):
            want = (None, None)
        assert got[i] == want, answer


def test_search_like_a_scan(spark):
    """Many queries against names that share most grams, by a plain evaluation of the pattern."""
    import random
    import re

    from rxspark.operators import reads

    rng = random.Random(9)
    name = lambda: "".join(rng.choice("aAbé%_\\ ") for _ in range(rng.randint(0, 7)))
    drugs = [(i, rng.choice([name(), name() + "mg", None]), rng.choice([name(), None])) for i in range(120)]
    columns = "presentation dosage_raw labo_name atc_code product_type indications min_age".split()
    df = spark.createDataFrame(drugs, "id long, brand_name string, dci string").withColumns(
        {**{c: F.lit(None).cast("string") for c in columns}, "price_ppv": F.lit(0.0), "price_hospital": F.lit(2.5), "is_psychoactive": F.lit(None).cast("boolean")}
    )
    parts = spark.createDataFrame([(3, "main", 1), (4, "", 1)], "drug_id long, dci string, position int")
    asked = [name() for _ in range(80)] + ["%%", "__", "a", " a", "mg", "MG", None, "zzz"]
    got = reads.search_drugs(df, parts, spark.createDataFrame([(q,) for q in asked], "q string"), limit=5).collect()
    found = {}
    for r in got:
        found.setdefault(r.q, []).append((r.position, r.id))
        assert r.price_ppv is None and r.price_hospital == 2.5 and r.is_psychoactive is False

    pattern = lambda q: "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in q)
    for q in {q.strip() for q in asked if q and len(q) >= 2}:
        p = pattern(q.lower())
        hits = [(i, b) for i, b, d in drugs if any(x is not None and re.fullmatch(f"(?s).*{p}.*", x.lower()) for x in (b, d))]
        hits.sort(key=lambda h: (h[1] is None or not re.fullmatch(f"(?s){p}.*", h[1].lower()), h[1] is not None, h[1] or "", h[0]))
        assert sorted(found.get(q, [])) == [(k + 1, i) for k, (i, _) in enumerate(hits[:5])], q


def test_ignore_model_like_a_plain_fit(spark):
    """Probabilities of the fitted model against a Newton iteration on the same penalised likelihood."""
    import numpy as np

    from rxspark.operators import scoring

    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 3, 4)
    rows = []
    for i in range(400):
        kind, severity, hour = ["ALLERGY", "RENAL", None][rng.integers(3)], ["MAJOR", "MINOR"][rng.integers(2)], int(rng.integers(0, 4))
        p = 1 / (1 + np.exp(-(1.5 * (kind == "RENAL") - 1.0 * (severity == "MAJOR") + 0.3 * hour - 0.4)))
        rows.append((i, kind, severity, start + dt.timedelta(days=int(rng.integers(3)), hours=hour), "IGNORED" if rng.random() < p else "ACCEPTED"))
    log = spark.createDataFrame(rows, "id long, alert_type string, alert_severity string, created_at timestamp, decision string")
    got = {r.id: float(r.ai_ignore_proba) for r in scoring.score_alerts(scoring.fit_ignore_model(log), log.drop("decision")).collect()}
    features = [[k or "UNKNOWN", s, str(t.hour), str(t.isoweekday() % 7 + 1)] for _, k, s, t, _ in rows]
    names = [sorted({f[j] for f in features}) for j in range(4)]
    x = np.array([[f[j] == n for j in range(4) for n in names[j]] for f in features], float)
    y = np.array([d != "ACCEPTED" for *_, d in rows], float)
    scale = x.std(axis=0, ddof=1)
    z = np.c_[np.ones(len(y)), x / scale]
    penalty = np.diag([0.0] + [0.01] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty + 1e-12 * np.eye(len(beta)), z.T @ (p - y) / len(y) + penalty @ beta)
    want = 1 / (1 + np.exp(-z @ beta))
    assert max(abs(got[i] - want[i]) for i in range(400)) < 0.005


def test_alert_contexts_move_no_alert(spark):
    """Alerts are numbered, get ages and names where their prescription lies: no exchange after the tables in buckets."""
    from rxspark.operators import screening
    from rxspark.plans import queries_records as q

    lines = [(f"l{p}-{n}", p, n, f"m{n}", b, f"m{n}", [f"M{n}"], f"{b} (5 mg)", 30 + p, n) for p in range(1, 5) for n, b in ((1, "AA"), (2, "BB"), (1, "CC"))]
    lines = [(f"{r[0]}{i}", *r[1:]) for i, r in enumerate(lines)]
    schema = ("line_id string, prescription_id long, drug_id long, dci string, brand_name string, main_key string, line_keys array<string>, "
              "label string, age int, _n int")
    found = F.array(F.struct(
        F.lit("psychoactive").alias("rule"), F.lit("POSOLOGY").alias("alert_type"), F.lit("MINOR").alias("severity"), F.array().cast("array<string>").alias("values"),
    ))
    rows = spark.createDataFrame(lines, schema).withColumns({"name": F.col("brand_name"), "found": found})
    known = spark.createDataFrame(
        [(1, "M1", "M2", "n", "MAJOR", "m", None)], "id long, dci_a string, dci_b string, level_fr string, severity string, mechanism string, recommendation string",
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # nothing small enough to hide an exchange
    try:
        alerts = q.aged_alerts(screening.co_located(rows), known)
        plan = alerts._jdf.queryExecution().executedPlan().toString()
        got = alerts.collect()
        drugs = spark.createDataFrame([(1, "AA", "m1")], "id long, brand_name string, dci string")
        whole = explain.alert_context(alerts, rows, known, drugs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan
    assert "_own#" in plan and not re.search(r"Sort \[prescription_id#\w+ ASC NULLS FIRST, (_own|_renal)#", plan + whole)  # sorted by line, once
    assert len(got) == len({r.alert_id for r in got}) == 12 + 4 + 8 and all(r.patient_age == 30 + r.prescription_id for r in got)


def test_scores_are_built_in_expressions(spark):
    """The score of an alert needs no function object that has to be sent to the tasks; unseen and missing values count as unknown."""
    from rxspark.operators import scoring

    start = dt.datetime(2024, 3, 4)
    rows = [(i, ["ALLERGY", "RENAL", None][i % 3], "MAJOR", start + dt.timedelta(hours=i), ["IGNORED", "ACCEPTED"][i % 5 < 2]) for i in range(60)]
    schema = "id long, alert_type string, alert_severity string, created_at timestamp, decision string"
    log = spark.createDataFrame(rows, schema)
    model = scoring.fit_ignore_model(log)
    asked = spark.createDataFrame([*rows, (98, "NEW", "OTHER", start, None), (99, None, None, None, None)], schema).drop("decision")
    got = scoring.score_alerts(model, asked)
    assert "UDF" not in got._jdf.queryExecution().executedPlan().toString()
    want = model.transform(scoring.score_features(asked)).select("id", "probability").collect()
    found = {r.id: float(r.ai_ignore_proba) for r in got.collect()}
    assert all(abs(found[r.id] - r.probability[1]) <= 0.000501 for r in want) and len(found) == 62


def test_name_grams_are_made_by_all_tasks(spark):
    """Drugs of one partition: no task holds most of the postings, and each is there once."""
    drugs = spark.range(0, 2000, 1, 1).selectExpr("id", "concat('Brand ', id) AS brand_name", "if(id % 2 = 0, 'Molecule', NULL) AS dci")
    assert drugs.rdd.getNumPartitions() == 1
    postings = reads.name_grams(drugs)
    sizes = [r["count"] for r in postings.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert postings.count() == postings.distinct().count() and postings.filter("gram = ''").count() == 2000


def test_a_batch_fetches_its_references_once(spark, tmp_path, monkeypatch):
    """What a batch fetches is computed once, though the check of references and the screening both read it."""
    written = []
    monkeypatch.setattr(jobs, "stored", lambda df, name: written.append(name) or df.localCheckpoint(), raising=False)
    schema = "id long, patient_id long, doctor_id long, created_at timestamp, hook_event string, lines array<struct<drug_id:bigint,dci:string,dose_mg:double,dose_unit_raw:string>>"
    spark.createDataFrame([(1, 1, 5, dt.datetime(2024, 1, 1), None, [(1, "m", 1.0, "mg")])], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drugs = spark.createDataFrame(
        [(1, "A", "x", None, True, "", "")],
        "id long, brand_name string, dci string, min_age string, is_psychoactive boolean, contraindications string, indications string",
    )
    patients = spark.createDataFrame(
        [(1, None, None, False, None, False, [])],
        "id long, birthdate date, creatinine_clearance double, is_pregnant boolean, gestational_weeks int, is_breastfeeding boolean, known_allergies array<string>",
    )
    thesaurus = spark.createDataFrame([], "id long, dci_a string, dci_b string, level_fr string, severity string, mechanism string, recommendation string")
    profiles = screening.drug_profiles(drugs, spark.createDataFrame([(1, "x", 1)], "drug_id long, dci string, position int"))
    jobs.screen_events(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), patients, profiles, thesaurus, "2024-01-01",
        str(tmp_path / "alerts"), str(tmp_path / "rejected"), str(tmp_path / "cp"),
    ).awaitTermination()
    assert written == ["batch-patients", "batch-profiles"]
    assert [r.rule for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == ["psychoactive"]


def test_interaction_contexts_write_only_what_interactions_read(spark, tmp_path, monkeypatch):
    """Lines go to their buckets with four columns, and the contexts are those of all columns."""
    from rxspark.plans import queries_records, queries_screening
    from rxspark.plans.registry import Inputs

    names = ["alpha beta", "beta alpha", "gamma alpha", "delta gamma"]
    spark.createDataFrame(
        [(i, names[i % 4], f"Brand#{i % 3}", "PROMO", i % 9 + 1, 10.0) for i in range(1, 13)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        [(o, 1 + (o * 3 + n * 5) % 12, 1, n, 2.0, "2020-01-01") for o in range(6) for n in range(4)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate string",
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    plain = screening.co_located
    monkeypatch.setattr(screening, "co_located", lambda df, *a, **k: written.append(df.columns) or plain(df, *a, **k))
    x = Inputs(spark, str(tmp_path))
    got = sorted(map(tuple, queries_records._interaction_contexts(x).collect()))
    assert got and written[0] == screening.INTERACTION_FACTS
    facts = queries_screening.line_facts
    monkeypatch.setattr(queries_records, "line_facts", lambda x, *_: facts(x))
    assert sorted(map(tuple, queries_records._interaction_contexts(x).collect())) == got and len(written[2]) > 4


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What a stored table or one in buckets was made from leaves the disks with the write, and the session's settings stay as they were."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(key), _shuffle_files(spark)
    rows = spark.range(0, 2000, 1, 4).selectExpr("id", "id % 50 AS prescription_id")
    tables = [stored(rows.repartition(3, "id"), "released"), screening.co_located(rows)]
    assert not {f for f in _shuffle_files(spark) if f not in files and f.endswith(".data")}
    assert [table.count() for table in tables] == [2000, 2000]
    assert spark.conf.get(key) == before


def test_interactions_are_numbered_in_a_part_of_their_own(spark):
    """Interactions and other alerts never stand in one task's rows; equal alerts of a part have different numbers, and only renal
    alerts meet the drugs, only interactions the thesaurus."""
    from rxspark.plans import queries_records as q

    lines = [(f"l{n}", 1, n, "m1" if n < 3 else "m2", "M1 AA" if n < 3 else "M2 BB", "m1" if n < 3 else "m2", ["M1"] if n < 3 else ["M2"], "x", 40) for n in range(1, 4)]
    schema = "line_id string, prescription_id long, drug_id long, dci string, brand_name string, main_key string, line_keys array<string>, label string, age int"
    found = F.array(F.struct(
        F.lit("renal").alias("rule"), F.lit("RENAL").alias("alert_type"), F.lit("MAJOR").alias("severity"), F.array(*map(F.lit, ("m", "60", "20", "s"))).alias("values"),
    ))
    facts = screening.co_located(spark.createDataFrame(lines, schema).withColumns({"name": F.col("brand_name"), "found": found}))
    known = spark.createDataFrame(
        [(1, "M1", "M2", "n", "MAJOR", "risk", "do")], "id long, dci_a string, dci_b string, level_fr string, severity string, mechanism string, recommendation string",
    )
    drugs = spark.createDataFrame([(1, "M1 AA", "first"), (3, "M2 BB", "third")], "id long, brand_name string, dci string")
    parts = q.aged_parts(facts, known)
    seen = {}
    for types, part in parts.items():
        whole = explain.alert_context(part, facts, known, drugs, types)
        plan = whole._jdf.queryExecution().optimizedPlan().toString()
        assert ("_names" in plan) == ("INTERACTION" in types) and ("_renal" in plan) == ("RENAL" in types)
        got = whole.collect()
        assert {r.alert_type for r in got} <= set(types)
        seen.update({r.alert_id: (r.alert_type, r.dci, r.mechanism) for r in got})
    # both lines of AA meet the one of BB: two equal alerts
    assert sorted(seen.values(), key=str) == sorted(
        [("INTERACTION", None, "risk")] * 2 + [("REDUNDANT_DCI", "M1", None)] + [("RENAL", "first", None)] * 2 + [("RENAL", "third", None)], key=str,
    )
    assert sorted(i[-2:] for i, v in seen.items() if v[0] == "INTERACTION") == ["#1", "#2"]
    assert {r.alert_id for r in q.aged_alerts(facts, known).collect()} == set(seen)


def test_reference_tables_in_buckets_are_not_moved(spark, monkeypatch):
    """A batch with many ids reads a table in buckets of the id where it lies: only the ids are moved, and no row is sorted."""
    monkeypatch.setattr(jobs, "LOOKUP", 1)
    table = screening.co_located(spark.createDataFrame([(i % 40, f"v{i}") for i in range(50)], "id long, v string"), "id")
    ids = spark.createDataFrame([(3,), (3,), (None,), (7,), (99,)], "patient_id long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jobs.only(table, "id", ids)
        plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.v for r in found.collect()) == ["v3", "v43", "v47", "v7"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    final = plan[plan.index("AdaptiveSparkPlan") :]
    assert final.count("Exchange hashpartitioning") == 1 and "Sort [" not in final


def test_refused_orders_leave_before_the_screening(spark, tmp_path, monkeypatch):
    """The screening gets the headers of accepted orders and all lines of the batch, so that no line is moved to drop a few."""
    given = []
    plain = jobs.screen
    monkeypatch.setattr(jobs, "screen", lambda headers, lines, *a, **k: given.append((sorted(r.id for r in headers.collect()), lines.count())) or plain(headers, lines, *a, **k))
    schema = "id long, patient_id long, doctor_id long, created_at timestamp, hook_event string, lines array<struct<drug_id:bigint,dci:string,dose_mg:double,dose_unit_raw:string>>"
    order = lambda i, patient, *drugs: (i, patient, 5, dt.datetime(2024, 1, 1), None, [(d, "m", 1.0, "mg") for d in drugs])
    rows = [order(1, 1, 1), order(2, 9, 1), order(3, 1, 1, 8), order(4, 1, 1, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    drugs = spark.createDataFrame(
        [(1, "A", "x", None, True, "", "")],
        "id long, brand_name string, dci string, min_age string, is_psychoactive boolean, contraindications string, indications string",
    )
    patients = spark.createDataFrame(
        [(1, None, None, False, None, False, [])],
        "id long, birthdate date, creatinine_clearance double, is_pregnant boolean, gestational_weeks int, is_breastfeeding boolean, known_allergies array<string>",
    )
    thesaurus = spark.createDataFrame([], "id long, dci_a string, dci_b string, level_fr string, severity string, mechanism string, recommendation string")
    profiles = screening.drug_profiles(drugs, spark.createDataFrame([(1, "x", 1)], "drug_id long, dci string, position int"))
    jobs.screen_events(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), patients, profiles, thesaurus, "2024-01-01",
        str(tmp_path / "alerts"), str(tmp_path / "rejected"), str(tmp_path / "cp"),
    ).awaitTermination()
    assert given == [([1, 4], 6)]
    rules = sorted((r.prescription_id, r.rule) for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    assert rules == [(1, "psychoactive"), (4, "duplicate"), (4, "psychoactive"), (4, "psychoactive")]


def test_documents_sort_their_lists_without_a_comparison_function(spark):
    """Lists of one part are sorted once, as they are; those of several parts come out in the same order."""
    prescriptions = spark.createDataFrame([(1, 7), (2, 7)], "id long, patient_id long")
    lines = spark.createDataFrame([(f"l{n:02}", 1 + n % 2, n, None if n % 3 else "m", 1.0) for n in reversed(range(12))], "id string, prescription_id long, drug_id long, dci string, dose_mg double")
    alerts = spark.createDataFrame(
        [(1, f"l{n:02}", "AGE", "MAJOR", t, None if k else "d") for n in range(0, 12, 2) for k, t in enumerate(("z", None, "a", "z"))],
        "prescription_id long, line_id string, alert_type string, severity string, title string, detail string",
    )
    shown = []
    for size in (10_000, 2):
        documents = reads.prescription_documents(prescriptions, lines, alerts, size)
        assert "array_sort" not in documents._jdf.queryExecution().optimizedPlan().toString()
        shown.append({r.id: [(l.id, [(a.title, a.detail) for a in l.alerts]) for l in r.lines] for r in documents.collect()})
    assert shown[0] == shown[1] and [l for l, _ in shown[0][1]] == [f"l{n:02}" for n in range(0, 12, 2)]
    assert all(a == [(None, None), ("a", None), ("z", None), ("z", "d")] for _, a in shown[0][1]) and not any(a for _, a in shown[0][2])
