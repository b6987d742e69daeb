"""Intake, read, explanation, audit and KPI queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from rxspark.functions import prompts
from rxspark.operators import audit, explain, intake, kpi, reads, screening
from rxspark.plans.queries_catalogue import TH_CTE, closed_thesaurus
from rxspark.plans.queries_screening import (
    ALERTS_CTE, CONTEXT, RENAL_ROWS, VIEWS, all_alerts, line_facts, line_rule, treated_facts,
)
from rxspark.plans.registry import Inputs, query
from rxspark.sources.catalogue_files import export_columns, write_audit_csv, CSV_OPTIONS
from rxspark.session import work_path

_WITH_TH = [*VIEWS, "fx_interactions_raw"]

# --- intake -----------------------------------------------------------------------------------------

query(
    "reference_check", ["fx_prescriptions", "fx_lines", "fx_patients", "fx_drugs"],
    """, bad AS (SELECT DISTINCT prescription_id, drug_id FROM fx_lines WHERE drug_id % 9 = 0)
    SELECT p.id, p.patient_id % 5 <> 0 AS patient_known, coalesce(m.missing, '') AS missing,
      p.patient_id % 5 <> 0 AND m.missing IS NULL AS accepted FROM fx_prescriptions p
    LEFT JOIN (SELECT prescription_id, string_agg(cast(drug_id AS varchar), ',' ORDER BY drug_id) AS missing FROM bad GROUP BY 1) m
      ON m.prescription_id = p.id""",
)(lambda x: intake.check_references(
    x.view("fx_prescriptions"), x.view("fx_lines"), x.view("fx_patients").filter("id % 5 <> 0"),
    x.view("fx_drugs").filter("id % 9 <> 0"),
).select("id", "patient_known", F.array_join("missing_drugs", ",").alias("missing"), "accepted"))
query(
    "validate_lines", ["fx_lines"],
    """SELECT id, concat_ws(',', CASE WHEN length(dci) = 0 THEN 'dci_length' END,
      CASE WHEN dose_mg - 5 <= 0 THEN 'dose_not_positive' END,
      CASE WHEN (duration_days - 10) * 100 NOT BETWEEN 1 AND 3650 THEN 'duration_range' END) AS violations
    FROM (SELECT * REPLACE (CASE WHEN drug_id % 7 = 0 THEN '' ELSE dci END AS dci) FROM fx_lines)""",
)(lambda x: intake.validate_lines(x.view("fx_lines").withColumns({
    "dci": F.when(F.col("drug_id") % 7 == 0, "").otherwise(F.col("dci")), "dose_mg": F.col("dose_mg") - 5,
    "duration_days": (F.col("duration_days") - 10) * 100,
})).select("id", F.array_join("violations", ",").alias("violations")))
query(
    "validate_patients", ["fx_patients"],
    """SELECT id, concat_ws(',', CASE WHEN id % 50 = 0 THEN 'birthdate_missing' END, CASE WHEN id % 9 = 0 THEN 'gender' END,
      CASE WHEN gestational_weeks NOT BETWEEN 1 AND 42 THEN 'gestational_weeks_range' END) AS violations FROM fx_patients""",
)(lambda x: intake.validate_patients(x.view("fx_patients").withColumns({
    "birthdate": F.when(F.col("id") % 50 != 0, F.col("birthdate")),
    "gender": F.when(F.col("id") % 9 == 0, "X").otherwise(F.col("gender")),
})).select("id", F.array_join("violations", ",").alias("violations")))
query(
    "validate_decisions", ["fx_decisions"],
    """SELECT alert_id, concat_ws(',', CASE WHEN decision = 'OVERRIDE' AND trim(coalesce(justification, '')) = ''
      THEN 'justification_required' END) AS violations FROM fx_decisions""",
)(lambda x: intake.validate_decisions(x.view("fx_decisions")).select(
    "alert_id", F.array_join("violations", ",").alias("violations")
))


def order_events(x: Inputs):
    """Order events with their lines as one array, as a client sends them."""
    lines = x.view("fx_lines").groupBy("prescription_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "drug_id", "dci", "dose_mg", "dose_unit_raw"))).alias("lines")
    )
    dropped = F.transform("lines", lambda l: l.dropFields("id"))
    return (
        x.view("fx_prescriptions")
        .join(lines.select(F.col("prescription_id").alias("id"), dropped.alias("lines")), "id")
        .withColumn("hook_event", F.when(F.col("id") % 3 == 0, "order-select"))
    )


_NUMBERED = """, numbered AS (SELECT lpad(cast(prescription_id AS varchar), 20, '0') || '-' || lpad(cast(row_number() OVER
      (PARTITION BY prescription_id ORDER BY id) - 1 AS varchar), 10, '0') AS id, prescription_id, drug_id, dci, dose_mg,
      dose_unit_raw FROM fx_lines)"""
query("event_lines", ["fx_lines", "fx_prescriptions"], _NUMBERED + " SELECT * FROM numbered")(
    lambda x: intake.event_lines(order_events(x))
)
query(
    "event_headers", ["fx_lines", "fx_prescriptions"],
    """SELECT p.id, patient_id, doctor_id, created_at, 'draft' AS status,
      CASE WHEN p.id % 3 = 0 THEN 'order-select' ELSE 'order-sign' END AS hook_event, cast(n AS int) AS line_count
    FROM fx_prescriptions p JOIN (SELECT prescription_id AS id, count(*) AS n FROM fx_lines GROUP BY 1) USING (id)""",
)(lambda x: intake.event_headers(order_events(x)))
query(
    "validate_orders", ["fx_lines", "fx_prescriptions"],
    """SELECT p.id, CASE WHEN p.id % 4 = 0 OR n IS NULL THEN 'no_lines' ELSE '' END AS violations FROM fx_prescriptions p
    JOIN (SELECT prescription_id AS id, count(*) AS n FROM fx_lines GROUP BY 1) USING (id)""",
)(lambda x: intake.validate_orders(order_events(x).withColumn(
    "lines", F.when(F.col("id") % 4 != 0, F.col("lines"))
)).select("id", F.array_join("violations", ",").alias("violations")))
query(
    "patient_update", ["fx_patients"],
    """, u AS (SELECT id, CASE WHEN id % 2 = 0 THEN id % 90 + 0.5 ELSE NULL END AS cl, id % 4 = 1 AS bf, id % 2 = 0 OR id % 3 = 0 AS set_cl,
        id % 5 = 0 AS set_bf FROM fx_patients)
    SELECT id, gender, CASE WHEN set_cl THEN cl ELSE creatinine_clearance END AS creatinine_clearance,
      CASE WHEN set_bf THEN bf ELSE is_breastfeeding END AS is_breastfeeding FROM fx_patients JOIN u USING (id)""",
)(lambda x: _patient_update(x))


def _patient_update(x: Inputs):
    """Two updates per patient: an older one that a newer one partly overrides."""
    base = x.view("fx_patients").select("id", "gender", "creatinine_clearance", "is_breastfeeding")
    even, third, fifth = (F.col("id") % n == 0 for n in (2, 3, 5))
    set_cl = even | third
    older = base.select(
        "id", F.lit(1).alias("ord"), F.lit(1).cast("decimal(6,2)").alias("creatinine_clearance"), (F.col("id") % 4 == 1).alias("is_breastfeeding"),
        F.array_compact(F.array(F.when(set_cl, "creatinine_clearance"), F.when(fifth, "is_breastfeeding"))).alias("set_fields"),
    )
    newer = base.select(
        "id", F.lit(2).alias("ord"), F.when(even, (F.col("id") % 90 + F.lit(0.5)).cast("decimal(6,2)")).alias("creatinine_clearance"),
        F.lit(True).alias("is_breastfeeding"),
        F.array_compact(F.array(F.when(set_cl, "creatinine_clearance"))).alias("set_fields"),
    )
    return intake.update_patients(base, older.unionByName(newer), ["creatinine_clearance", "is_breastfeeding"], "ord")


# --- reads ------------------------------------------------------------------------------------------

query(
    "drug_search", ["fx_drugs", "fx_components", "fx_searches"],
    """, asked AS (SELECT DISTINCT trim(q) AS q FROM fx_searches WHERE length(q) >= 2),
    ranked AS (SELECT q, d.*, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN brand_name ILIKE q || '%' THEN 0 ELSE 1 END,
      brand_name, id) AS position FROM asked JOIN fx_drugs d ON brand_name ILIKE '%' || q || '%' OR dci ILIKE '%' || q || '%')
    SELECT q, cast(r.position AS int) AS position, r.id, brand_name, presentation, dosage_raw, coalesce(c.dci, r.dci) AS dci, labo_name, atc_code,
      nullif(price_ppv, 0) AS price_ppv, nullif(price_hospital, 0) AS price_hospital, product_type, indications, min_age, is_psychoactive
    FROM ranked r LEFT JOIN fx_components c ON c.drug_id = r.id AND c.position = 1 WHERE r.position <= 8""",
)(lambda x: reads.search_drugs(x.view("fx_drugs"), x.view("fx_components"), x.view("fx_searches")))
query(
    "drug_detail", ["fx_drugs", "fx_components"],
    """SELECT d.id, brand_name, d.dci, price_ppv, coalesce(string_agg(c.position || ':' || c.dci, '|' ORDER BY c.position), '') AS components
    FROM fx_drugs d LEFT JOIN fx_components c ON c.drug_id = d.id GROUP BY ALL""",
)(lambda x: reads.drug_details(x.view("fx_drugs"), x.view("fx_components")).select(
    "id", "brand_name", "dci", "price_ppv",
    F.array_join(F.transform("components", lambda c: F.concat_ws(":", c["position"].cast("string"), c["dci"])), "|").alias("components"),
))
_PATIENT_QUERY = (
    "CASE c_custkey % 4 WHEN 0 THEN ' ' || cast(c_custkey AS string) WHEN 1 THEN '{00000000-0000-4000-8000-' || "
    "lpad(cast(c_custkey AS string), 12, '0') || '}' WHEN 2 THEN 'urn:uuid:000000000000400080' || '00' || lpad(cast(c_custkey AS string), 12, '0') "
    "ELSE 'dupont ' || cast(c_custkey AS string) END"
)
query(
    "patient_search", ["fx_patients"],
    f", q AS (SELECT c_custkey, {_PATIENT_QUERY} AS q FROM customer) SELECT q, id, gender FROM q JOIN fx_patients"
    " ON id = c_custkey WHERE c_custkey % 4 <> 3",
)(lambda x: reads.search_patients(
    x.view("fx_patients"), x.table("customer").selectExpr(f"{_PATIENT_QUERY} AS q")
).select("q", "id", "gender"))


def stored_alerts(x: Inputs):
    """Alerts as screening leaves them, in buckets of prescriptions: written once, read by the queries that need them twice."""
    return screening.co_located(all_alerts(x), placed=True)


def _documents(x: Inputs):
    lines = x.view("fx_lines").select("id", "prescription_id", "drug_id", "dci", "dose_mg")
    return reads.prescription_documents(x.view("fx_prescriptions"), screening.co_located(lines), stored_alerts(x))


query(
    "prescription_document", _WITH_TH,
    ALERTS_CTE + """, per_line AS (SELECT line_id, string_agg(severity || ':' || title, '|' ORDER BY alert_type, severity, title, detail) AS txt
      FROM alerts GROUP BY 1)
    SELECT p.id, p.patient_id, string_agg(l.id || '=' || coalesce(txt, ''), ';' ORDER BY l.id) AS lines
    FROM fx_prescriptions p LEFT JOIN fx_lines l ON l.prescription_id = p.id LEFT JOIN per_line ON line_id = l.id GROUP BY 1, 2""",
)(lambda x: _documents(x).select("id", "patient_id", F.array_join(F.transform("lines", lambda l: F.concat(
    l["id"], F.lit("="), F.array_join(F.transform(l["alerts"], lambda a: F.concat_ws(":", a["severity"], a["title"])), "|")
)), ";").alias("lines")))
query(
    "prescription_response", _WITH_TH,
    ALERTS_CTE + """ SELECT p.id, coalesce(a.n, 0) AS alert_count, coalesce(l.n, 0) AS line_count FROM fx_prescriptions p
      LEFT JOIN (SELECT prescription_id AS id, count(*) AS n FROM alerts GROUP BY 1) a USING (id)
      LEFT JOIN (SELECT prescription_id AS id, count(*) AS n FROM fx_lines GROUP BY 1) l USING (id)""",
)(lambda x: reads.flatten_response(_documents(x)).select("id", "alert_count", "line_count"))
query(
    "history_counts", _WITH_TH,
    ALERTS_CTE + """ SELECT p.id, coalesce(l.n, 0) AS line_count, coalesce(a.n, 0) AS alert_count FROM fx_prescriptions p
      LEFT JOIN (SELECT prescription_id AS id, count(*) AS n FROM alerts GROUP BY 1) a USING (id)
      LEFT JOIN (SELECT prescription_id AS id, count(*) AS n FROM fx_lines GROUP BY 1) l USING (id)""",
)(lambda x: reads.history_counts(
    x.view("fx_prescriptions"), x.view("fx_lines"), all_alerts(x)
).select("id", "line_count", "alert_count"))
query(
    "latest_per_patient", ["fx_prescriptions"],
    """SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) AS int) AS position
      FROM fx_prescriptions) WHERE position BETWEEN 3 AND 22""",
)(lambda x: reads.latest_per_owner(x.view("fx_prescriptions"), "patient_id", 2, 20))
query(
    "latest_per_doctor", _WITH_TH,
    ALERTS_CTE + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doctor_id ORDER BY created_at DESC, id DESC)
      AS position FROM fx_prescriptions) WHERE position <= 30)
    SELECT id, doctor_id, cast(position AS int) AS position, coalesce(l.n, 0) AS line_count, coalesce(a.n, 0) AS alert_count FROM latest
      LEFT JOIN (SELECT prescription_id AS id, count(*) AS n FROM alerts GROUP BY 1) a USING (id)
      LEFT JOIN (SELECT prescription_id AS id, count(*) AS n FROM fx_lines GROUP BY 1) l USING (id)""",
)(lambda x: reads.flatten_response(reads.doctor_overview(
    x.view("fx_prescriptions"), x.view("fx_lines"), stored_alerts(x)
)).select("id", "doctor_id", "position", "line_count", "alert_count"))

# --- explanations -------------------------------------------------------------------------------------


def numbered(alerts, *keys):
    """Alert ids: a hash of the alert's own values and, for alerts that are equal in all of them, a running number.

    Equal alerts have one ``keys`` in common: alerts that lie in buckets of these are numbered there, sorted by ``keys`` first, so that
    later joins by these need no other order.
    """
    # the hash is sorted as 16 bytes, not as 32 letters
    alerts = alerts.withColumn("_own", F.unhex(F.md5(F.concat_ws("#", "line_id", "rule", "title", "detail").cast("binary"))))
    copy = F.row_number().over(Window.partitionBy(*keys, "_own").orderBy("line_id"))
    name = F.concat_ws("#", F.lower(F.hex("_own")), F.col("_copy").cast("string"))
    return alerts.withColumn("_copy", copy).withColumn("alert_id", name).drop("_own", "_copy")


_ALERT_ID = """md5(line_id || '#' || rule || '#' || title || '#' || detail) || '#' ||
      cast(row_number() OVER (PARTITION BY line_id, rule, title, detail ORDER BY line_id) AS varchar) AS alert_id"""
_NUMBERED_ALERTS = ALERTS_CTE + f""", numbered AS (SELECT *, {_ALERT_ID},
      trim(string_split(title, '—')[-1]) AS tail FROM alerts),
  aged AS (SELECT n.*, (SELECT age FROM ctx WHERE ctx.line_id = n.line_id) AS age FROM numbered n)"""


def aged_parts(facts, thesaurus):
    """Alerts of lines with an id, with the patient's age, by the types that a part holds: interactions, and all others. The id of a line
    names its prescription.

    Equal alerts are of one type, so each part is numbered by itself, and sorts fewer rows at once. Interactions say what their thesaurus
    row says: in files of their own such texts stand once for many alerts, which they do not among texts that name a drug or a dose.
    """
    alerts = screening.co_located(screening.alerts_of(facts, thesaurus).filter("line_id IS NOT NULL"), placed=True)
    ages = facts.select("prescription_id", "line_id", F.col("age").alias("patient_age"))
    kind = F.col("alert_type")
    parts = {
        ("INTERACTION",): alerts.filter(kind == "INTERACTION").withColumn("alert_type", F.lit("INTERACTION")),
        ("ALLERGY", "CONTRA_INDICATION", "POSOLOGY", "REDUNDANT_DCI", "RENAL"): alerts.filter(kind != "INTERACTION"),
    }
    return {types: numbered(part, "prescription_id", "line_id").join(ages, ["prescription_id", "line_id"]) for types, part in parts.items()}


def aged_alerts(facts, thesaurus):
    return _together(aged_parts(facts, thesaurus).values())


def _together(parts):
    return reduce(DataFrame.unionByName, parts)


_TEXT_CONTEXT = """, text_context AS (SELECT *, CASE alert_type WHEN 'INTERACTION' THEN trim(string_split(tail, '/')[1]) END AS dci_a,
    CASE alert_type WHEN 'INTERACTION' THEN trim(string_split(tail, '/')[2]) END AS dci_b,
    CASE WHEN rule = 'allergy_exact' THEN regexp_extract(detail, 'allergie documentée à : ([^.]*)\\.', 1)
      WHEN rule = 'allergy_text' THEN 'l''allergène' END AS allergen,
    CASE WHEN rule = 'allergy_family' THEN regexp_extract(detail, 'allergique aux ([^.]+)\\.', 1) END AS allergen_family,
    CASE WHEN alert_type IN ('ALLERGY', 'CONTRA_INDICATION', 'POSOLOGY', 'RENAL') THEN tail END AS drug_name,
    CASE WHEN rule = 'allergy_family' THEN regexp_extract(detail, '\\(DCI : ([^)]+)\\)', 1)
      WHEN alert_type IN ('ALLERGY', 'RENAL', 'REDUNDANT_DCI') THEN tail WHEN alert_type = 'CONTRA_INDICATION' THEN '' END AS dci,
    CASE rule WHEN 'pregnancy' THEN 'femme enceinte' WHEN 'breastfeeding' THEN 'patiente allaitante' END AS context,
    CASE WHEN alert_type = 'POSOLOGY' THEN coalesce(cast(nullif(age, 0) AS varchar), 'inconnu') END AS patient_age,
    CASE rule WHEN 'age' THEN regexp_extract(detail, 'à partir de ([^.]*)\\.', 1) WHEN 'psychoactive' THEN 'un certain âge' END AS min_age,
    CASE WHEN rule = 'duplicate' THEN trim(string_split(detail, ':')[2]) END AS drug_list,
    CASE WHEN rule = 'renal' THEN regexp_extract(detail, 'Clairance du patient : ([0-9.]+)', 1) END AS crcl,
    CASE WHEN rule = 'renal' THEN regexp_extract(detail, '< ([0-9.]+) mL/min', 1) END AS threshold FROM aged)"""
_TEXT_FIELDS = ["dci_a", "dci_b", "allergen", "allergen_family", "drug_name", "dci", "context", "patient_age", "min_age",
                "drug_list", "crcl", "threshold"]

query("explainable_alerts", _WITH_TH, ALERTS_CTE + " SELECT line_id, title, severity FROM alerts WHERE severity <> 'MINOR'")(
    lambda x: explain.explainable(all_alerts(x)).select("line_id", "title", "severity")
)
query(
    "alert_text_context", _WITH_TH,
    _NUMBERED_ALERTS + _TEXT_CONTEXT + f" SELECT alert_id, detail, {', '.join(_TEXT_FIELDS)} FROM text_context",
)(lambda x: _together(
    explain.text_context(part).select("alert_id", "detail", *_TEXT_FIELDS)
    for part in aged_parts(treated_facts(x, "age"), closed_thesaurus(x)).values()
))
_FOUND = """, keyed AS (SELECT *, strip_accents(upper(dci_a)) AS ka, strip_accents(upper(dci_b)) AS kb FROM th),
  touching AS (SELECT DISTINCT prescription_id, k.id FROM keyed k JOIN upper_keys u ON u.key IN (k.dci_a, k.dci_b)),
  several AS (SELECT prescription_id FROM upper_keys GROUP BY 1 HAVING count(DISTINCT key) >= 2),
  titles AS (SELECT DISTINCT prescription_id, title FROM alerts WHERE alert_type = 'INTERACTION'),
  first_row AS (SELECT a.prescription_id, a.title, min(k.id) AS id FROM titles a JOIN touching t USING (prescription_id)
    JOIN several USING (prescription_id) JOIN keyed k ON k.id = t.id
    WHERE contains(upper(a.title), ka) OR contains(upper(a.title), kb) GROUP BY ALL)"""
query(
    "alert_interaction_context", _WITH_TH,
    ALERTS_CTE + _FOUND + f""", ids AS (SELECT *, {_ALERT_ID} FROM alerts WHERE alert_type = 'INTERACTION')
    SELECT alert_id, th.dci_a, th.dci_b, th.level_fr, th.mechanism, th.recommendation
      FROM ids a JOIN first_row f ON f.prescription_id = a.prescription_id AND f.title = a.title JOIN th ON th.id = f.id""",
)(lambda x: _interaction_contexts(x))


def _interaction_contexts(x: Inputs):
    """Alerts of lines with an id are numbered in their prescription; the id of others may stand in any."""
    facts, known = line_facts(x, *screening.INTERACTION_FACTS), closed_thesaurus(x)
    alerts = screening.co_located(screening.interaction_alerts(facts, known).select("prescription_id", "line_id", "rule", "title", "detail"), placed=True)
    own = explain.interaction_context(numbered(alerts.filter("line_id IS NOT NULL"), "prescription_id", "line_id"), facts, known)
    return own.unionByName(explain.interaction_context(numbered(alerts.filter("line_id IS NULL")), facts, known))


query(
    "alert_renal_context", VIEWS,
    CONTEXT + f""", shown AS (SELECT DISTINCT c.line_id, c.prescription_id, c.name FROM ctx c JOIN line_keys k USING (line_id)
      JOIN ({RENAL_ROWS}) r(ord, w, t, severity, message) ON contains(k.key, r.w) AND crcl < t)
    SELECT s.line_id, arg_min(d.dci, d.id) AS found_dci FROM shown s JOIN fx_lines l USING (prescription_id) JOIN fx_drugs d
      ON d.id = l.drug_id WHERE contains(s.name, d.brand_name) GROUP BY s.line_id""",
)(lambda x: explain.renal_context(
    line_rule("renal")(x).withColumn("alert_id", F.col("line_id")), x.view("fx_lines"), x.view("fx_drugs")
).select(F.col("alert_id").alias("line_id"), "found_dci"))


def _prompt_sql() -> str:
    """CASE over the alert kinds that replaces the markers one by one."""
    kinds = {
        "allergy_family": "ALLERGY_CROSS", "allergy_exact": "ALLERGY", "allergy_text": "ALLERGY", "age": "POSOLOGY",
        "psychoactive": "POSOLOGY", "pregnancy": "CONTRA_INDICATION", "breastfeeding": "CONTRA_INDICATION",
        "duplicate": "REDUNDANT_DCI", "renal": "RENAL", "interaction": "INTERACTION",
    }
    parts = []
    for rule, kind in kinds.items():
        text = "'" + prompts.TEMPLATES[kind].replace("'", "''") + "'"
        for name, default in prompts.DEFAULTS[kind].items():
            value = f"coalesce(nullif({name}, ''), '{default}')" if name in ("mechanism", "recommendation") else name
            text = f"replace({text}, '{{{name}}}', {value})"
        parts.append(f"WHEN '{rule}' THEN {text}")
    return f"CASE rule {' '.join(parts)} END"


_FROM_ROW = "".join(
    f", CASE WHEN th.id IS NOT NULL THEN th.{c} WHEN rule = 'interaction' THEN {own} END AS {c}"
    for c, own in (("dci_a", "t.dci_a"), ("dci_b", "t.dci_b"), ("level_fr", "'interaction'"), ("mechanism", "''"), ("recommendation", "t.detail"))
)
_FULL_CONTEXT = _NUMBERED_ALERTS + _TEXT_CONTEXT + _FOUND + f""", renal_found AS (
      SELECT n.alert_id, nullif(arg_min(d.dci, d.id), '') AS found_dci FROM numbered n JOIN fx_lines l USING (prescription_id)
        JOIN fx_drugs d ON d.id = l.drug_id WHERE n.rule = 'renal' AND contains(n.tail, d.brand_name) GROUP BY 1),
    whole AS (SELECT t.alert_id, t.rule, t.detail, t.allergen, t.allergen_family, t.drug_name, coalesce(r.found_dci, t.dci) AS dci, t.context,
        t.patient_age, t.min_age, t.drug_list, t.crcl, t.threshold{_FROM_ROW}
      FROM text_context t LEFT JOIN first_row f ON t.rule = 'interaction' AND f.prescription_id = t.prescription_id AND f.title = t.title
      LEFT JOIN th ON th.id = f.id LEFT JOIN renal_found r ON r.alert_id = t.alert_id)"""


def full_contexts(x: Inputs):
    """Every alert with its whole context: title and detail, thesaurus row, molecules; in parts by type."""
    facts, known = treated_facts(x, "age", "drug_id"), closed_thesaurus(x)
    return [
        explain.alert_context(part, facts, known, x.view("fx_drugs"), types) for types, part in aged_parts(facts, known).items()
    ]


query("alert_prompts", _WITH_TH, _FULL_CONTEXT + f" SELECT alert_id, detail, {_prompt_sql()} AS prompt FROM whole")(
    lambda x: _together(explain.build_prompts(part).select("alert_id", "detail", "prompt") for part in full_contexts(x))
)
query("alert_full_context", _WITH_TH, _FULL_CONTEXT + f" SELECT alert_id, {', '.join(explain.CONTEXT_FIELDS)} FROM whole")(
    lambda x: _together(part.select("alert_id", *explain.CONTEXT_FIELDS) for part in full_contexts(x))
)
query(
    "explanation_filter", ["fx_alerts", "fx_completions"],
    """SELECT a.id AS alert_id, severity, CASE WHEN severity <> 'MINOR' AND length(trim(answer)) BETWEEN 20 AND 800 THEN trim(answer) END
      AS rag_explanation FROM fx_alerts a LEFT JOIN fx_completions c ON c.alert_id = a.id""",
)(lambda x: explain.attach_explanations(
    x.view("fx_alerts").withColumnRenamed("id", "alert_id"), x.view("fx_completions")
).select("alert_id", "severity", "rag_explanation"))
_SHORT = "'Justification trop courte pour être médicalement valide.'"
_PRESCREEN = f""", pre AS (SELECT *, decision = 'OVERRIDE' AND trim(coalesce(justification, '')) <> ''
      AND length(trim(justification)) < 10 AS short, coalesce(decision = 'OVERRIDE' AND length(trim(justification)) >= 10, false) AS needs_model
      FROM fx_decisions)"""
query(
    "justification_prescreen", ["fx_decisions"],
    _PRESCREEN + f" SELECT alert_id, CASE WHEN short THEN false END AS valid, CASE WHEN short THEN {_SHORT} END AS feedback,"
    " needs_model FROM pre",
)(lambda x: explain.prescreen_justifications(x.view("fx_decisions")).select("alert_id", "valid", "feedback", "needs_model"))
# the last value of a key, as it is written
_LAST = """regexp_extract_all(b, '"{key}"\\s*:\\s*("[^"]*"|\\[[^\\]]*\\]|[^,}}]+)', 1)[-1]"""
_VERDICT = f""", verdicts AS (SELECT alert_id, json_valid(b) AND b <> '' AS good, coalesce(v NOT IN ('false', '0', '""', '[]', 'null'), false) AS v,
      left(CASE WHEN f IS NULL THEN '' WHEN f = 'null' THEN 'None' WHEN f IN ('true', 'false') THEN upper(left(f, 1)) || substr(f, 2)
        WHEN f LIKE '[%' THEN replace(replace(f, '"', ''''), 'true', 'True') ELSE trim(f, '"') END, 200) AS f
      FROM (SELECT *, {_LAST.format(key="valid")} AS v, {_LAST.format(key="feedback")} AS f
        FROM (SELECT alert_id, regexp_extract(verdict, '(?s)(\\{{.*\\}})', 1) AS b FROM fx_completions)))"""
query(
    "verdict_parse", ["fx_completions"],
    _VERDICT + " SELECT alert_id, CASE WHEN good THEN v END AS valid, CASE WHEN good THEN f END AS feedback FROM verdicts",
)(lambda x: explain.parse_verdicts(x.view("fx_completions")).select("alert_id", "valid", "feedback"))
query(
    "verdict_labels", ["fx_decisions", "fx_completions"],
    _PRESCREEN + _VERDICT + f""" SELECT alert_id, decision, CASE WHEN short THEN 'noise' WHEN needs_model AND good THEN
        CASE WHEN v THEN 'valid' ELSE 'noise' END END AS justification_valid,
      CASE WHEN short THEN {_SHORT} WHEN needs_model AND good THEN f END AS justification_feedback
    FROM pre LEFT JOIN verdicts USING (alert_id)""",
)(lambda x: explain.judge_decisions(x.view("fx_decisions"), x.view("fx_completions")).select(
    "alert_id", "decision", "justification_valid", "justification_feedback"
))
query(
    "override_prompts", ["fx_audit"],
    "SELECT id, replace(replace(replace(replace('" + prompts.OVERRIDE.replace("'", "''")
    + "', '{alert_type}', coalesce(alert_type, 'inconnue')), '{alert_severity}', alert_severity), '{alert_title}',"
    " coalesce(alert_title, 'inconnue')), '{justification}', justification) AS prompt FROM fx_audit WHERE justification IS NOT NULL",
)(lambda x: explain.override_prompts(x.view("fx_audit").filter("justification IS NOT NULL")).select("id", "prompt"))

# --- audit ---------------------------------------------------------------------------------------------

query(
    "decision_snapshot", ["fx_decisions", "fx_alerts"],
    """SELECT d.alert_id, d.prescription_id, decision, alert_type, severity AS alert_severity, title AS alert_title
    FROM fx_decisions d JOIN fx_alerts a ON a.id = d.alert_id""",
)(lambda x: audit.snapshot_decisions(x.view("fx_decisions"), x.view("fx_alerts")).select(
    "alert_id", "prescription_id", "decision", "alert_type", "alert_severity", "alert_title"
))
query(
    "unknown_alert_decisions", ["fx_decisions", "fx_alerts"],
    "SELECT alert_id, decision FROM fx_decisions WHERE alert_id NOT IN (SELECT id FROM fx_alerts)",
)(lambda x: audit.unknown_alerts(x.view("fx_decisions"), x.view("fx_alerts")).select("alert_id", "decision"))
_LABELLED = f""", labelled AS (SELECT * EXCLUDE (short, needs_model), CASE WHEN short THEN 'noise' WHEN needs_model AND good THEN
        CASE WHEN v THEN 'valid' ELSE 'noise' END END AS justification_valid,
      CASE WHEN short THEN {_SHORT} WHEN needs_model AND good THEN f END AS justification_feedback
    FROM pre LEFT JOIN verdicts USING (alert_id))"""
_STORED = ["alert_id", "prescription_id", "doctor_id", "decision", "justification", "alert_type", "alert_severity", "alert_title",
           "justification_valid", "justification_feedback"]
_STORED_SQL = """ SELECT alert_id, l.prescription_id, l.doctor_id, decision, justification, alert_type, severity AS alert_severity, title AS alert_title,
      justification_valid, justification_feedback FROM labelled l JOIN fx_alerts a ON a.id = l.alert_id"""
query("stored_decisions", ["fx_decisions", "fx_alerts", "fx_completions"], _PRESCREEN + _VERDICT + _LABELLED + _STORED_SQL)(
    lambda x: audit.stored_decisions(x.view("fx_decisions"), x.view("fx_alerts"), x.view("fx_completions")).select(*_STORED)
)
query(
    "bulk_decisions", ["fx_decisions", "fx_alerts", "fx_completions"],
    """, sent AS (SELECT prescription_id, doctor_id, alert_id, decision, justification FROM fx_decisions
      UNION ALL SELECT prescription_id, doctor_id, alert_id + 1200, 'OVERRIDE', justification FROM fx_decisions)"""
    + _PRESCREEN.replace("FROM fx_decisions", "FROM sent") + _VERDICT + _LABELLED + _STORED_SQL,
)(lambda x: audit.bulk_decisions(
    # two decisions to a payload: the one of the event and one for a later alert of the same prescription
    x.view("fx_decisions").select(
        "prescription_id", "doctor_id",
        F.array(
            F.struct("alert_id", "decision", "justification"),
            F.struct((F.col("alert_id") + 1200).alias("alert_id"), F.lit("OVERRIDE").alias("decision"), "justification"),
        ).alias("decisions"),
    ), x.view("fx_alerts"), x.view("fx_completions"),
).select(*_STORED))
query(
    "audit_history", ["fx_audit"], "SELECT prescription_id, created_at, id, decision, alert_type FROM fx_audit",
)(lambda x: audit.history(x.view("fx_audit")).select("prescription_id", "created_at", "id", "decision", "alert_type"))
query(
    "audit_recent", ["fx_audit"], "SELECT id, created_at, decision FROM fx_audit ORDER BY created_at DESC, id DESC LIMIT 50",
)(lambda x: audit.recent(x.view("fx_audit")).select("id", "created_at", "decision"))
query(
    "audit_actions", ["fx_audit"],
    """SELECT id, created_at AS timestamp, CASE decision WHEN 'OVERRIDE' THEN decision ELSE 'ALERT_' || decision END AS action,
      alert_severity AS severity, coalesce(alert_title, '—') AS detail, coalesce(alert_type, '—') AS drug, justification AS justif,
      justification_valid FROM fx_audit""",
)(lambda x: audit.to_actions(x.view("fx_audit")))
query(
    "audit_action_filter", ["fx_audit"], "SELECT id, 'ALERT_IGNORED' AS action FROM fx_audit WHERE decision = 'IGNORED'",
)(lambda x: audit.to_actions(x.view("fx_audit"), "ALERT_IGNORED").select("id", "action"))
query(
    "decision_completeness", ["fx_alerts", "fx_decisions"],
    """SELECT a.prescription_id, count(*) AS alerts, bool_and(d.decision IS NOT NULL) AS all_decided,
      count(*) FILTER (d.decision = 'OVERRIDE' AND trim(coalesce(d.justification, '')) = '') AS overrides_missing_text,
      bool_and(d.decision IS NOT NULL) AND count(*) FILTER (d.decision = 'OVERRIDE' AND trim(coalesce(d.justification, '')) = '') = 0
        AS can_confirm FROM fx_alerts a LEFT JOIN (SELECT * FROM fx_decisions WHERE alert_id % 7 <> 3) d ON d.alert_id = a.id GROUP BY 1""",
)(lambda x: audit.completeness(x.view("fx_alerts"), x.view("fx_decisions").filter("alert_id % 7 <> 3")))
query(
    "severity_counts", ["fx_alerts"],
    """SELECT prescription_id, count(*) FILTER (severity = 'MAJOR') AS major, count(*) FILTER (severity = 'MODERATE') AS moderate,
      count(*) FILTER (severity = 'MINOR') AS minor FROM fx_alerts GROUP BY 1""",
)(lambda x: audit.severity_counts(x.view("fx_alerts")))
query(
    "ignore_score_band", ["fx_alerts"],
    """SELECT id, CASE WHEN ai_ignore_proba >= 0.7 THEN 'Souvent ignoré (' || cast(floor(ai_ignore_proba * 100 + 0.5) AS int) || '%)'
      ELSE 'Pertinent (' || cast(floor((1 - ai_ignore_proba) * 100 + 0.5) AS int) || '%)' END AS badge FROM fx_alerts""",
)(lambda x: audit.score_band(x.view("fx_alerts")).select("id", "badge"))


@query(
    "audit_csv_export", ["fx_audit"],
    """SELECT cast(id AS varchar) AS "ID", strftime(created_at, '%d/%m/%Y %H:%M:%S') AS "Date", decision AS "Décision",
      coalesce(alert_type, '') AS "Type alerte", alert_severity AS "Sévérité", coalesce(alert_title, '') AS "Titre alerte",
      coalesce(justification, '') AS "Justification", coalesce(justification_valid, '') AS "Validation sémantique" FROM fx_audit""",
)
def _audit_csv(x: Inputs):
    """The export written as CSV and read back."""
    path = work_path(x.spark, "audit-csv")
    write_audit_csv(x.view("fx_audit"), path)
    return x.spark.read.options(**CSV_OPTIONS).csv(path).fillna("")


# --- key figures ------------------------------------------------------------------------------------------

_TODAY = "1999-06-01"


def _kpis(x: Inputs):
    return kpi.system_kpis(x.view("fx_users"), x.view("fx_prescriptions"), x.view("fx_audit"), _TODAY)


_KPI_SQL = f""", kpi AS (SELECT (SELECT count(*) FROM fx_users) AS total_users,
      (SELECT count(*) FROM fx_users WHERE role = 'doctor' AND is_active) AS active_doctors,
      (SELECT count(*) FROM fx_users WHERE role = 'pharmacist' AND is_active) AS active_pharmacists,
      (SELECT count(*) FROM fx_prescriptions) AS total_prescriptions,
      (SELECT count(*) FROM fx_prescriptions WHERE created_at >= DATE '{_TODAY}') AS prescriptions_today,
      (SELECT count(*) FROM fx_audit) AS total_audit_entries,
      (SELECT round_even(100.0 * count(*) FILTER (decision = 'OVERRIDE') / count(*), 1) FROM fx_audit) AS override_rate,
      (SELECT round_even(100.0 * count(*) FILTER (decision = 'ACCEPTED') / count(*), 1) FROM fx_audit) AS compliance_rate)"""
_KPI_VIEWS = ["fx_users", "fx_prescriptions", "fx_audit"]
query("system_kpis", _KPI_VIEWS, _KPI_SQL + " SELECT * FROM kpi")(_kpis)
query(
    "target_check", [*_KPI_VIEWS, "fx_requests"],
    _KPI_SQL + """, lat AS (SELECT round(avg(latency_ms), 4) AS v FROM fx_requests)
    SELECT 'override_rate' AS kpi, override_rate AS value, 20.0 AS target, override_rate < 20 AS ok FROM kpi
    UNION ALL SELECT 'compliance_rate', compliance_rate, 80.0, compliance_rate > 80 FROM kpi
    UNION ALL SELECT 'latency_ms', v, 300.0, v < 300 FROM lat""",
)(lambda x: kpi.target_check(_kpis(x), x.view("fx_requests").agg(F.round(F.avg("latency_ms"), 4).alias("latency_ms"))))
_TOP = "SELECT alert_type, count(*) AS n FROM fx_audit WHERE alert_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, alert_type LIMIT 5"
query("top_alert_types", ["fx_audit"], _TOP)(lambda x: kpi.top_alert_types(x.view("fx_audit")))
query(
    "top_alert_share", ["fx_audit"], f"SELECT alert_type, n, 100.0 * n / max(n) OVER () AS share_pct FROM ({_TOP})",
)(lambda x: kpi.relative_share(kpi.top_alert_types(x.view("fx_audit"))))
query(
    "alert_counters", _WITH_TH, ALERTS_CTE + " SELECT alert_type, severity, count(*) AS n FROM alerts GROUP BY CUBE (alert_type, severity)",
)(lambda x: kpi.alert_counters(all_alerts(x)))
query(
    "enriched_counters", ["fx_alerts", "fx_completions"],
    """SELECT alert_type, count(*) AS n FROM fx_alerts a JOIN fx_completions c ON c.alert_id = a.id WHERE severity <> 'MINOR'
      AND length(trim(answer)) BETWEEN 20 AND 800 GROUP BY 1""",
)(lambda x: kpi.enriched_counters(explain.attach_explanations(
    x.view("fx_alerts").withColumnRenamed("id", "alert_id"), x.view("fx_completions")
)))
query(
    "status_counters", _WITH_TH,
    ALERTS_CTE + """ SELECT CASE WHEN id IN (SELECT prescription_id FROM alerts) THEN 'alerts' ELSE 'safe' END AS status, count(*) AS n
    FROM fx_prescriptions GROUP BY 1""",
)(lambda x: kpi.status_counters(screening.prescription_status(x.view("fx_prescriptions"), all_alerts(x))))
query(
    "decision_counters", ["fx_audit"],
    "SELECT decision, coalesce(alert_type, 'UNKNOWN') AS alert_type, alert_severity, count(*) AS n FROM fx_audit GROUP BY ALL",
)(lambda x: kpi.decision_counters(x.view("fx_audit")))
query(
    "override_rate", ["fx_audit"], "SELECT 100.0 * count(*) FILTER (decision = 'OVERRIDE') / count(*) AS override_pct FROM fx_audit",
)(lambda x: kpi.override_rate(x.view("fx_audit")))
query(
    "decision_breakdown", ["fx_audit"], "SELECT decision, count(*) AS n FROM fx_audit GROUP BY 1",
)(lambda x: kpi.decision_breakdown(x.view("fx_audit")))
_SLIDE = """ SELECT date_trunc('minute', {ts}) + to_minutes(cast(s AS bigint)) AS window_end, {keys}, count(*) / 5.0 AS per_minute
    FROM {table}, range(1, 6) r(s) {where} GROUP BY ALL"""
query(
    "alerts_per_minute", ["fx_audit"], _SLIDE.format(ts="created_at", keys="alert_type", table="fx_audit", where=""),
)(lambda x: kpi.sliding_rate(x.view("fx_audit"), "created_at", ["alert_type"]))
query(
    "requests_per_minute", ["fx_requests"], _SLIDE.format(ts="ts", keys="endpoint", table="fx_requests", where=""),
)(lambda x: kpi.sliding_rate(x.view("fx_requests"), "ts", ["endpoint"]))
query(
    "errors_per_minute", ["fx_requests"],
    _SLIDE.format(ts="ts", keys="CASE WHEN status < 500 THEN '4xx' ELSE '5xx' END AS status_class", table="fx_requests", where="WHERE status >= 400"),
)(lambda x: kpi.sliding_rate(kpi.status_class(x.view("fx_requests")), "ts", ["status_class"]))


def _quantile_sql(q: float) -> str:
    # latencies of the test events lie below 100 ms, so the bounds are finer than the defaults
    bounds = [0.002, 0.005, 0.01, 0.02]
    cases = "".join(
        f" WHEN b{i} >= total * {q} THEN {b0} + ({b1} - {b0}) * (total * {q} - {prev}) / nullif(b{i} - {prev}, 0)"
        for i, (b0, b1, prev) in enumerate(zip([0.0, *bounds], bounds, ["0", "b0", "b1", "b2"]))
    )
    return f"1000.0 * CASE{cases} ELSE {bounds[-1]} END AS p{round(q * 100)}_ms"


query(
    "latency_quantiles", ["fx_requests"],
    ", b AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (latency_ms / 1000.0 <= {b}) AS b{i}" for i, b in enumerate([0.002, 0.005, 0.01, 0.02]))
    + " FROM fx_requests GROUP BY 1) SELECT window_start, total, " + ", ".join(_quantile_sql(q) for q in (0.5, 0.95, 0.99)) + " FROM b",
)(lambda x: kpi.latency_quantiles(
    x.view("fx_requests"), "ts", "latency_ms", [0.5, 0.95, 0.99], [0.002, 0.005, 0.01, 0.02], 30
))
def _bucket_quantile_sql(q: float) -> str:
    bounds = [0.1, 0.5, 1.0]
    cases = "".join(
        f" WHEN le_{i} >= total * {q} THEN {low} + coalesce((total * {q} - {below}) / nullif(le_{i} - {below}, 0), 0) * ({high} - {low})"
        for i, (low, high, below) in enumerate(zip([0.0, *bounds], bounds, ["0", "le_0", "le_1"]))
    )
    return f"(CASE{cases} ELSE {bounds[-1]} END) * 1000.0 AS p{round(q * 100)}_ms"


query(
    "handler_latency_quantiles", ["fx_latency_counters"],
    """, stepped AS (SELECT *, lag(value) OVER (PARTITION BY handler, instance, le ORDER BY ts, value) AS prev FROM fx_latency_counters
      WHERE regexp_full_match(handler, '/api/.*')),
    grown AS (SELECT date_trunc('minute', ts) AS minute, handler, le, CASE WHEN value < prev THEN value ELSE value - prev END AS step
      FROM stepped WHERE prev IS NOT NULL),
    ranges AS (SELECT minute + to_minutes(cast(s AS bigint)) AS window_end, handler, coalesce(sum(step) FILTER (le = '0.1'), 0) AS le_0,
        coalesce(sum(step) FILTER (le = '0.5'), 0) AS le_1, coalesce(sum(step) FILTER (le = '1.0'), 0) AS le_2,
        coalesce(sum(step) FILTER (le = '+Inf'), 0) AS total
      FROM grown, range(1, 6) r(s) GROUP BY ALL)
    SELECT window_end, handler, total, """ + ", ".join(_bucket_quantile_sql(q) for q in (0.5, 0.95, 0.99)) + " FROM ranges WHERE total > 0",
)(lambda x: kpi.sliding_latency_quantiles(x.view("fx_latency_counters"), [0.5, 0.95, 0.99], series=["instance"]))
query(
    "counter_rates", ["fx_counters"],
    """, stepped AS (SELECT *, lag(value) OVER (PARTITION BY name, series ORDER BY ts, value) AS prev FROM fx_counters)
    SELECT date_trunc('minute', ts) AS minute, name, sum(CASE WHEN value < prev THEN value ELSE value - prev END) / 60.0 AS rate
    FROM stepped WHERE prev IS NOT NULL GROUP BY ALL""",
)(lambda x: kpi.counter_rates(x.view("fx_counters"), "name", "series", "ts", "value"))
