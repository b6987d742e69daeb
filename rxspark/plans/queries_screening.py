"""Screening queries, rule by rule and together, with the shipped rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxspark.functions import text
from rxspark.operators import screening
from rxspark.plans.queries_catalogue import TH_CTE, closed_thesaurus
from rxspark.plans.registry import Inputs, query
from rxspark.rules import ALLERGY_FAMILIES, RENAL_RULES
from rxspark.sources.clinical_views import AS_OF


def profiles(x: Inputs):
    return screening.drug_profiles(x.view("fx_drugs"), x.view("fx_components"))


def patients(x: Inputs):
    return x.view("fx_patients").withColumn("known_allergies", text.split_list(F.col("known_allergies_csv")))


def drug_context(x: Inputs):
    return screening.with_drugs(x.view("fx_lines"), profiles(x))


def full_context(x: Inputs):
    treated = screening.with_patients(
        x.view("fx_lines"), x.view("fx_prescriptions"), screening.patient_profiles(patients(x), AS_OF)
    )
    return screening.with_drugs(treated, profiles(x))


def line_rule(*rules: str):
    return lambda x: screening.line_alerts(full_context(x), list(rules))


def all_alerts(x: Inputs):
    return screening.screen(
        x.view("fx_prescriptions"), x.view("fx_lines"), patients(x), profiles(x), closed_thesaurus(x), AS_OF
    )


def treated_facts(x: Inputs, *more: str):
    """Lines with their drug and patient and what the line rules find, in buckets of prescriptions."""
    return screening.treated_facts(x.view("fx_prescriptions"), x.view("fx_lines"), patients(x), profiles(x), AS_OF, more=more)


def line_facts(x: Inputs, *columns: str):
    """Lines with their drug, as the rules across lines read them: all that these need, or the named ``columns`` alone."""
    placed = screening.with_drugs(x.view("fx_lines"), profiles(x), "prescription_id")
    facts = screening.line_facts(placed)
    return screening.co_located(facts.select(*columns) if columns else facts, placed=True)


# --- SQL ------------------------------------------------------------------------------------------

def _values(rows: list[tuple]) -> str:
    text_of = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(text_of, row)) + ")" for row in rows)


_FAMILY_ROWS = _values([(a, i, k) for a, keywords in ALLERGY_FAMILIES.items() for i, k in enumerate(keywords)])
RENAL_ROWS = _values([(i, *rule) for i, rule in enumerate(RENAL_RULES)])
VIEWS = ["fx_drugs", "fx_components", "fx_patients", "fx_prescriptions", "fx_lines"]
CONTEXT = f""", comp AS (SELECT drug_id, lower(trim(dci)) AS key, position FROM fx_components),
  line_keys AS (SELECT l.id AS line_id, l.prescription_id, c.key, c.position FROM fx_lines l JOIN comp c USING (drug_id)
    UNION ALL SELECT id, prescription_id, lower(trim(dci)), 1 FROM fx_lines l
    WHERE NOT EXISTS (SELECT 1 FROM comp c WHERE c.drug_id = l.drug_id)),
  ctx AS (SELECT l.id AS line_id, l.prescription_id, l.drug_id, l.dci, l.dose_mg, l.dose_unit_raw, d.brand_name AS name,
      d.min_age, d.is_psychoactive, d.contraindications, p.patient_id,
      coalesce((SELECT min(key) FROM comp c WHERE c.drug_id = l.drug_id AND position = 1), lower(trim(l.dci))) AS main_key,
      lower(concat_ws(' ', d.contraindications, d.dci, d.indications, d.brand_name)) AS search_text,
      t.is_pregnant, t.gestational_weeks, t.is_breastfeeding, t.creatinine_clearance AS crcl, t.known_allergies_csv,
      cast(date_diff('year', t.birthdate, DATE '{AS_OF}')
        - CASE WHEN strftime(t.birthdate, '%m%d') > '0101' THEN 1 ELSE 0 END AS int) AS age
    FROM fx_lines l JOIN fx_prescriptions p ON p.id = l.prescription_id JOIN fx_patients t ON t.id = p.patient_id
    LEFT JOIN fx_drugs d ON d.id = l.drug_id)"""
ALLERGENS = """, known AS (SELECT id AS patient_id, ix, trim(list[ix]) AS spelled FROM (SELECT id, list, unnest(range(1, len(list) + 1)) AS ix
      FROM (SELECT id, string_split(known_allergies_csv, ',') AS list FROM fx_patients))),
  allergens AS (SELECT DISTINCT patient_id, unnest([lower(spelled), CASE WHEN lower(spelled) LIKE '%s'
      THEN left(lower(spelled), length(spelled) - 1) ELSE lower(spelled) || 's' END]) AS allergen FROM known)"""
_ALLERGY = CONTEXT + ALLERGENS + f""",
  exact AS (SELECT line_id, string_agg(DISTINCT allergen, ', ' ORDER BY allergen) AS hit FROM ctx JOIN allergens USING (patient_id)
    JOIN line_keys k USING (line_id) WHERE k.key = allergen GROUP BY line_id),
  named AS (SELECT line_id, min(allergen) AS allergen FROM ctx JOIN allergens USING (patient_id)
    WHERE regexp_matches(search_text, '\\b' || allergen || '\\b') GROUP BY line_id),
  families AS (SELECT * FROM ({_FAMILY_ROWS}) f(allergen, ord, keyword)),
  crossed AS (SELECT line_id, allergen, molecule FROM (SELECT line_id, f.allergen, k.key AS molecule,
      row_number() OVER (PARTITION BY line_id ORDER BY f.allergen, f.ord, k.position) AS rn
      FROM ctx JOIN allergens USING (patient_id) JOIN families f USING (allergen) JOIN line_keys k USING (line_id)
      WHERE contains(k.key, f.keyword)) WHERE rn = 1),
  alert AS (SELECT prescription_id, ctx.line_id, 'allergy_exact' AS rule, 'ALLERGY' AS alert_type, 'MAJOR' AS severity,
      'Allergie connue — ' || dci AS title, 'Le patient a une allergie documentée à : ' || hit
      || '. Médicament prescrit : ' || name || '.' AS detail FROM ctx JOIN exact USING (line_id)
    UNION ALL SELECT prescription_id, ctx.line_id, 'allergy_text', 'ALLERGY', 'MAJOR', 'Allergie potentielle — ' || name,
      'Le médicament ' || name || ' peut contenir ou être associé à ''' || allergen || ''' (excipient ou contre-indication). '
      || 'Allergie documentée : ' || allergen || '. Vérifier la composition complète avant de dispenser.'
      FROM ctx JOIN named USING (line_id) WHERE line_id NOT IN (SELECT line_id FROM exact)
    UNION ALL SELECT prescription_id, ctx.line_id, 'allergy_family', 'ALLERGY', 'MAJOR', 'Allergie croisée — ' || name,
      'Le patient est allergique aux ' || (SELECT first(spelled ORDER BY ix) FROM known k WHERE k.patient_id = ctx.patient_id
        AND (lower(spelled) = allergen OR rtrim(lower(spelled), 's') = allergen OR lower(spelled) || 's' = allergen))
      || '. Le médicament prescrit (' || name || ') appartient à cette famille ou présente un risque de réaction croisée (DCI : '
      || upper(left(molecule, 1)) || substr(molecule, 2) || '). Vérifier avant administration.'
      FROM ctx JOIN crossed USING (line_id) WHERE line_id NOT IN (SELECT line_id FROM exact UNION ALL SELECT line_id FROM named))"""


def _rule(rule: str, kind: str, severity: str, title: str, detail: str, where: str) -> str:
    return (
        f"SELECT prescription_id, line_id, '{rule}' AS rule, '{kind}' AS alert_type, '{severity}' AS severity,"
        f" '{title} — ' || name AS title, {detail} AS detail FROM ctx WHERE {where}"
    )


_MIN_YEARS = (
    "CASE WHEN min_age LIKE '%mois' THEN cast(regexp_extract(min_age, '\\d+') AS int) // 12"
    " WHEN min_age LIKE '%ans' THEN cast(regexp_extract(min_age, '\\d+') AS int) END"
)
_AGE = _rule(
    "age", "POSOLOGY", "MAJOR", "Âge insuffisant",
    "'Ce médicament est autorisé à partir de ' || min_age || '. Âge du patient : ' || age || ' an(s).'", f"age < {_MIN_YEARS}",
)
_PREGNANCY = _rule(
    "pregnancy", "CONTRA_INDICATION", "MAJOR", "Contre-indication grossesse",
    "'La fiche du médicament mentionne une contre-indication liée à la grossesse.' || CASE WHEN gestational_weeks <> 0"
    " THEN ' Semaine gestationelle : ' || gestational_weeks || '.' ELSE '' END",
    "is_pregnant AND (contraindications ILIKE '%grossesse%' OR contraindications ILIKE '%enceinte%')",
)
_BREASTFEEDING = _rule(
    "breastfeeding", "CONTRA_INDICATION", "MODERATE", "Contre-indication allaitement",
    "'La fiche du médicament mentionne une contre-indication liée à l''allaitement.'",
    "is_breastfeeding AND contraindications ILIKE '%allaitement%'",
)
_PSYCHOACTIVE = _rule(
    "psychoactive", "POSOLOGY", "MINOR", "Substance psychoactive",
    "'Ce médicament contient une ou plusieurs substances psychoactives. Vérifier l''absence de co-prescription"
    " sédative et informer le patient.'", "is_psychoactive",
)
_RENAL = f"""SELECT prescription_id, line_id, 'renal' AS rule, 'RENAL' AS alert_type, severity,
    'Insuffisance rénale — ' || name AS title, 'Ce médicament est ' || message || ' lorsque la clairance rénale est < '
    || threshold || ' mL/min. Clairance du patient : ' || cast(round(crcl, 1) AS decimal(10, 1)) || ' mL/min (IRC '
    || CASE WHEN crcl < 30 THEN 'sévère (stade 4-5)' WHEN crcl < 45 THEN 'modérée (stade 3)' WHEN crcl < 60
      THEN 'légère (stade 2)' ELSE 'débutante' END || '). Adapter la posologie ou substituer.' AS detail
  FROM (SELECT ctx.*, r.*, row_number() OVER (PARTITION BY ctx.line_id ORDER BY k.position, r.ord) AS rn
    FROM ctx JOIN line_keys k USING (line_id) JOIN ({RENAL_ROWS}) r(ord, keyword, threshold, severity, message)
      ON contains(k.key, r.keyword) AND ctx.crcl < r.threshold) WHERE rn = 1"""
_DUPLICATE_CTE = """, labelled AS (SELECT prescription_id, line_id, main_key, name || CASE WHEN dose_mg <> 0
      THEN ' (' || cast(dose_mg AS varchar) || ' ' || dose_unit_raw || ')' ELSE '' END AS label FROM ctx),
  label_first AS (SELECT prescription_id, main_key, label, min(line_id) AS first, count(*) AS n FROM labelled GROUP BY ALL),
  dup AS (SELECT prescription_id, main_key, min(first) AS first, CASE WHEN count(*) = 1 THEN min(label) || ' × ' || sum(n)
      ELSE string_agg(label, ', ' ORDER BY first, label) END AS listed FROM label_first GROUP BY ALL HAVING sum(n) > 1)"""
_DUPLICATE = """SELECT prescription_id, line_id, 'duplicate' AS rule, 'REDUNDANT_DCI' AS alert_type, 'MODERATE' AS severity,
    'Redondance de DCI — ' || upper(left(main_key, 1)) || lower(substr(main_key, 2)) AS title,
    'La molécule ''' || upper(left(main_key, 1)) || lower(substr(main_key, 2))
    || ''' est présente dans plusieurs lignes de la prescription : ' || listed || '. Risque de surdosage cumulatif.' AS detail
  FROM labelled JOIN dup USING (prescription_id, main_key) WHERE line_id > first"""
_INTERACTION_CTE = TH_CTE + """, upper_keys AS (SELECT DISTINCT line_id, prescription_id, strip_accents(upper(key)) AS key FROM line_keys),
  fired AS (SELECT a.prescription_id, a.line_id AS line_a, b.line_id AS line_b, th.*,
      row_number() OVER (PARTITION BY least(a.line_id, b.line_id), greatest(a.line_id, b.line_id),
        least(dci_a, dci_b), greatest(dci_a, dci_b) ORDER BY th.id, a.line_id, b.line_id) AS rn
    FROM th JOIN upper_keys a ON a.key = upper(th.dci_a) JOIN upper_keys b ON b.key = upper(th.dci_b)
      AND b.prescription_id = a.prescription_id AND a.line_id <> b.line_id)"""
_INTERACTION = """SELECT f.prescription_id, line_b AS line_id, 'interaction' AS rule, 'INTERACTION' AS alert_type, severity,
    'Interaction médicamenteuse — ' || a.name || ' / ' || b.name AS title,
    concat_ws(' ', level_fr || ' : ' || dci_a || ' + ' || dci_b || '.', 'Risque : ' || mechanism,
      'Conduite : ' || recommendation) AS detail
  FROM fired f JOIN ctx a ON a.line_id = line_a JOIN ctx b ON b.line_id = line_b WHERE rn = 1"""

query("screen_allergy", VIEWS, _ALLERGY + " SELECT * FROM alert")(line_rule("allergy"))
query("screen_age", VIEWS, CONTEXT + " " + _AGE)(line_rule("age"))
query("screen_pregnancy", VIEWS, CONTEXT + " " + _PREGNANCY)(line_rule("pregnancy"))
query("screen_breastfeeding", VIEWS, CONTEXT + " " + _BREASTFEEDING)(line_rule("breastfeeding"))
query("screen_psychoactive", VIEWS, CONTEXT + " " + _PSYCHOACTIVE)(line_rule("psychoactive"))
query("screen_renal", VIEWS, CONTEXT + " " + _RENAL)(line_rule("renal"))
query("screen_duplicates", VIEWS, CONTEXT + _DUPLICATE_CTE + " " + _DUPLICATE)(
    lambda x: screening.duplicate_alerts(line_facts(x))
)
_WITH_TH = [*VIEWS, "fx_interactions_raw"]
query("screen_interactions", _WITH_TH, CONTEXT + _INTERACTION_CTE + " " + _INTERACTION)(
    lambda x: screening.interaction_alerts(line_facts(x, *screening.INTERACTION_FACTS), closed_thesaurus(x))
)
query(
    "line_context", VIEWS,
    CONTEXT + """ SELECT line_id, name, main_key, (SELECT string_agg(key, '+' ORDER BY position) FROM line_keys k
      WHERE k.line_id = ctx.line_id) AS keys FROM ctx""",
)(lambda x: drug_context(x).select("line_id", "name", "main_key", F.array_join("keys", "+").alias("keys")))
query("allergen_expansion", ["fx_patients"], ALLERGENS + " SELECT patient_id, allergen FROM allergens")(
    lambda x: screening.patient_profiles(patients(x), AS_OF).select("patient_id", F.explode("allergens").alias("allergen"))
)

ALERTS_CTE = (
    _ALLERGY + _DUPLICATE_CTE + _INTERACTION_CTE + ", alerts AS (SELECT * FROM alert"
    + "".join(
        f" UNION ALL {part}"
        for part in (_AGE, _PREGNANCY, _BREASTFEEDING, _PSYCHOACTIVE, _RENAL, _DUPLICATE, _INTERACTION)
    )
    + ")"
)
query("screen_all", _WITH_TH, ALERTS_CTE + " SELECT * FROM alerts")(all_alerts)
query(
    "screening_summary", _WITH_TH,
    ALERTS_CTE + " SELECT alert_type, severity, count(*) AS alerts, count(DISTINCT prescription_id) AS prescriptions"
    " FROM alerts GROUP BY ALL",
)(lambda x: all_alerts(x).groupBy("alert_type", "severity", "prescription_id").agg(F.count(F.lit(1)).alias("n"))
  .groupBy("alert_type", "severity").agg(F.sum("n").alias("alerts"), F.count(F.lit(1)).alias("prescriptions")))
query(
    "prescription_status", _WITH_TH,
    ALERTS_CTE + """ SELECT p.id, coalesce(n, 0) AS alert_count, CASE WHEN n > 0 THEN 'alerts' ELSE 'safe' END AS status
      FROM fx_prescriptions p LEFT JOIN (SELECT prescription_id, count(*) AS n FROM alerts GROUP BY 1) a
      ON a.prescription_id = p.id""",
)(lambda x: screening.prescription_status(x.view("fx_prescriptions"), all_alerts(x)).select("id", "alert_count", "status"))
