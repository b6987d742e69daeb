"""Clinical tables derived from the TPC-H-like test tables.

One SQL text per view, valid in Spark SQL and in DuckDB. ``view`` runs it over the parquet files,
``with_views`` prepends the same texts as CTEs of an oracle query.

Every text is row-local apart from joins on keys, so the views scale with their base tables.
A line has no unique number in ``lineitem``: its id is the zero-padded text of the columns that
are unique together, which sorts in line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2020-01-01"

_LINE_ID = (
    "lpad(cast(l_orderkey AS string), 20, '0') || '-' || lpad(cast(l_linenumber AS string), 10, '0')"
    " || '-' || lpad(cast(l_partkey AS string), 20, '0') || '-' || lpad(cast(l_suppkey AS string), 20, '0')"
    " || '-' || replace(cast(cast(l_shipdate AS date) AS string), '-', '')"
)

# one drug in four holds one of these, which the shipped allergy families and renal rules speak of
MOLECULES = [
    "Aciclovir", "Amikacine", "Amiodarone", "Amoxicilline", "Apixaban", "Azithromycine", "Ceftriaxone", "Ciprofloxacine", "Clarithromycine",
    "Cloxacilline", "Colchicine", "Céfixime", "Dabigatran", "Diclofénac", "Gentamicine", "Glibenclamide", "Glyburide", "Ibuprofène",
    "Kétorolac", "Lactulose", "Lithium", "Metformine", "Naproxène", "Povidone iodée", "Rivaroxaban", "Sitagliptine", "Spironolactone",
    "Sulfaméthoxazole", "Triamtérène", "Valaciclovir", "Vancomycine",
]
_MOLECULE = (
    f"CASE WHEN p_partkey % 4 = 1 THEN split_part('{'|'.join(MOLECULES)}', '|', cast(floor(p_partkey / 4) % {len(MOLECULES)} AS int) + 1)"
    " ELSE split_part(p_name, ' ', 1) END"
)

# words of the thesaurus pages: (condition, text, x0, top offset, font, size, seq)
_LEVEL_FIRST = (
    "CASE p_size % 7 WHEN 0 THEN 'Association' WHEN 1 THEN 'Contre-indication' WHEN 2 THEN 'Précaution'"
    " WHEN 3 THEN 'A' WHEN 4 THEN 'ASDEC' WHEN 5 THEN 'CI' ELSE 'texte' END"
)
_LEVEL_REST = (
    "CASE p_size % 7 WHEN 0 THEN 'déconseillée' WHEN 2 THEN 'd''emploi' WHEN 3 THEN 'prendre en compte'"
    " ELSE 'niveau' END"
)
_WORD_KINDS = [
    ("p_partkey % 3 = 0", "upper(split_part(p_name, ' ', 1))", 50.0, 10.0, "CIDFont+F1", 10.0, 1),
    ("p_partkey % 9 = 0", "'(sels)'", 70.0, 10.3, "CIDFont+F1", 10.0, 2),
    ("p_partkey % 11 <> 4", "'+'", 50.0, 20.0, "CIDFont+F3", 9.0, 3),
    ("true", "upper(split_part(p_name, ' ', 2))", 60.0, 20.4, "CIDFont+F3", 9.0, 4),
    ("true", "'Mécanisme'", 55.0, 30.0, "CIDFont+F2", 8.0, 5),
    ("true", "p_type", 90.0, 29.6, "CIDFont+F2", 8.0, 6),
    ("true", _LEVEL_FIRST, 320.0, 30.0, "CIDFont+F1", 8.0, 7),
    ("true", _LEVEL_REST, 380.0, 30.0, "CIDFont+F1", 8.0, 8),
    ("p_size % 2 = 0", "lower(p_type)", 55.0, 40.0, "CIDFont+F2", 8.0, 9),
    ("true", "p_brand", 330.0, 40.2, "CIDFont+F2", 8.0, 10),
    ("p_size % 9 = 0", "'PE'", 320.0, 50.0, "CIDFont+F1", 8.0, 11),
    ("p_size % 9 = 0", "'Surveiller'", 330.0, 60.0, "CIDFont+F2", 8.0, 12),
]
_WORDS = " UNION ALL ".join(
    f"SELECT cast(floor(p_partkey / 40) AS bigint) AS doc_id,"
    f" cast(floor((p_partkey % 40) / 8) AS int) + 1 AS page, {seq} AS seq, {text} AS text,"
    f" cast({x0} AS double) AS x0, cast((p_partkey % 8) * 80 AS double) + cast({top} AS double) AS top,"
    f" '{font}' AS fontname, cast({size} AS double) AS size FROM {{part}} WHERE {cond}"
    for cond, text, x0, top, font, size, seq in _WORD_KINDS
)

# name -> (base tables, SQL text)
VIEWS: dict[str, str] = {
    "fx_drugs": """
        SELECT p_partkey AS id, upper(p_name) || ' ' || p_brand AS brand_name,
          cast(NULL AS string) AS presentation, cast(p_size AS string) || ' mg' AS dosage_raw,
          replace(p_name, ' ', ' | ') AS dci, 'labo ' || p_brand AS labo_name, p_type AS therapeutic_class,
          p_type AS atc_code, CASE WHEN p_partkey % 20 = 3 THEN 0.0 ELSE p_retailprice END AS price_ppv,
          CASE WHEN p_partkey % 20 = 7 THEN 0.0 WHEN p_partkey % 3 = 0 THEN cast(p_size AS double) + 0.5 END AS price_hospital,
          CASE WHEN p_size % 2 = 0 THEN 'Médicament' ELSE 'Dispositif' END AS product_type,
          CASE WHEN p_size % 5 = 0 THEN cast(p_size AS string) || ' ans'
               WHEN p_size % 5 = 1 THEN cast(p_size * 6 AS string) || ' mois' END AS min_age,
          p_brand IN ('Brand#13', 'Brand#4') AS is_psychoactive,
          CASE p_size % 7 WHEN 0 THEN 'Grossesse et allaitement' WHEN 1 THEN 'Femme enceinte'
               WHEN 2 THEN 'Allergie connue au ' || split_part(p_name, ' ', 2)
               WHEN 3 THEN 'Allaitement' END AS contraindications,
          'traitement ' || lower(p_type) AS indications
        FROM {part}""",
    "fx_searches": """
        SELECT CASE p_partkey % 10 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN substr(p_name, 2, 5)
            WHEN 2 THEN upper(substr(p_name, 1, 2)) WHEN 3 THEN ' ' || substr(p_name, 1, 2) || '%' || substr(p_name, 6, 3) || ' '
            WHEN 4 THEN p_name || ' ' || p_brand WHEN 5 THEN substr(p_name, 2, 1) || '_' || substr(p_name, 4, 1)
            WHEN 6 THEN substr(p_name, 3, 1) WHEN 7 THEN '%%' WHEN 8 THEN lower(p_brand) || '%' ELSE 'zz' || substr(p_name, 1, 3) END AS q
        FROM {part}""",
    "fx_components": f"""
        SELECT p_partkey AS drug_id, {_MOLECULE} AS dci, 1 AS position
        FROM {{part}} WHERE p_partkey % 50 <> 7
        UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2), 2 FROM {{part}} WHERE p_partkey % 50 <> 7""",
    "fx_patients": """
        SELECT c_custkey AS id,
          '00000000-0000-4000-8000-' || lpad(cast(c_custkey AS string), 12, '0') AS fhir_patient_id,
          date '1940-01-01' + cast((c_custkey * 7919) % 29000 AS int) AS birthdate,
          CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
          CASE WHEN c_acctbal >= 0 THEN cast(c_acctbal % 120 AS decimal(6,2)) END AS creatinine_clearance,
          c_custkey % 11 = 0 AS is_pregnant,
          CASE WHEN c_custkey % 11 = 0 THEN cast(c_custkey % 42 AS smallint) END AS gestational_weeks,
          c_custkey % 13 = 0 AS is_breastfeeding,
          CASE c_custkey % 12 WHEN 0 THEN 'Red' WHEN 1 THEN 'anvil, Gears' WHEN 2 THEN 'Pénicilline' WHEN 3 THEN 'economy'
               WHEN 4 THEN 'Sulfamides, Iode' WHEN 5 THEN 'aspirine' WHEN 6 THEN 'quinolones' WHEN 7 THEN 'macrolide'
               WHEN 8 THEN 'AMOXICILLINE' WHEN 9 THEN 'céphalosporine, latex' END AS known_allergies_csv
        FROM {customer}""",
    "fx_prescriptions": """
        SELECT o_orderkey AS id, o_custkey AS patient_id, o_orderkey % 100 AS doctor_id,
          o_orderdate AS created_at
        FROM {orders}""",
    "fx_lines": f"""
        SELECT {_LINE_ID} AS id, l_orderkey AS prescription_id, l_partkey AS drug_id,
          split_part(p_name, ' ', 1) AS dci, l_quantity AS dose_mg, 'mg' AS dose_unit_raw,
          cast(l_quantity AS int) AS duration_days
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "fx_interactions_raw": """
        SELECT p_partkey AS ord, upper(split_part(p_name, ' ', 1)) AS dci_a,
          upper(split_part(p_name, ' ', 2)) AS dci_b,
          CASE p_size % 3 WHEN 0 THEN 'Contre-indication' WHEN 1 THEN 'Précaution d''emploi'
               ELSE 'À prendre en compte' END AS level_fr,
          CASE p_size % 3 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MODERATE' ELSE 'MINOR' END AS severity,
          p_type AS mechanism, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS recommendation
        FROM {part}""",
    "fx_words": _WORDS,
    "fx_audit": """
        SELECT event_id AS id, event_id AS alert_id, ts AS created_at, user_id AS doctor_id,
          event_id % 1200 AS prescription_id,
          CASE event_type WHEN 'click' THEN 'ACCEPTED' WHEN 'signup' THEN 'ACCEPTED'
               WHEN 'view' THEN 'IGNORED' ELSE 'OVERRIDE' END AS decision,
          CASE event_id % 7 WHEN 0 THEN 'INTERACTION' WHEN 1 THEN 'ALLERGY' WHEN 2 THEN 'REDUNDANT_DCI'
               WHEN 3 THEN 'RENAL' WHEN 4 THEN 'CONTRA_INDICATION' WHEN 5 THEN 'POSOLOGY' END AS alert_type,
          CASE event_id % 3 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MODERATE' ELSE 'MINOR' END AS alert_severity,
          CASE WHEN event_id % 5 <> 0 THEN 'Alerte "' || event_type || '", cas ' || cast(event_id AS string) END
            AS alert_title,
          CASE WHEN event_type = 'error' THEN 'ok'
               WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN 'benefice superieur au risque' END
            AS justification,
          CASE WHEN event_type = 'error' THEN 'noise' END AS justification_valid,
          value AS latency_ms
        FROM {events}""",
    "fx_decisions": """
        SELECT event_id AS alert_id, event_id % 1200 AS prescription_id,
          CASE event_type WHEN 'click' THEN 'ACCEPTED' WHEN 'signup' THEN 'ACCEPTED'
               WHEN 'view' THEN 'IGNORED' ELSE 'OVERRIDE' END AS decision,
          CASE WHEN event_type = 'error' THEN 'ok'
               WHEN event_type = 'purchase' THEN '  benefice superieur au risque ' || props END AS justification,
          user_id AS doctor_id, ts AS created_at
        FROM {events}""",
    # alert ids not divisible by 10, so that one decision in ten names an unknown alert
    "fx_alerts": """
        SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'INTERACTION' WHEN 1 THEN 'ALLERGY'
               WHEN 2 THEN 'REDUNDANT_DCI' WHEN 3 THEN 'RENAL' WHEN 4 THEN 'CONTRA_INDICATION'
               ELSE 'POSOLOGY' END AS alert_type,
          CASE event_id % 3 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'MODERATE' ELSE 'MINOR' END AS severity,
          'Alerte ' || event_type AS title, event_id % 1200 AS prescription_id,
          value / 25.0 AS ai_ignore_proba
        FROM {events} WHERE event_id % 10 <> 0""",
    "fx_raw": """
        SELECT p_partkey AS src,
          CASE WHEN p_partkey % 41 = 0 THEN '  ' ELSE '  ' || p_name || '   ' || p_brand || '\t' END AS brand_name_raw,
          'boite de ' || cast(p_size AS string) AS presentation_raw,
          cast(p_size AS string) || ' mg' AS dosage_raw_raw, 'Labo ' || p_brand AS labo_raw,
          CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_name
               WHEN p_partkey % 5 = 1 THEN replace(p_name, ' ', '  |  ') || ' | x | '
               WHEN p_partkey % 5 = 2 THEN 'acide e' || '́' || 'lev' || ' | ' || p_name
               ELSE replace(p_name, ' ', '|') END AS composition_raw,
          p_type AS class_raw,
          CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Retiré ' ELSE '  ' END AS status_raw,
          CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE ' ' || lower(p_type) || ' ' END AS atc_raw,
          CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '1 234.50 dhs' WHEN 2 THEN 'gratuit'
               WHEN 3 THEN cast(p_size AS string) || ',75 dhs' WHEN 4 THEN '1 ' || cast(p_size AS string) || '00.25 dhs'
               ELSE cast(p_size AS string) || ' dhs' END AS ppv_raw,
          CASE WHEN p_partkey % 3 = 0 THEN cast(p_size AS string) || '.5' END AS hospital_raw,
          CASE p_partkey % 7 WHEN 0 THEN ' Aucun' WHEN 1 THEN 'aucune ' WHEN 2 THEN '' WHEN 3 THEN 'a'
               WHEN 4 THEN NULL WHEN 5 THEN ' C ' ELSE 'B' END AS toxicity_raw,
          CASE WHEN p_size % 2 = 0 THEN 'Médicament' ELSE 'Dispositif' END AS nature_raw,
          'traitement  ' || lower(p_type) AS indications_raw,
          CASE p_partkey % 5 WHEN 0 THEN ' Oui' WHEN 1 THEN 'non' WHEN 2 THEN 'TRUE' WHEN 3 THEN '1' END AS psycho_raw,
          CASE WHEN p_size % 7 < 4 THEN 'Grossesse\t' || p_name END AS contra_raw,
          CASE p_partkey % 9 WHEN 0 THEN 'Six ans.' WHEN 1 THEN '30 mois' WHEN 2 THEN '06 ans' WHEN 3 THEN 'dès trois mois'
               WHEN 4 THEN ' adulte. ' WHEN 5 THEN '...' WHEN 6 THEN NULL WHEN 7 THEN 'une semaine, puis deux an'
               ELSE cast(p_size AS string) || 'ans' END AS age_raw,
          CASE p_partkey % 4 WHEN 0 THEN 'Cliquez ici' WHEN 1 THEN '' WHEN 2 THEN ' http://x/' || p_brand ELSE NULL END AS link_raw
        FROM {part}""",
    "fx_requests": """
        SELECT ts, value AS latency_ms, event_id,
          CASE event_type WHEN 'click' THEN '/api/prescriptions/' WHEN 'view' THEN '/api/audit/bulk'
               WHEN 'purchase' THEN '/api/patients/{{patient_id}}' ELSE '/api/auth/login' END AS endpoint,
          CASE WHEN event_type = 'error' THEN 500 + cast(event_id % 4 AS int)
               WHEN event_id % 9 = 0 THEN 404 ELSE 200 END AS status
        FROM {events}""",
    # cumulative counters per handler, instance and upper bound, read once a minute; they restart every day
    "fx_latency_counters": """
        SELECT minute AS ts, handler, instance, le, sum(n) OVER (
            PARTITION BY handler, instance, le, cast(minute AS date) ORDER BY minute) AS value
        FROM (
          SELECT date_trunc('minute', ts) AS minute, cast(user_id % 2 AS string) AS instance,
            CASE event_type WHEN 'click' THEN '/api/prescriptions/' WHEN 'view' THEN '/api/audit/bulk'
              WHEN 'purchase' THEN '/api/patients' WHEN 'signup' THEN '/metrics' ELSE '/api/auth/login' END AS handler,
            b.le, cast(sum(CASE WHEN b.le = '+Inf' OR value / 200.0 <= b.bound THEN 1 ELSE 0 END) AS double) AS n
          FROM {events}
          JOIN (SELECT '0.1' AS le, 0.1 AS bound UNION ALL SELECT '0.5', 0.5 UNION ALL SELECT '1.0', 1.0
            UNION ALL SELECT '+Inf', 1e9) b ON true
          GROUP BY 1, 2, 3, 4) counted""",
    # a counter that grows with the event number and restarts every 500 events
    "fx_counters": """
        SELECT ts, 'container-' || cast(event_id % 4 AS string) AS name, cast(event_id % 8 AS string) AS series,
          cast(event_id % 500 AS double) AS value
        FROM {events}""",
    "fx_users": """
        SELECT s_suppkey AS id,
          CASE s_suppkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'doctor' WHEN 2 THEN 'pharmacist' ELSE 'doctor' END AS role,
          s_acctbal > 0 AS is_active
        FROM {supplier}""",
    "fx_listing": """
        SELECT s_suppkey AS letter,
          CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '/listing/page/2/|/listing/page/' || cast(s_suppkey % 9 + 1 AS string) || '/'
               WHEN 2 THEN '/listing/page/3/|/listing/suite' ELSE '/page/7/sub/' || cast(s_suppkey % 5 + 2 AS string) || '/x' END AS hrefs
        FROM {supplier}""",
    "fx_completions": """
        SELECT event_id AS alert_id,
          CASE event_id % 4 WHEN 0 THEN ' Ok. ' WHEN 1 THEN '  Surveillance de la kaliémie conseillée, cas ' || props || ' '
               WHEN 2 THEN repeat('long ', 170) ELSE NULL END AS answer,
          CASE event_id % 13
               WHEN 0 THEN '{{"valid": true, "feedback": "justifie"}}'
               WHEN 5 THEN '{{"valid": "false", "feedback": null}}'
               WHEN 6 THEN '{{"valid": 0, "feedback": 12}}'
               WHEN 7 THEN '{{"valid": [], "feedback": ["a", 1, true]}}'
               WHEN 8 THEN '{{"valid": false, "feedback": "x", "valid": true, "feedback": "y"}}'
               WHEN 9 THEN '{{"valid": "", "feedback": false}}'
               WHEN 10 THEN '{{"valid": 2.5, "feedback": 1.5}}'
               WHEN 11 THEN '{{"valid": true}} puis {{"feedback": "deux"}}'
               WHEN 1 THEN 'Voici : {{"valid": false, "feedback": "' || repeat('vague ', 50) || '"}} fin'
               WHEN 2 THEN 'bla bla'
               WHEN 3 THEN '{{"feedback": "sans verdict"}}'
               WHEN 4 THEN '{{ pas du json }}'
               ELSE NULL END AS verdict
        FROM {events}""",
}

_BASES = ["part", "customer", "orders", "lineitem", "events", "supplier"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    bases = {b: table(spark, sf_dir, b) for b in _BASES if "{" + b + "}" in text}
    return spark.sql(text, **bases)


def view_sql(name: str) -> str:
    return VIEWS[name].format(**{b: b for b in _BASES})


def with_views(names: list[str], body: str) -> str:
    """``body`` with the named views, and CTEs of its own, in front of it."""
    ctes = ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
    return f"WITH {ctes}{body}" if body.lstrip().startswith(",") else f"WITH {ctes} {body}"
