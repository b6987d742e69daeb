"""Catalogue, thesaurus and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxspark.functions import clinical, text
from rxspark.operators import catalogue, quality, scoring, thesaurus
from rxspark.plans.registry import Inputs, query, register
from rxspark.rules import CATALOGUE_HEADERS
from rxspark.session import stored, work_path
from rxspark.sources import catalogue_files, merges, web_pages

# --- SQL for the cleaning expressions -----------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def strip_sql(c: str) -> str:
    return f"trim({c}, {WS})"


def clean_sql(c: str) -> str:
    s = f"nfc_normalize(replace(replace({c}, chr(160), ' '), chr(8203), ''))"
    s = f"regexp_replace({s}, '[\\r\\t\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')"
    return f"nullif({strip_sql(f'''regexp_replace({s}, ' +', ' ', 'g')''')}, '')"


def price_sql(c: str) -> str:
    number = f"nullif(regexp_extract(replace({c}, chr(160), ''), '(\\d+([.,]\\d+)?)', 1), '')"
    return f"cast(replace({number}, ',', '.') AS float)"


def toxicity_sql(c: str) -> str:
    return f"CASE WHEN upper({strip_sql(c)}) NOT IN ('AUCUN', 'AUCUNE', '') THEN upper({strip_sql(c)}) END"


def age_text_sql(c: str) -> str:
    base = f"rtrim({strip_sql(c)}, '.')"
    low = f"lower({base})"
    for word, n in (("une", 1), ("un", 1), ("deux", 2), ("trois", 3), ("six", 6)):
        low = f"regexp_replace({low}, '\\b{word}\\b', '{n}', 'g')"
    num = f"regexp_extract({low}, '(\\d+)\\s*(ans?|mois)', 1)"
    unit = f"regexp_extract({low}, '(\\d+)\\s*(ans?|mois)', 2)"
    return (
        f"CASE WHEN {num} <> '' THEN cast(cast({num} AS int) AS varchar) || CASE WHEN {unit} = 'mois' THEN ' mois' "
        f"ELSE ' ans' END ELSE nullif({strip_sql(base)}, '') END"
    )


def flag_sql(c: str) -> str:
    return f"coalesce(lower({strip_sql(c)}) IN ('oui', 'yes', 'true', '1'), false)"


def status_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Commercialisé' ELSE {strip_sql(c)} END"


def link_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN ('cliquez ici', 'click here', '') THEN {clean_sql(c)} END"


CLEAN_SQL = {
    "brand_name": clean_sql("brand_name_raw"), "presentation": clean_sql("presentation_raw"),
    "dosage_raw": clean_sql("dosage_raw_raw"), "dci": clean_sql("composition_raw"),
    "labo_name": clean_sql("labo_raw"), "therapeutic_class": clean_sql("class_raw"),
    "status": status_sql("status_raw"), "atc_code": "upper(trim(atc_raw))", "price_ppv": price_sql("ppv_raw"),
    "price_hospital": price_sql("hospital_raw"), "toxicity_class": toxicity_sql("toxicity_raw"),
    "product_type": clean_sql("nature_raw"), "indications": clean_sql("indications_raw"),
    "is_psychoactive": flag_sql("psycho_raw"), "contraindications": clean_sql("contra_raw"),
    "min_age": age_text_sql("age_raw"), "source_url": link_sql("link_raw"),
}
CLEAN_CTE = (
    ", clean AS (SELECT * FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in CLEAN_SQL.items())
    + " FROM fx_raw) WHERE brand_name IS NOT NULL)"
)


def cleaned(x: Inputs):
    return catalogue.clean_catalogue(x.view("fx_raw"))


# --- single expressions (fx_raw column -> value) ------------------------------------------------

for _name, _column, _expr, _sql in [
    ("price_parse", "ppv_raw", text.parse_price, price_sql),
    ("toxicity_clean", "toxicity_raw", text.clean_toxicity, toxicity_sql),
    ("min_age_normalize", "age_raw", text.normalize_min_age, age_text_sql),
    ("text_clean", "composition_raw", text.clean_text, clean_sql),
    ("psychoactive_flag", "psycho_raw", text.parse_flag, flag_sql),
    ("status_clean", "status_raw", text.clean_status, status_sql),
    ("atc_clean", "atc_raw", text.clean_atc, lambda c: f"upper(trim({c}))"),
    ("link_clean", "link_raw", text.clean_link, link_sql),
    ("molecule_match_key", "composition_raw", text.molecule_key, lambda c: f"lower({strip_sql(c)})"),
    (
        "thesaurus_match_key", "composition_raw", text.thesaurus_key,
        lambda c: f"replace(strip_accents(upper({strip_sql(c)})), '́', '')",
    ),
    (
        "space_collapse", "brand_name_raw", text.collapse_spaces,
        lambda c: strip_sql(f"regexp_replace({c}, '[\\s\\x{{00a0}}]+', ' ', 'g')"),
    ),
]:
    register(
        _name,
        lambda x, c=_column, e=_expr: x.view("fx_raw").select("src", e(F.col(c)).alias("value")),
        ["fx_raw"], f"SELECT src, {_sql(_column)} AS value FROM fx_raw",
    )

query(
    "age_in_years", ["fx_patients"],
    "SELECT id, birthdate, cast(date_diff('year', birthdate, DATE '2020-02-28') - CASE WHEN strftime(birthdate, '%m%d')"
    " > '0228' THEN 1 ELSE 0 END AS int) AS age FROM fx_patients",
)(lambda x: x.view("fx_patients").select(
    "id", "birthdate", clinical.age_years(F.col("birthdate"), F.lit("2020-02-28").cast("date")).alias("age")
))
query(
    "min_age_in_years", ["fx_drugs"],
    "SELECT id, min_age, CASE WHEN min_age LIKE '%mois' THEN cast(regexp_extract(min_age, '\\d+') AS int) // 12"
    " WHEN min_age LIKE '%ans' THEN cast(regexp_extract(min_age, '\\d+') AS int) END AS min_years FROM fx_drugs",
)(lambda x: x.view("fx_drugs").select("id", "min_age", clinical.min_age_years(F.col("min_age")).alias("min_years")))
query(
    "pregnancy_mention", ["fx_drugs"],
    "SELECT id, coalesce(lower(contraindications) LIKE '%grossesse%' OR lower(contraindications) LIKE '%enceinte%',"
    " false) AS mentioned FROM fx_drugs",
)(lambda x: x.view("fx_drugs").select(
    "id", clinical.mentions_pregnancy(F.col("contraindications")).alias("mentioned")
))
query(
    "breastfeeding_mention", ["fx_drugs"],
    "SELECT id, coalesce(lower(contraindications) LIKE '%allaitement%', false) AS mentioned FROM fx_drugs",
)(lambda x: x.view("fx_drugs").select(
    "id", clinical.mentions_breastfeeding(F.col("contraindications")).alias("mentioned")
))
query(
    "free_text_list", ["fx_patients"],
    "SELECT id, item FROM (SELECT id, trim(unnest(string_split(known_allergies_csv, ','))) AS item FROM fx_patients)"
    " WHERE item <> ''",
)(lambda x: x.view("fx_patients").select("id", F.explode(text.split_list(F.col("known_allergies_csv"))).alias("item")))

# --- catalogue ----------------------------------------------------------------------------------

query(
    "catalogue_clean", ["fx_raw"], CLEAN_CTE + " SELECT * FROM clean",
)(cleaned)
query(
    "catalogue_headers", ["fx_raw"], f"SELECT {', '.join(CATALOGUE_HEADERS.values())} FROM fx_raw",
)(lambda x: catalogue_files.rename_headers(
    x.view("fx_raw").withColumnsRenamed({c: h for h, c in CATALOGUE_HEADERS.items()})
).select(*CATALOGUE_HEADERS.values()))
query(
    "catalogue_ids", ["fx_raw"],
    CLEAN_CTE + " SELECT cast(row_number() OVER (ORDER BY "
    + ", ".join(f"{c} NULLS FIRST" for c in catalogue.DRUG_COLUMNS[1:2] + ["atc_code", "dosage_raw"]
                + [c for c in catalogue.DRUG_COLUMNS if c not in ("id", "brand_name", "atc_code", "dosage_raw")])
    + ") AS bigint) AS id, * FROM clean",
)(lambda x: catalogue.number_drugs(cleaned(x)))
@query(
    "catalogue_stable_ids", ["fx_raw"],
    CLEAN_CTE + """, again AS (SELECT brand_name, count(*) AS n FROM clean WHERE brand_name NOT LIKE '%7' GROUP BY 1)
    SELECT brand_name, count(*) AS drugs, count(*) AS ids, coalesce(any_value(a.n), 0) + 1 AS later, coalesce(any_value(a.n), 0) AS kept
    FROM clean LEFT JOIN again a USING (brand_name) GROUP BY 1""",
)
def _stable_ids(x: Inputs):
    """Drugs and ids per brand in a first load, and in a second one with other prices, without some brands and with one drug more each."""
    clean = stored(cleaned(x), "clean-drugs")
    first, known = catalogue.keep_ids(clean)
    stays = ~F.col("brand_name").like("%7")
    changed = clean.filter(stays).withColumn("price_ppv", F.col("price_ppv") + 1)
    more = clean.dropDuplicates(["brand_name"]).withColumn("presentation", F.lit("new"))
    second, _ = catalogue.keep_ids(changed.unionByName(more), known)
    sides = first.select("brand_name", "id", F.lit(1).alias("load")).unionByName(second.select("brand_name", "id", F.lit(2).alias("load")))
    per_id = sides.groupBy("brand_name", "id").agg(F.count_if(F.col("load") == 1).alias("a"), F.count_if(F.col("load") == 2).alias("b"))
    return per_id.groupBy("brand_name").agg(
        F.sum("a").alias("drugs"), F.count_if(F.col("a") > 0).alias("ids"), F.sum("b").alias("later"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("kept"),
    )


query(
    "molecule_split", ["fx_raw"],
    f""", parts AS (
      SELECT src, pos, trim(regexp_replace(part, '\\s+', ' ', 'g')) AS dci FROM (
        SELECT src, unnest(string_split(dci, '|')) AS part, generate_subscripts(string_split(dci, '|'), 1) AS pos
        FROM (SELECT src, {clean_sql("composition_raw")} AS dci FROM fx_raw)))
    SELECT src AS drug_id, dci, cast(row_number() OVER (PARTITION BY src ORDER BY pos) AS int) AS position
    FROM parts WHERE length(dci) > 1""",
)(lambda x: catalogue.split_molecules(
    x.view("fx_raw").select(F.col("src").alias("id"), text.clean_text(F.col("composition_raw")).alias("dci"))
))

# --- profiling ------------------------------------------------------------------------------------

query(
    "fill_rates", ["fx_raw"],
    CLEAN_CTE + " ".join(
        f" {'UNION ALL' if i else ''} SELECT '{c}' AS column_name, count({c}) AS filled, count(*) AS total,"
        f" round_even(100.0 * count({c}) / count(*), 1) AS fill_pct FROM clean"
        for i, c in enumerate(quality.PROFILED)
    ),
)(lambda x: quality.fill_rates(cleaned(x)))
query(
    "toxicity_distribution", ["fx_raw"],
    CLEAN_CTE + " SELECT toxicity_class, count(*) AS n FROM clean GROUP BY ALL",
)(lambda x: quality.toxicity_distribution(cleaned(x)))
query(
    "product_type_distribution", ["fx_raw"],
    CLEAN_CTE + " SELECT product_type, count(*) AS n FROM clean GROUP BY ALL",
)(lambda x: quality.product_type_distribution(cleaned(x)))
query(
    "multi_molecule_share", ["fx_raw"],
    CLEAN_CTE + " SELECT count(*) FILTER (dci LIKE '%|%') AS multi, count(*) AS total,"
    " round_even(100.0 * count(*) FILTER (dci LIKE '%|%') / count(*), 1) AS multi_pct FROM clean",
)(lambda x: quality.multi_molecule_share(cleaned(x)))

# --- files and keyed loads --------------------------------------------------------------------------


@query(
    "catalogue_csv_round_trip", ["fx_raw"],
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in CATALOGUE_HEADERS.values()) + " FROM fx_raw",
)
def _csv_round_trip(x: Inputs):
    """Raw catalogue written and read back as CSV with its French headers."""
    path = work_path(x.spark, "raw-csv")
    raw = x.view("fx_raw").drop("src").withColumnsRenamed({c: h for h, c in CATALOGUE_HEADERS.items()})
    # an empty field is a missing value
    raw.write.options(**catalogue_files.CSV_OPTIONS, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return catalogue_files.rename_headers(catalogue_files.read_raw_catalogue(x.spark, path)).select(
        *CATALOGUE_HEADERS.values()
    )


@query("clean_parquet_round_trip", ["fx_raw"], CLEAN_CTE + " SELECT * FROM clean")
def _parquet_round_trip(x: Inputs):
    path = work_path(x.spark, "clean-parquet")
    catalogue_files.write_parquet(cleaned(x), path)
    return x.spark.read.parquet(path)


@query(
    "clean_csv_load", ["fx_drugs"],
    "SELECT id, brand_name, presentation, dosage_raw, dci, labo_name, therapeutic_class, NULL AS status, atc_code, price_ppv, price_hospital,"
    " NULL AS toxicity_class, product_type, indications, is_psychoactive, contraindications, min_age, NULL AS source_url"
    " FROM fx_drugs WHERE id % 97 <> 0",
)
def _csv_load(x: Inputs):
    """Clean CSV with footer rows, written, read back and typed."""
    path = work_path(x.spark, "clean-csv")
    drugs = x.view("fx_drugs")
    footer = F.when(F.col("id") % 97 == 0, F.concat(F.lit('Source : "x", '), F.col("id").cast("string")))
    rows = drugs.select(
        *[
            F.coalesce(footer, F.col("id").cast("string")).alias("id") if c == "id"
            else (F.col(c).cast("string") if c in drugs.columns else F.lit(None).cast("string")).alias(c)
            for c in catalogue.DRUG_COLUMNS
        ]
    )
    catalogue_files.write_csv(rows, path)
    back = catalogue_files.coerce_drugs(catalogue_files.read_clean_catalogue(x.spark, path))
    return back.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("price_ppv", "price_hospital")}).select(*catalogue.DRUG_COLUMNS)


def _catalogue_file(x: Inputs) -> tuple[str, object]:
    """A clean CSV with footers, records with too many fields, short records and repeated ids; and the drugs loaded before."""
    path = work_path(x.spark, "clean-lines")
    drugs = x.view("fx_drugs")
    values = [F.col(c).cast("string") if c in drugs.columns else F.lit(None).cast("string") for c in catalogue.DRUG_COLUMNS]
    line = F.to_csv(F.struct(*(v.alias(c) for v, c in zip(values, catalogue.DRUG_COLUMNS))), {"escape": '"'})
    number = F.col("id")
    written = (
        F.when(number % 97 == 0, F.array(F.concat(F.lit('"Source : x, '), number.cast("string"), F.lit('"'))))
        .when(number % 89 == 0, F.array(F.concat(line, F.lit(',more,"a, b"'))))
        .when(number % 83 == 0, F.array(F.concat_ws(",", number.cast("string"), F.lit('"short, one"'))))
        .when(number % 31 == 0, F.array(line, F.concat(number.cast("string"), F.lit(",late"), F.lit("," * 16))))
        .otherwise(F.array(line))
    )
    drugs.select(F.explode(written).alias("value")).write.text(path)
    before = drugs.filter("id % 3 = 0").select(
        "id", F.concat(F.lit("old "), "brand_name").alias("brand_name"), F.col("price_ppv").cast("double").alias("price_ppv"), "is_psychoactive", "contraindications"
    )
    return path, before


_LOADED = """, fate AS (SELECT id, CASE WHEN id % 97 = 0 THEN 'no_id' WHEN id % 89 = 0 THEN 'malformed' WHEN id % 3 = 0 THEN 'present' ELSE 'inserted' END AS fate,
    id % 97 <> 0 AND id % 89 <> 0 AND id % 83 = 0 AS short, id % 97 <> 0 AND id % 89 <> 0 AND id % 83 <> 0 AND id % 31 = 0 AS twice FROM fx_drugs)"""


@query(
    "catalogue_load", ["fx_drugs"],
    _LOADED + """ SELECT d.id, CASE WHEN d.id % 3 = 0 THEN 'old ' || brand_name WHEN short THEN 'short, one' ELSE brand_name END AS brand_name,
      CASE WHEN d.id % 3 = 0 OR NOT short THEN price_ppv END AS price_ppv, CASE WHEN d.id % 3 = 0 OR NOT short THEN is_psychoactive ELSE false END AS is_psychoactive,
      CASE WHEN d.id % 3 = 0 OR NOT short THEN contraindications END AS contraindications
    FROM fx_drugs d JOIN fate USING (id) WHERE d.id % 3 = 0 OR fate = 'inserted'""",
)
def _catalogue_load(x: Inputs):
    """The drugs after a load of that file."""
    path, before = _catalogue_file(x)
    out = work_path(x.spark, "loaded-drugs")
    merges.load_catalogue(path, before, out, header=False)
    return x.spark.read.parquet(out).withColumn("price_ppv", F.round("price_ppv", 2))


query(
    "ingest_gate", ["fx_raw"], "SELECT count(*) AS records, count(*) >= 1 AS ok FROM fx_raw",
)(lambda x: catalogue_files.ingest_gate(x.view("fx_raw")))
query(
    "insert_if_absent", ["fx_drugs"],
    """, old AS (SELECT id, brand_name FROM fx_drugs WHERE id % 3 <> 0),
       new AS (SELECT id, 'new ' || brand_name AS brand_name FROM fx_drugs)
    SELECT id, coalesce(old.brand_name, new.brand_name) AS brand_name FROM new LEFT JOIN old USING (id)""",
)(lambda x: merges.insert_if_absent(
    x.view("fx_drugs").filter("id % 3 <> 0").select("id", "brand_name"),
    x.view("fx_drugs").select(
        "id", F.explode(F.array(F.lit("new "), F.lit("newer "))).alias("p"), "brand_name"
    ).select("id", F.concat("p", "brand_name").alias("brand_name"), F.length("p").alias("ord")), "id", "ord",
))
query(
    "component_load", ["fx_components", "fx_drugs"],
    """, known AS (SELECT id FROM fx_drugs WHERE id % 7 <> 0),
       new AS (SELECT drug_id, 'new ' || dci AS dci, position FROM fx_components WHERE position = 1)
    SELECT c.drug_id, coalesce(n.dci, c.dci) AS dci, c.position FROM fx_components c
    LEFT JOIN (SELECT * FROM new JOIN known ON id = drug_id) n ON n.drug_id = c.drug_id AND n.position = c.position""",
)(lambda x: merges.load_components(
    x.view("fx_components"),
    x.view("fx_components").filter("position = 1").withColumn("dci", F.concat(F.lit("new "), "dci")),
    x.view("fx_drugs").filter("id % 7 <> 0"),
))
query(
    "component_report", ["fx_components", "fx_drugs"],
    "SELECT count(*) AS read, count(*) FILTER (drug_id % 7 <> 0) AS kept, count(*) FILTER (drug_id % 7 = 0) AS skipped"
    " FROM fx_components",
)(lambda x: merges.component_report(x.view("fx_components"), x.view("fx_drugs").filter("id % 7 <> 0")))

# --- thesaurus -------------------------------------------------------------------------------------

BEST_CTE = """, fixed AS (SELECT ord, dci_a, CASE WHEN dci_b = 'OR' THEN 'SEL(S) D''OR' ELSE dci_b END AS dci_b,
      level_fr, severity, mechanism, recommendation FROM fx_interactions_raw),
    best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY dci_a, dci_b ORDER BY
        CASE severity WHEN 'MAJOR' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'MINOR' THEN 1 ELSE 0 END DESC,
        length(mechanism) DESC, ord) AS rn FROM fixed) WHERE rn = 1),
    closed AS (SELECT ord * 2 AS id, dci_a, dci_b, level_fr, severity, mechanism, recommendation FROM best
      UNION ALL SELECT ord * 2 + 1, dci_b, dci_a, level_fr, severity, mechanism, recommendation FROM best b
      WHERE NOT EXISTS (SELECT 1 FROM best c WHERE c.dci_a = b.dci_b AND c.dci_b = b.dci_a))"""
TH_CTE = BEST_CTE + """, th AS (SELECT id, dci_a, dci_b, level_fr, severity, nullif(mechanism, '') AS mechanism,
      nullif(recommendation, '') AS recommendation, 'ANSM_2023' AS source FROM closed)"""


def closed_thesaurus(x: Inputs):
    return thesaurus.build_thesaurus(x.view("fx_interactions_raw"))


query(
    "thesaurus_fix_fragments", ["fx_interactions_raw"],
    "SELECT ord, dci_a, CASE WHEN dci_b = 'OR' THEN 'SEL(S) D''OR' ELSE dci_b END AS dci_b FROM"
    " (SELECT ord, dci_a, CASE WHEN ord % 8 = 0 THEN 'OR' ELSE dci_b END AS dci_b FROM fx_interactions_raw)",
)(lambda x: thesaurus.fix_fragments(
    x.view("fx_interactions_raw").select(
        "ord", "dci_a", F.when(F.col("ord") % 8 == 0, "OR").otherwise(F.col("dci_b")).alias("dci_b")
    )
))
query(
    "thesaurus_best_per_pair", ["fx_interactions_raw"],
    BEST_CTE + " SELECT ord, dci_a, dci_b, severity, mechanism FROM best",
)(lambda x: thesaurus.best_per_pair(x.view("fx_interactions_raw")).select("ord", "dci_a", "dci_b", "severity", "mechanism"))
query(
    "thesaurus_symmetric", ["fx_interactions_raw"],
    BEST_CTE + " SELECT dci_a, dci_b, severity FROM closed",
)(lambda x: thesaurus.symmetric_closure(
    thesaurus.best_per_pair(x.view("fx_interactions_raw"))
).select("dci_a", "dci_b", "severity"))
query(
    "thesaurus_build", ["fx_interactions_raw"], TH_CTE + " SELECT * FROM th",
)(closed_thesaurus)
query(
    "thesaurus_upsert", ["fx_interactions_raw"],
    TH_CTE + """ SELECT dci_a, dci_b, CASE WHEN severity <> 'MINOR' THEN severity ELSE 'OLD' END AS severity,
      CASE WHEN severity <> 'MINOR' THEN mechanism ELSE 'OLD' END AS mechanism FROM th""",
)(lambda x: merges.upsert(
    closed_thesaurus(x).filter("id % 3 = 0 OR severity = 'MINOR'").select(
        "dci_a", "dci_b", F.lit("OLD").alias("severity"), F.lit("OLD").alias("mechanism")
    ),
    closed_thesaurus(x).filter("severity <> 'MINOR'"), ["dci_a", "dci_b"], ["severity", "mechanism"],
))
query(
    "thesaurus_upsert_report", ["fx_interactions_raw"],
    TH_CTE + """ SELECT count(*) FILTER (severity <> 'MINOR' AND id % 3 <> 0) AS added,
      count(*) FILTER (severity <> 'MINOR' AND id % 3 = 0) AS updated,
      count(*) FILTER (severity = 'MINOR') AS unchanged FROM th""",
)(lambda x: merges.upsert_report(
    closed_thesaurus(x).filter("id % 3 = 0 OR severity = 'MINOR'"),
    closed_thesaurus(x).filter("severity <> 'MINOR'"), ["dci_a", "dci_b"],
))
_STATS = {
    "total": "count(*)", "distinct_a": "count(DISTINCT dci_a)", "distinct_b": "count(DISTINCT dci_b)",
    **{s: f"count(*) FILTER (severity = '{s}')" for s in ("MAJOR", "MODERATE", "MINOR")},
    "with_mechanism": "count(*) FILTER (coalesce(mechanism, '') <> '')",
    "with_recommendation": "count(*) FILTER (coalesce(recommendation, '') <> '')",
}
query(
    "thesaurus_stats", ["fx_interactions_raw"],
    TH_CTE + " UNION ALL ".join(f" SELECT '{n}' AS stat, {e} AS value FROM th" for n, e in _STATS.items()),
)(lambda x: quality.thesaurus_stats(closed_thesaurus(x)))
query(
    "thesaurus_levels", ["fx_interactions_raw"], TH_CTE + " SELECT level_fr, count(*) AS n FROM th GROUP BY ALL",
)(lambda x: quality.level_distribution(closed_thesaurus(x)))
query(
    "thesaurus_severities", ["fx_interactions_raw"], TH_CTE + " SELECT severity, count(*) AS n FROM th GROUP BY ALL",
)(lambda x: quality.severity_distribution(closed_thesaurus(x)))
query(
    "thesaurus_top_molecules", ["fx_interactions_raw"],
    TH_CTE + " SELECT dci_a, count(*) AS n FROM th GROUP BY ALL ORDER BY n DESC, dci_a LIMIT 5",
)(lambda x: quality.top_molecules(closed_thesaurus(x)))
@query(
    "load_reconciliation", ["fx_interactions_raw", "fx_drugs"],
    BEST_CTE + _LOADED + """, counts AS (SELECT count(*) + count(*) FILTER (twice) - count(*) FILTER (fate = 'malformed') AS read,
        count(*) FILTER (fate = 'malformed') AS malformed, count(*) FILTER (fate = 'no_id') AS no_id, count(*) FILTER (twice) AS duplicate,
        count(*) FILTER (fate = 'present') AS present, count(*) FILTER (fate = 'inserted') AS inserted,
        count(*) FILTER (fate = 'inserted' OR id % 3 = 0) AS total FROM fate),
      steps AS (SELECT r AS read, r - k AS removed, k AS kept, c - k AS added, c AS closed FROM (SELECT
        (SELECT count(*) FROM fixed) AS r, (SELECT count(*) FROM best) AS k, (SELECT count(*) FROM closed) AS c))
    SELECT 'catalogue' AS load, step, n FROM (UNPIVOT counts ON read, malformed, no_id, duplicate, present, inserted, total INTO NAME step VALUE n)
    UNION ALL SELECT 'thesaurus', step, n FROM (UNPIVOT steps ON read, removed, kept, added, closed INTO NAME step VALUE n)""",
)
def _load_reconciliation(x: Inputs):
    """Counts of both loads, each over one reading of its tables."""
    path, before = _catalogue_file(x)
    counts = merges.load_catalogue(path, before, work_path(x.spark, "loaded-drugs"), header=False)
    loaded = x.spark.createDataFrame(list(counts.items()), "step string, n long")
    steps = quality.load_reconciliation(thesaurus.fix_fragments(x.view("fx_interactions_raw")))
    each = F.array(*(F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in steps.columns))
    return loaded.select(F.lit("catalogue").alias("load"), "*").unionByName(steps.select(F.lit("thesaurus").alias("load"), F.inline(each)))


# --- thesaurus pages -------------------------------------------------------------------------------

LINES_CTE = """, lines AS (
      SELECT doc_id, page, cast(round_even(top, 0) AS int) AS line,
        coalesce(string_agg(text, ' ' ORDER BY x0, seq) FILTER (x0 < 310), '') AS left_text,
        coalesce(string_agg(text, ' ' ORDER BY x0, seq) FILTER (x0 >= 310), '') AS right_text,
        coalesce(string_agg(text, ' ' ORDER BY x0, seq) FILTER (x0 < 310 AND text <> '+'), '') AS left_unplussed,
        first(text ORDER BY x0, seq) FILTER (x0 < 310) AS left_first,
        first(fontname ORDER BY x0, seq) FILTER (x0 < 310) AS left_font,
        first(size ORDER BY x0, seq) FILTER (x0 < 310) AS left_size,
        first(fontname ORDER BY x0, seq) FILTER (x0 >= 310) AS right_font
      FROM fx_words GROUP BY 1, 2, 3),
    levelled AS (SELECT *, CASE WHEN right_font = 'CIDFont+F1' THEN CASE
        WHEN right_text LIKE 'Association déconseillée%' OR regexp_matches(right_text, '\\bASDEC\\b') THEN 'Association déconseillée'
        WHEN right_text LIKE '%Contre-indication%' OR regexp_matches(right_text, '\\bCI\\b') THEN 'Contre-indication'
        WHEN right_text LIKE '%Précaution d''emploi%' OR regexp_matches(right_text, '\\bPE\\b') THEN 'Précaution d''emploi'
        WHEN right_text LIKE '%A prendre en compte%' THEN 'À prendre en compte' END END AS level_fr FROM lines),
    kinds AS (SELECT *, CASE WHEN left_font = 'CIDFont+F1' AND left_size >= 9 AND left_text NOT LIKE '+%' THEN 'A'
        WHEN left_first = '+' THEN 'B' WHEN level_fr IS NOT NULL THEN 'L' ELSE 'body' END AS kind FROM levelled)"""
RECORDS_CTE = LINES_CTE + """, blocks AS (SELECT *,
      sum(CASE WHEN kind IN ('A', 'B') THEN 1 ELSE 0 END) OVER w AS block,
      last_value(CASE WHEN kind = 'A' THEN left_text END IGNORE NULLS) OVER w AS dci_a
      FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING)),
    segments AS (SELECT *, sum(CASE WHEN kind = 'L' THEN 1 ELSE 0 END) OVER w AS level_no,
      last_value(CASE WHEN kind = 'B' THEN left_unplussed END IGNORE NULLS) OVER w AS dci_b
      FROM blocks WINDOW w AS (PARTITION BY doc_id, block ORDER BY page, line ROWS UNBOUNDED PRECEDING))"""

query(
    "thesaurus_page_lines", ["fx_words"],
    LINES_CTE + " SELECT doc_id, page, line, left_text, right_text, left_font, left_size, right_font FROM lines",
)(lambda x: thesaurus.split_columns(thesaurus.words_to_lines(x.view("fx_words"))).select(
    "doc_id", "page", "line", "left_text", "right_text", "left_font", "left_size", "right_font"
))
query(
    "thesaurus_line_kinds", ["fx_words"],
    LINES_CTE + " SELECT doc_id, page, line, kind, CASE WHEN kind = 'L' THEN level_fr END AS level_fr FROM kinds",
)(lambda x: thesaurus.classify_lines(
    thesaurus.split_columns(thesaurus.words_to_lines(x.view("fx_words")))
).select("doc_id", "page", "line", "kind", F.when(F.col("kind") == "L", F.col("level.level_fr")).alias("level_fr")))
query(
    "thesaurus_segments", ["fx_words"],
    RECORDS_CTE + " SELECT doc_id, page, line, cast(block AS bigint) AS block, cast(greatest(level_no, 1) AS bigint)"
    " AS record, dci_a, dci_b FROM segments",
)(lambda x: thesaurus.segment_records(thesaurus.classify_lines(
    thesaurus.split_columns(thesaurus.words_to_lines(x.view("fx_words")))
)).select("doc_id", "page", "line", "block", "record", "dci_a", "dci_b"))
query(
    "thesaurus_records", ["fx_words"],
    RECORDS_CTE + """ SELECT doc_id, cast(block AS bigint) AS block, cast(greatest(level_no, 1) AS bigint) AS record,
      max(dci_a) AS dci_a, max(dci_b) AS dci_b, max(CASE WHEN kind = 'L' THEN level_fr END) AS level_fr,
      max(CASE WHEN kind = 'L' THEN CASE level_fr WHEN 'Précaution d''emploi' THEN 'MODERATE'
        WHEN 'À prendre en compte' THEN 'MINOR' ELSE 'MAJOR' END END) AS severity,
      coalesce(string_agg(left_text, ' ' ORDER BY page, line) FILTER (left_text <> '' AND (kind = 'L'
        OR (kind = 'body' AND left_font = 'CIDFont+F2' AND coalesce(dci_b, '') <> ''))), '') AS mechanism,
      coalesce(string_agg(right_text, ' ' ORDER BY page, line) FILTER (right_text <> '' AND kind = 'body'
        AND right_font = 'CIDFont+F2' AND level_no > 0), '') AS recommendation
    FROM segments GROUP BY 1, 2, 3
    HAVING max(dci_a) <> '' AND max(dci_b) <> '' AND max(CASE WHEN kind = 'L' THEN level_fr END) IS NOT NULL""",
)(lambda x: thesaurus.rebuild_interactions(x.view("fx_words")))

# --- stored pages -----------------------------------------------------------------------------------

_PAGE_MARKS = {"title": "h1", "header": "li", "content": "p"}


def _visible_sql(c: str) -> str:
    s = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        s = f"replace({s}, '{entity}', '{char}')"
    return strip_sql(f"regexp_replace({s}, '[\\s\\x{{00a0}}]+', ' ', 'g')")


_CLEAN_PAGES = """WITH clean AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS html FROM pages)"""
_RECORDS_SQL = f"""zipped AS (SELECT page_id, i, {_visible_sql("headers[i]")} AS key, {_visible_sql("contents[i]")} AS value
      FROM (SELECT *, unnest(range(1, 1 + least(len(headers), len(contents)))) AS i FROM found WHERE len(titles) > 0)
      UNION ALL SELECT page_id, 0, 'drug_name', {_visible_sql("titles[1]")} FROM found WHERE len(titles) > 0),
    records AS (SELECT page_id, key, last(value ORDER BY i) AS value FROM zipped WHERE key <> '' GROUP BY 1, 2)"""
# a paragraph ends where it is closed or the next one begins
_PAGES_SQL = _CLEAN_PAGES + f""", found AS (SELECT page_id, regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) AS titles,
      regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS headers,
      list_transform(string_split(html, '<p>')[2:], lambda t: split_part(t, '</p>', 1)) AS contents FROM clean),
    {_RECORDS_SQL}"""
_MARKED_SQL = _CLEAN_PAGES + f""", found AS (SELECT page_id,
      list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda t: t || ' <b>fiche</b>') AS titles,
      list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda t: replace(t, '</a>', ' , x')) AS headers,
      list_transform(regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1), lambda t: t || ' , x') AS contents FROM clean),
    {_RECORDS_SQL}"""


def page_records(x: Inputs):
    return web_pages.extract_records(x.table("pages"), **_PAGE_MARKS)


def marked_pages(x: Inputs):
    """The stored pages in the markup of the catalogue: nested elements of one name, both quotes and none, several classes."""
    html = F.col("html")
    for old, new in (
        ("<h1>", '<section class="page main-title"><section>'), ("</h1>", "</section><section> <b>fiche</b></section></section>"),
        ("<li>", "<div class=detail-header>"), ("</li>", "</div>"),
        ('<a href="', "<div id=a class='a detail-content' title=\""), ("</a>", "<div>, <br><i>x</i></div></div>"),
    ):
        html = F.replace(html, F.lit(old), F.lit(new))
    return x.table("pages").withColumn("html", html)


query("page_records", None, _PAGES_SQL + " SELECT * FROM records")(
    lambda x: page_records(x).select("page_id", F.explode_outer("record").alias("key", "value"))
)
query("page_records_by_class", None, _MARKED_SQL + " SELECT * FROM records")(
    lambda x: web_pages.extract_records(marked_pages(x)).select("page_id", F.explode_outer("record").alias("key", "value"))
)


@query(
    "page_record_table", None,
    _PAGES_SQL + """ SELECT p.page_id, h.key AS header, r.value FROM (SELECT DISTINCT page_id FROM records) p
      JOIN (SELECT DISTINCT key FROM records) h ON true LEFT JOIN records r ON r.page_id = p.page_id AND r.key = h.key""",
)
def _record_table(x: Inputs):
    """The wide table of all headers, shown as one row per page and header."""
    records = page_records(x).cache()
    headers = sorted(r["header"] for r in web_pages.record_headers(records).collect())  # the columns of the table
    wide = web_pages.widen_records(records, ["page_id"], headers)
    wide = wide.toDF("page_id", *(f"c{i}" for i in range(len(headers))))  # headers may differ in case only
    cells = F.array(*(F.struct(F.lit(h).alias("header"), F.col(f"c{i}").alias("value")) for i, h in enumerate(headers)))
    return wide.select("page_id", F.inline(cells))


query("page_record_headers", None, _PAGES_SQL + " SELECT key AS header, count(*) AS records FROM records GROUP BY 1")(
    lambda x: web_pages.record_headers(page_records(x))
)
query(
    "listing_urls", ["fx_listing"],
    """, last AS (SELECT letter, string_split(hrefs, '|')[-1] AS href FROM fx_listing),
      counted AS (SELECT letter, coalesce(cast(nullif(regexp_extract('/' || href || '/', '.*/(\\d+)/', 1), '') AS int), 1) AS n
        FROM last)
    SELECT letter, cast(page AS int) AS page, 'https://example.org/listing/' || CASE WHEN page = 1 THEN '' ELSE 'page/' || page || '/' END
      || '?lettre=' || letter AS url FROM (SELECT letter, unnest(range(1, n + 1)) AS page FROM counted)""",
)(lambda x: web_pages.listing_urls(
    x.view("fx_listing").select("letter", F.split("hrefs", r"\|").alias("hrefs")), "https://example.org/listing"
))

# --- doses -------------------------------------------------------------------------------------------

query(
    "dose_units", ["fx_lines"],
    "SELECT id, CASE duration_days % 4 WHEN 0 THEN dose_mg * 1000.0 WHEN 1 THEN dose_mg * 1.0"
    " WHEN 2 THEN dose_mg * 0.001 END AS mg FROM fx_lines",
)(lambda x: x.view("fx_lines").select(
    "id", scoring.dose_in_mg(F.concat(F.translate(F.col("dose_mg").cast("string"), ".", ","), F.expr(
        "CASE duration_days % 4 WHEN 0 THEN ' g' WHEN 1 THEN 'mg/jour' WHEN 2 THEN ' µg ' ELSE ' UI' END"
    ))).alias("mg"),
))
query(
    "dose_outliers", ["fx_lines"],
    """, usual AS (SELECT dci, quantile_disc(dose_mg, 0.5) AS usual_mg FROM fx_lines GROUP BY dci)
    SELECT id, dci, dose_mg, usual_mg FROM fx_lines JOIN usual USING (dci) WHERE dose_mg > usual_mg * 1.9""",
)(lambda x: scoring.dose_outliers(x.view("fx_lines"), 1.9).select("id", "dci", "dose_mg", "usual_mg"))
