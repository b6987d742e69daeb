"""Cleaning expressions, catalogue files and stored pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rxspark.functions import clinical, text
from rxspark.operators import catalogue, scoring
from rxspark.rules import CATALOGUE_HEADERS
from rxspark.sources import catalogue_files, merges, web_pages


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_expressions(spark):
    assert values(spark, text.parse_price, ["372.00 dhs", "1\xa0234,5", "1 234", "gratuit", "", None]) == [372.0, 1234.5, 1.0, None, None, None]
    assert values(spark, text.clean_toxicity, [" a ", "Aucun", "AUCUNE", "", None]) == ["A", None, None, None, None]
    assert values(spark, text.normalize_min_age, ["Six ans.", "30 mois", "dès 06 an", "adulte..", "...", "", None, "unique"]) == [
        "6 ans", "30 mois", "6 ans", "adulte", None, None, None, "unique"]
    assert values(spark, text.clean_text, ["a\xa0​b", "été", "x\t\r  y\nz ", "  ", None, "가"]) == [
        "a b", "été", "x y\nz", None, None, "가"]
    assert values(spark, text.parse_flag, [" Oui", "1", "non", None, ""]) == [True, True, False, False, False]
    assert values(spark, text.clean_status, [None, "", "  ", " x "]) == ["Commercialisé", "Commercialisé", "", "x"]
    assert values(spark, text.clean_link, ["Cliquez ici", " click here ", "http://a", None]) == [None, None, "http://a", None]
    assert values(spark, text.thesaurus_key, [" métoprolol ", "Éte", "cœur", "ñçÅ"]) == ["METOPROLOL", "ETE", "CŒUR", "NCA"]
    assert values(spark, text.capitalize, ["acide ACÉTYL", "é"]) == ["Acide acétyl", "É"]
    assert values(spark, text.number_text, [500.0, 0.25, 12345678.0, 1e-4], "double") == ["500.0", "0.25", "12345678.0", "0.0001"]
    assert values(spark, clinical.min_age_years, ["8 ans", "30 mois", "6 ans 3 mois", "Nouveau-né", "15", "12 years", "adulte", None, ""]) == [
        8, 2, 0, 0, 15, 12, None, None, None]
    assert values(spark, text.split_list, [" a, ,b ", None, ""]) == [["a", "b"], [], []]
    assert values(spark, text.nan_to_null, [1.0, float("nan"), None], "double") == [1.0, None, None]
    assert values(spark, scoring.dose_in_mg, ["0,5 g", "250 µg", "1.5mg/j", "3 UI", None]) == [500.0, 0.25, 1.5, None, None]


def test_age_on_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29), dt.date(2026, 2, 28)), (dt.date(2020, 2, 29), dt.date(2026, 3, 1)),
                                (dt.date(1980, 6, 15), dt.date(2024, 6, 15))], "b date, d date")
    assert [r.v for r in df.select(clinical.age_years(F.col("b"), F.col("d")).alias("v")).collect()] == [5, 6, 44]


def test_allergens(spark):
    df = spark.createDataFrame([(["Pénicillines", " soja ", ""],), (None,), ([],)], "a array<string>")
    assert [r.v for r in df.select(clinical.allergens(F.col("a")).alias("v")).collect()] == [
        ["", "pénicilline", "pénicillines", "s", "soja", "sojas"], [], []]


def test_molecules(spark):
    df = spark.createDataFrame([(1, "Acide  acétylsalicylique | Vitamine C|x| "), (2, None), (3, "|")], "id long, dci string")
    assert sorted(map(tuple, catalogue.split_molecules(df).collect())) == [(1, "Acide acétylsalicylique", 1), (1, "Vitamine C", 2)]


def test_raw_csv(spark, tmp_path):
    headers = ",".join(f'"{h}"' for h in CATALOGUE_HEADERS)
    row = ",".join(['"DOLI ""500""\nmg"'] + [f'"v{i}"' for i in range(len(CATALOGUE_HEADERS) - 1)])
    path = tmp_path / "raw.csv"
    path.write_text("﻿" + headers + "\n" + row + "\n", encoding="utf-8")
    raw = catalogue_files.rename_headers(catalogue_files.read_raw_catalogue(spark, str(path)))
    assert [r.brand_name_raw for r in raw.collect()] == ['DOLI "500"\nmg']
    assert catalogue_files.ingest_gate(raw).first().asDict() == {"records": 1, "ok": True}
    with pytest.raises(ValueError):
        catalogue_files.rename_headers(raw)
    with pytest.raises(ValueError):
        catalogue_files.require_records(raw.limit(0))


def test_pages(spark):
    html = """<div class="x main-title"> DOLI <b>1&amp;2</b></div><p class="detail-header">PPV</p><p class="detail-content">5 dhs</p>
      <p class="detail-header"></p><p class="detail-content">skip</p><p class="detail-header">PPV</p><p class="detail-content">6 dhs</p>
      <p class="detail-header">unpaired</p>"""
    pages = spark.createDataFrame([(1, html), (2, "<p class='detail-header'>a</p>")], "page_id long, html string")
    records = web_pages.extract_records(pages)
    assert [(r.page_id, r.record) for r in records.collect()] == [(1, {"drug_name": "DOLI 1&2", "PPV": "6 dhs"})]
    wide = web_pages.widen_records(records, ["page_id"], ["PPV", "Tableau"]).first()
    assert (wide.PPV, wide.Tableau) == ("6 dhs", None)
    letters = spark.createDataFrame([("A", ["/page/2/", "/listing/page/3/?lettre=A"]), ("B", []), ("C", None), ("D", ["/x"])],
                                    "letter string, hrefs array<string>")
    urls = sorted((r.letter, r.page, r.url) for r in web_pages.listing_urls(letters, "b").collect())
    assert [u[:2] for u in urls] == [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("C", 1), ("D", 1)]
    assert urls[0][2] == "b/?lettre=A" and urls[1][2] == "b/page/2/?lettre=A"


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (3, "late", 2), (3, "first", 1)], "id long, v string, o int")
    assert sorted(map(tuple, merges.insert_if_absent(old, new, "id", "o").collect())) == [(1, "a"), (2, "b"), (3, "first")]
    upserted = merges.upsert(old, new.filter("v <> 'late'").withColumn("v", F.nullif("v", F.lit("x"))), ["id"], ["v"])
    assert sorted(map(tuple, upserted.collect())) == [(1, "a"), (2, None), (3, "first")]


def test_catalogue_is_cleaned_by_all_tasks_and_once(spark):
    """One small file is one split: its rows are dealt out before the cleaning. Numbering evaluates the clean rows once."""
    from pyspark.sql import functions as F

    from rxspark.operators import catalogue
    from rxspark.rules import CATALOGUE_HEADERS

    seen = spark.sparkContext.accumulator(0)

    def spelled(i: int) -> str:
        seen.add(1)
        return f"marque {i % 7}"

    raw = spark.range(40).coalesce(1).select(F.col("id"), *[F.lit("x").alias(c) for c in CATALOGUE_HEADERS.values()])
    clean = catalogue.clean_catalogue(raw.drop("id"))
    assert "RoundRobinPartitioning" in clean._jdf.queryExecution().executedPlan().toString()
    rows = raw.coalesce(1).select(
        F.udf(spelled, "string")("id").alias("brand_name"),
        *[F.lit(str(i)).alias(c) for i, c in enumerate(catalogue.DRUG_COLUMNS) if c not in ("id", "brand_name")],
    )
    numbered = catalogue.number_drugs(rows).collect()
    assert sorted(r.id for r in numbered) == list(range(1, 41)) and [r.brand_name for r in sorted(numbered)] == sorted(r.brand_name for r in numbered)
    assert seen.value == 40
