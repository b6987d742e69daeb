import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece
from llm_helpers import documents, linked, overlap, shingles, texts, without_repeats

from rxspark.llm.common import stored


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_documents_stay_if_no_language_was_learned(spark):
    docs = spark.createDataFrame([(1, "a clean text", None), (2, "12 34 !!", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.languages(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 4}


def test_missing_languages_are_filled_in(spark):
    rows_ = [(i, "the thing and the other thing in there", "en") for i in range(5)] + [(10 + i, "der Hund und die Katze auf dem Dach", "de") for i in range(5)]
    docs = spark.createDataFrame([*rows_, (20, "the other and the thing", None), (21, "die Katze und der Hund", None), (22, "123", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.languages(spark, docs, "").collect()}
    assert got == {**{i: lang for i, _, lang in rows_}, 20: "en", 21: "de"}


def test_stages_like_brute_force(spark, tmp_path):
    sf_dir = str(tmp_path)
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    item = " ".join(texts()[1].split()[:24])
    spark.createDataFrame([(1, item), (2, "never seen words stand in this item of the benchmark " * 2)], "item_id long, text string").write.parquet(
        f"{sf_dir}/benchmark.parquet"
    )
    now, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf_dir), name)
        kept.append(now.collect())
        if stage is not corpus_pipeline.tokens:
            assert now.columns == docs.columns
    first, second, third, fourth, last = kept
    assert {r.text for r in first} == {r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    one = {r.doc_id: r.text for r in first if r.doc_id is not None}
    roots = linked({i: shingles(t) for i, t in one.items()})
    assert {r.doc_id for r in second} == {i for i in one if roots[i] == i} | {None}
    want = without_repeats([(r.doc_id, r.text.encode()) for r in {r.doc_id: r for r in second if r.doc_id is not None}.values()])
    for r in third:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id].decode("utf-8", "ignore")
            assert r.n_chars in (None, len(r.text)) or r.text == one[r.doc_id]
    leaks = {r.doc_id for r in third if r.doc_id is not None and overlap(r.text, item)}
    assert leaks and {r.doc_id for r in fourth} == {r.doc_id for r in third} - leaks
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(last) == len(fourth)
    for r in last:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text, add_bos=True, add_eos=True)
        assert r.round_trip == (library.decode(library.encode(r.text)) == r.text)
