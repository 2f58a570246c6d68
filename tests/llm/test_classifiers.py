"""Held-out accuracy of the classifiers and their answers to odd texts."""

import os

import pytest
from pyspark.sql import functions as F

from twintext.llm import queries
from twintext.llm.lang_id import fit_language, identify_language
from twintext.llm.quality import fit_quality, score_quality
from twintext.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@there
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language(spark, SF).where("held_out").join(docs, "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


@there
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = queries.op3_quality(spark, SF).where("held_out").join(labels, "doc_id")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()


@there
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id")
    got = queries.op5_toxicity(spark, SF).where("held_out").join(labels, "doc_id").join(docs, "doc_id").toPandas()
    assert got[got.toxic == 1].predicted.mean() >= 0.8 and got[got.toxic == 0].predicted.mean() <= 0.05


def odd(spark):
    base = [(i, ("good words here " if i % 2 else "awful nasty moron ") * (1 + i % 5), "en" if i % 3 else "de") for i in range(60)]
    rows = [*base, (100, None, "en"), (101, "", None), (102, "1234 !!", "de"), (102, "1234 !!", "de"), (None, "good", "en"), (103, "long " * 60_000, "en")]
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, lang string, score double, held_out int")


def test_odd_texts(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([*[(i, i % 2, 1 - i % 2) for i in range(60)], (None, 1, 1), (3, None, None), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    for scored in (score_quality(docs, fit_quality(docs, labels, learn)), score_toxicity(docs, fit_toxicity(docs, labels, learn))):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    found = identify_language(docs, fit_language(docs, learn)).collect()
    assert {r.lang_pred for r in found if r.doc_id in (100, 101, 102)} == {"und"} and all(0 <= r.score <= 1 for r in found)


def test_empty_tables(spark):
    docs = odd(spark)
    none, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    assert len(score_quality(docs, fit_quality(docs, labels, learn)).collect()) == docs.count()
    assert len(score_toxicity(docs, fit_toxicity(docs, labels, learn)).collect()) == docs.count()
    assert score_quality(none, fit_quality(none, labels, learn)).collect() == score_toxicity(none, fit_toxicity(none, labels, learn)).collect() == []
    assert identify_language(docs, fit_language(none, learn)).where("lang_pred <> 'und'").count() == 0
    assert drop_toxic(none, fit_toxicity(none, labels, learn), 0.3).collect() == []
