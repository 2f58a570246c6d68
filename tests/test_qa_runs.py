"""Reruns against full runs, for random edits; and each pair by its own languages."""

import random

import pytest
from pyspark.sql import functions as F

from twintext.operators import qa
from twintext.operators.qa_runs import apply_changes, full_run, pair_issues, rerun

SCHEMA = "id int, source string, target string, status string, src_lang string, tgt_lang string, file int, unit string"
KEY = ["id"]


def pairs(rng, n):
    texts = ["One.", "Two", "Three 3", "Four (", "", None, "One.", "¿Que?", "Non !"]
    langs = ["en", "es-MX", "fr", "fr-CA", "de", None]
    return [(i, rng.choice(texts), rng.choice(texts), rng.choice(["translated", "draft"]), rng.choice(langs), rng.choice(langs), rng.randint(1, 2), rng.choice([None, "g"])) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("group", [(), ("file", "unit")])
def test_rerun_equals_a_full_run(spark, group):
    rng = random.Random(len(group))
    for _ in range(2):
        made = pairs(rng, 40)
        df = spark.createDataFrame(made, SCHEMA)
        dismissed = F.col("id") % 2 == 0
        before = full_run(df, KEY, group=group).withColumn("dismissed", dismissed)
        ids = rng.sample(range(45), 6)
        edits = [(i, *pairs(rng, 1)[0][1:], rng.choice([None, False, True])) for i in ids]
        changes = spark.createDataFrame(edits, SCHEMA + ", removed boolean")
        got = rerun(df, changes, before, KEY, group=group)
        # What was dismissed stays so by key and rule; what is new is open.
        was = {(r.id, r.rule): r.dismissed for r in before.collect()}
        want = sorted((r.id, r.rule, r.severity, was.get((r.id, r.rule), False)) for r in full_run(apply_changes(df, changes, KEY), KEY, group=group).collect())
        assert rows(got.select("id", "rule", "severity", "dismissed")) == want


def test_no_change_and_no_pair(spark):
    df = spark.createDataFrame(pairs(random.Random(1), 20), SCHEMA)
    before = full_run(df, KEY).withColumn("dismissed", F.lit(True))
    none = df.where("false").withColumn("removed", F.lit(False))
    assert rows(rerun(df, none, before, KEY)) == rows(before.select("id", "rule", "severity", "dismissed"))
    assert full_run(df.where("false"), KEY).collect() == []


def test_each_pair_is_judged_by_its_languages(spark):
    made = pairs(random.Random(7), 200)
    df = spark.createDataFrame(made, SCHEMA)
    got = rows(pair_issues(df, KEY))
    want = []
    for src in {r[4] for r in made}:
        for tgt in {r[5] for r in made}:
            part = df.where(F.col("src_lang").eqNullSafe(F.lit(src)) & F.col("tgt_lang").eqNullSafe(F.lit(tgt))).withColumn("source", F.coalesce("source", F.lit("")))
            want.append(qa.issues(part, KEY, src or "", tgt or ""))
    total = want[0]
    for x in want[1:]:
        total = total.unionByName(x)
    assert got == rows(total.where(F.col("rule").isin("seg.empty", "seg.untranslated", "num.missing", "num.altered", "punct.terminal", "punct.brackets", "punct.inverted", "punct.spacing")))


def test_consistency_shuffles_digests(spark):
    """Equal sources with different targets are found by digests; no text is shuffled."""
    from twintext.operators import qa

    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "x")], "k int, source string, target string")
    out = qa._differing(rows, ["k"], [], "source", "target")
    assert sorted(r.k for r in out.collect()) == [1, 2]
    assert "sha2(" in out._jdf.queryExecution().optimizedPlan().toString()
