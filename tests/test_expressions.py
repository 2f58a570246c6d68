"""Facts about single expressions."""

import pytest
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.operators import matching, qa


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("  a b  c ", "a b c"), ("“x” – ‘y’…", "\"x\" - 'y'..."), ("ét­e", "éte"), ("a \n b", "a b"), ("", ""), (None, None), ("5′ 6″ «q»", "5' 6\" \"q\""),
])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize(F.col("x").cast("string")), x=text) == want


@pytest.mark.parametrize(("text", "want"), [("e-mail l'homme 1,000.50", 3), ("— • «", 0), ("a​b﻿c", 3), ("", 0), ("ß Ж 中", 3)])
def test_count_words(spark, text, want):
    assert one(spark, T.count_words(F.col("x")), x=text) == want


def test_fuzzy_words(spark):
    assert one(spark, T.fuzzy_words(F.col("x")), x="Open 3 files, 1.000,5 MB – Éa!") == ["open", "#", "files", "#", "mb", "éa"]


@pytest.mark.parametrize(("origin", "tier"), [("tm_exact", "exact"), ("propagated", "exact"), ("tm_ice", "ice"), ("tm_fuzzy_95", "fuzzy_95_99"), ("tm_fuzzy_94", "fuzzy_85_94"), ("tm_fuzzy_75", "fuzzy_75_84"), ("tm_fuzzy_50", "fuzzy_50_74"), ("tm_fuzzy_49", "no_match"), (None, "no_match"), ("mt_draft", "no_match")])
def test_tiers(spark, origin, tier):
    assert one(spark, T.tier_for_origin(F.col("x").cast("string")), x=origin) == tier


def test_whole_word(spark):
    hit = lambda text, term, lang: one(spark, T.whole_word(F.col("x"), F.col("y"), lang), x=text, y=term)
    assert hit("The Invoices came", "invoice", "en") and not hit("preinvoice", "invoice", "en") and not hit("invoicer", "invoice", "en") and hit("C++ (new)", "c++", "en")


def test_csv_cell(spark):
    assert [one(spark, T.csv_cell(F.col("x")), x=x) for x in ("=1+1", 'a"b', "a,b", "plain")] == ["'=1+1", '"a""b"', '"a,b"', "plain"]


def scored(spark, a, b, least=50):
    w = lambda c: T.fuzzy_words(F.col(c))
    return one(spark, matching.score(w("a"), w("b"), T.numerals(F.col("a")), T.numerals(F.col("b")), least), a=a, b=b)


def test_scores(spark):
    assert scored(spark, "press the red key", "Press the red key!") == 99
    assert scored(spark, "wait 5 minutes now", "wait 7 minutes now") == 98
    assert scored(spark, "one two three four", "one two three five") == 75
    assert scored(spark, "one two", "three four") is None
    assert scored(spark, "", "") is None


def test_punctuation(spark):
    rule = lambda c, s, t: one(spark, c, s=s, t=t)
    s, t = F.col("s"), F.col("t")
    assert rule(qa.punct_terminal(s, t), "Go.", "Geh") and not rule(qa.punct_terminal(s, t), "Go.", "Geh!”") and not rule(qa.punct_terminal(s, t), "Go", " ")
    assert rule(qa.punct_brackets(s, t), "(a)", "(a") and not rule(qa.punct_brackets(s, t), "(a", "(b") and not rule(qa.punct_brackets(s, t), "x", "a) x")
    assert rule(qa.punct_inverted(t), "", "Hola?") and not rule(qa.punct_inverted(t), "", "¿Hola? ¡Si!")
    assert rule(qa.punct_spacing(t, "de"), "", "a , b") and rule(qa.punct_spacing(t, "fr"), "", "quoi?") and not rule(qa.punct_spacing(t, "fr"), "", "quoi ?") and not rule(qa.punct_spacing(t, "fr-CH"), "", "quoi?")


@pytest.mark.parametrize(("s", "t", "src", "tgt", "want"), [
    ("1,000.50 and 3", "1 000,50 et 3", "en", "fr", ([], [])), ("1,000", "1 000", "en", "en", ([], ["1,000"])), ("5 of 7", "5", "en", "de", (["7"], [])),
    ("2024-05-06", "06.05.2024", "en", "de", ([], [])), ("3.2.1", "3.2.1", "en", "de", ([], [])), ("", "4", "en", "de", ([], [])),
    ("June 5, 2024", "05.06.2024", "en", "de", ([], [])), ("3 and 3", "3.2.1", "en", "de", ([], [])), ("On 03/12/2025, 40 people.", "Am 12.03.2025.", "en", "de", (["40"], [])), ("10 and 10", "10", "en", "en", (["10"], [])),
    ("1,000", "10.00 and 1000", "en", "en", ([], [])), ("1.5", "1,5", "xx", "yy", ([], ["1.5"])), ("1'234.5", "1,234.5", "de_CH", "en", ([], [])),
])
def test_numbers(s, t, src, tgt, want):
    assert qa.compare_numerals(s, t, src, tgt) == want


def test_issues_are_judged_without_lambdas(spark):
    """Conditions inside a lambda's argument would be interpreted; marks and spaces are found in one pass each."""
    rows = [(1, "A.", "A. "), (2, "A.", 'a." '), (3, "(a", "[a"), (4, "x", "a  b"), (5, "x", "a ."), (6, "x", "a .."), (7, "x", "a ,"), (8, "1) x", "a) x"), (9, "x", None), (10, "x", "x")]
    df = spark.createDataFrame([(*r, "translated") for r in rows], "k int, source string, target string, status string")
    found = qa.issues(df, ["k"], "en", "en", ("seg.empty", "seg.untranslated", "punct.terminal", "punct.brackets", "punct.spacing"))
    assert "explode(filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.rule) for r in found.collect()}
    assert got == {(1, "punct.terminal"), (2, "punct.brackets"), (3, "punct.brackets"), (4, "punct.spacing"), (5, "punct.terminal"), (5, "punct.spacing"), (6, "punct.terminal"), (7, "punct.spacing"), (9, "seg.empty"), (10, "seg.untranslated")}
