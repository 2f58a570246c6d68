"""Plans of queries over large tables: what no single task may hold."""

import re

from pyspark.sql import functions as F

from twintext import stages
from twintext.functions import hidden, text
from twintext.functions import tokens as K
from twintext.operators import business, glossary, matching, placing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_estimate_does_not_gather_files_by_language(spark):
    files = spark.range(100).select(F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, "de").otherwise("fr").alias("tgt_lang"), F.lit(50).alias("words"))
    rates = spark.createDataFrame([("de", 0.1, 10.0, 100), ("fr", 0.2, None, None)], "tgt_lang string, rate double, minimum double, per_file long")
    out = business.estimate(files, rates)
    assert "SortMergeJoin" not in plan(out)
    assert {(r.tgt_lang, r.words, r.price) for r in out.collect()} == {("de", 100, 10.0), ("fr", 50, 10.0)}


def test_fuzzy_pairs_write_no_row_for_each_word(spark, monkeypatch):
    """Only the rarest runs of a text are dealt out, and no table holds all words as rows."""
    sizes, write = {}, matching.materialise

    def counted(df, name, **options):
        out = write(df, name, **options)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(matching, "materialise", counted)
    texts = [(str(i), " ".join(chr(97 + i) * 3 + chr(97 + k // 8) * 2 + chr(97 + k % 8) for k in range(40))) for i in range(20)]
    df = lambda key: spark.createDataFrame(texts, f"{key} string, plain string")
    found = matching.fuzzy_pairs(df("a"), df("b")).collect()
    assert {(r.a, r.b, r.score) for r in found} == {(str(i), str(i), 99) for i in range(20)}
    assert max(sizes.values()) <= len(texts)


def test_fuzzy_match_moves_only_texts_of_likely_pairs(spark, monkeypatch):
    """Equal texts are found by digests and candidates ruled out by bags; no table but the given texts holds any."""
    plans, kinds, write = {}, {}, matching.materialise

    def seen(df, name, **options):
        plans[name] = plan(df)
        kinds[name] = {t for _, t in df.dtypes}
        return write(df, name, **options)

    monkeypatch.setattr(matching, "materialise", seen)
    texts = [" ".join(chr(97 + i) * 2 + chr(97 + k) for k in range(20)) for i in range(8)] * 2
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "k long, plain string, lang string")
    memory = spark.createDataFrame([(i, t + " more", "en", 1, "2024") for i, t in enumerate(texts)], "tu_id long, plain string, lang string, quality int, updated_at string")
    got = {(r.k, r.tu_id, r.score) for r in matching.fuzzy_match(rows, memory, ["k"], limit=1, langs=("lang",)).collect()}
    assert got == {(k, k % 8, 95) for k in range(16)}
    assert {"text-ids", "fuzzy-near"} <= set(plans)
    assert not any(re.search(r"ReadSchema: struct<[^>]*plain", plans[name]) for name in ("text-ids", "fuzzy-near"))
    assert {name for name, t in kinds.items() if t & {"string", "array<string>"}} <= {"asked", "units"}


def test_rows_by_number_stay_where_they_are(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 3).select(F.monotonically_increasing_id().alias("n"), F.col("id").alias("x"))
    rows = stages.materialise(rows, "rows")
    ids = rows.where("x % 7 = 0").select("n")
    want = {x for x in range(1000) if x % 7 == 0}
    found = stages.numbered(rows, ids, "n")
    assert {r.x for r in found.collect()} == want
    assert "Exchange hashpartitioning(n#" not in plan(found)
    monkeypatch.setattr(stages, "BITS_BYTES", 0)
    assert {r.x for r in stages.numbered(rows, ids, "n").collect()} == want


def test_rows_are_sieved_before_they_are_shuffled(spark):
    """A semi join would be pushed below the sieve, and shuffle all rows."""
    rows = spark.createDataFrame([(None if i == 5 else i % 50, f"t{i}") for i in range(200)], "k int, x string")
    table = spark.createDataFrame([(i,) for i in (1, 2, 2, 60, None)], "k int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        have, lack = stages.having(rows, table, ["k"]), stages.lacking(rows, table, ["k"])
        assert sorted(have.collect()) == sorted(rows.where("k in (1, 2)").collect())
        assert {r.x for r in lack.collect()} == {r.x for r in rows.where("k is null or k not in (1, 2)").collect()}
        for found in (have, lack):
            assert plan(found).index("SortMergeJoin") < plan(found).index("BroadcastHashJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fuzzy_words_keep_their_bounds(spark):
    df = spark.createDataFrame([("ΟΔΟΣ Β1,5a 3.4.-Ⅻ don't İx",), (" .,",), (None,)], "t string")
    found = [r[0] for r in df.select(text.fuzzy_words(F.col("t"))).collect()]
    assert found == [["οδος", "β", "#", "a", "#", "#", "don", "t", "i̇x"], [], None]


def test_term_candidates_read_all_languages_in_one_pass(spark):
    lines = [("en", "the data base is new"), ("en", "a data base was old"), ("en_GB", "one Data base"), ("en", "data"), ("en", "Data"), ("en", "data!"), ("de", "die Daten"), ("de", "Daten und Daten"), ("xx", "data base")]
    rows = spark.createDataFrame([(i, 0, tag, t) for i, (tag, t) in enumerate(lines)], "doc_id long, ord int, lang string, plain string")
    out = glossary.term_candidates_by_language(rows, ["doc_id", "ord"])
    assert plan(out).count("FileScan") <= 2
    got = {(r.lang, r.term_key, r.term, r.occurrences, r.uncovered, r.words) for r in out.collect()}
    assert got == {("en", "data base", "data base", 3, 3, 2), ("en", "data", "data", 6, 3, 1), ("de", "daten", "Daten", 3, 3, 1)}


def test_segments_without_a_unit_meet_in_no_join(spark, monkeypatch):
    """The null unit would gather most segments in one task."""
    plans, write = {}, placing.materialise

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, **options)

    monkeypatch.setattr(placing, "materialise", seen)
    own = lambda c: F.array(K.token("text", c))
    rows = spark.createDataFrame([(1, 0, "one two", True), (2, 0, "alpha", False), (2, 1, "zz", False)], "doc_id long, ord int, line string, confirmed boolean")
    rows = matching.normalized(rows, "line").withColumns({"tokens": own(F.col("line")), "formats": F.array().cast(K.FORMATS), "target": F.lit(None).cast(K.TOKENS)})
    known = matching.normalized(spark.createDataFrame([(7, "alpha", 1, 3, "x")], "tu_id long, line string, priority int, quality int, updated_at string"), "line").withColumn("tokens", own(F.lit("beta")))
    out = placing.pretranslated_targets(rows, known, ["doc_id", "ord"], None)
    assert {(r.doc_id, r.ord): r.target and r.target[0].v for r in out.collect()} == {(1, 0): None, (2, 0): "beta", (2, 1): None}
    assert "isnull(tu_id" in plans["matches"]


def test_segments_are_normalised_once_in_a_cascade(spark, monkeypatch):
    """Donors and the placing read a written table; texts that nobody asks for are not written again."""
    plans, kinds = {}, {}
    for module in (placing, matching):
        def seen(df, name, write=module.materialise, **options):
            plans[name], kinds[name] = plan(df), df.columns
            return write(df, name, **options)

        monkeypatch.setattr(module, "materialise", seen)
    own = lambda c: F.array(K.token("text", c))
    rows = spark.createDataFrame([(1, 0, "alpha", True), (2, 0, "alpha", False), (2, 1, "zz", False), (3, 0, "beta", False)], "doc_id long, ord int, line string, confirmed boolean")
    rows = matching.normalized(rows, "line").withColumns({"tokens": own(F.col("line")), "formats": F.array().cast(K.FORMATS), "target": F.when(F.col("confirmed"), own(F.lit("Alpha!")))})
    known = matching.normalized(spark.createDataFrame([(7, "beta", 1, 3, "x")], "tu_id long, line string, priority int, quality int, updated_at string"), "line").withColumn("tokens", own(F.lit("Beta")))
    out = placing.pretranslated_targets(rows, known, ["doc_id", "ord"], None, keep=())
    got = {(r.doc_id, r.ord): (r.outcome, r.target and r.target[0].v) for r in out.collect()}
    assert got == {(1, 0): ("skipped", None), (2, 0): ("propagated", "Alpha!"), (2, 1): ("unmatched", None), (3, 0): ("exact", "Beta")}
    assert "ArrowEvalPython" in plans["rows"] and "ArrowEvalPython" not in plans["matches"]
    assert "plain" not in out.columns and "plain" not in kinds["segments"]


def test_hidden_tags_are_carried_a_few_rows_at_a_time(spark):
    pages = "<p>one <b>two</b> three</p>"
    rows = spark.range(3 * hidden.ROWS + 1).coalesce(1).withColumn("m", K.markup_tokens(F.lit(pages), {"b": "b"})).select("id", "m.tokens", "m.formats")
    rows = rows.withColumn("target", F.when(F.col("id") % 5 != 0, K.without_hidden(F.col("tokens"), F.col("formats"))))
    out = rows.select("id", "tokens", hidden.carry_hidden_tags(F.col("target"), F.col("tokens"), F.col("formats")).alias("out")).collect()
    assert len(out) == 3 * hidden.ROWS + 1
    assert all((r.out is None) if r.id % 5 == 0 else (r.out == r.tokens) for r in out)


def test_matches_are_placed_a_few_rows_at_a_time(spark):
    """Python gets Arrow rows and makes objects of a few, not of a whole batch."""
    pages = K.markup_tokens(F.lit("<p>one <b>two</b> three</p>"), {"p": "style", "b": "b"})
    rows = spark.range(3 * K.ROWS + 1).coalesce(1).withColumn("m", pages).select("id", "m.tokens", "m.formats")
    rows = rows.withColumn("memory", F.when(F.col("id") % 5 != 0, K.to_memory(F.col("tokens"), F.col("formats"))))
    found = rows.select("id", "tokens", K.place_match(F.col("memory"), F.col("tokens"), F.col("formats")).alias("p")).collect()
    assert len(found) == 3 * K.ROWS + 1
    assert all((r.p.tokens is None) if r.id % 5 == 0 else (r.p.tokens == r.tokens and r.p.tags_matched) for r in found)


def test_exact_match_carries_no_texts_of_units(spark):
    """The best unit of a hash is found by a hash aggregate without its text, and labels are met before lines are split."""
    from twintext.plans import queries

    out = queries.exact_match(spark, "/root/testdata/sf0.001")
    best = [x for x in plan(out).splitlines() if "max(struct(p" in x]
    assert best and not any("plain" in x.split("max(struct(p")[1] for x in best)
    assert out.count() > 0
