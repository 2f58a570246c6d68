"""Operators on small tables, against brute force and algebraic laws."""

import random

import pytest
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.operators import audit, business, glossary, matching, memory, qa, search, views
from twintext.operators.placing import pretranslated_targets
from twintext.operators.segmentation import rules_for, segment_texts, sentences
from twintext.plans import queries


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("least", [50, 75, 90])
def test_fuzzy_pairs_lose_nothing(spark, least):
    r = random.Random(least)
    text = lambda: [r.choice("a b c d e f g h".split()) for _ in range(r.randint(1, 9))]
    left, right = [text() for _ in range(40)], [text() for _ in range(40)]
    df = lambda rows, key: spark.createDataFrame([(str(i), " ".join(w)) for i, w in enumerate(rows)], f"{key} string, plain string")
    got = {(x["a"], x["b"]): x["score"] for x in matching.fuzzy_pairs(df(left, "a"), df(right, "b"), least).collect()}
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            n = max(len(a), len(b))
            s = min(99, 100 * (n - levenshtein(a, b)) // n)
            if s >= least:
                want[str(i), str(j)] = s
    assert got == want


def test_cascade(spark):
    rows = spark.createDataFrame([(1, 0, "one two three four", True), (1, 1, "one two three four", False), (2, 0, "alpha beta gamma delta", False), (2, 1, "alpha beta gamma", False), (2, 2, "zz", False)], "doc_id long, ord int, line string, confirmed boolean")
    m = matching.normalized(spark.createDataFrame([(7, "alpha beta gamma delta", 1, 3, "x"), (8, "alpha beta gamma delta", 1, 4, "x")], "tu_id long, line string, priority int, quality int, updated_at string"), "line")
    got = {(r.doc_id, r.ord): (r.outcome, r.origin, r.tu_id) for r in matching.pretranslate(matching.normalized(rows, "line"), m, ["doc_id", "ord"]).collect()}
    assert got == {(1, 0): ("skipped", None, None), (1, 1): ("propagated", "propagated", None), (2, 0): ("exact", "tm_exact", 8), (2, 1): ("fuzzy", "tm_fuzzy_75", 8), (2, 2): ("unmatched", None, None)}


def test_merge_laws(spark):
    r = random.Random(3)
    version = lambda: spark.createDataFrame([(k, r.randint(0, 2), r.choice("ab"), r.choice("xy"), r.randint(0, 2), r.randint(0, 9)) for k in r.sample(range(30), 20)], "k long, rev int, updated_at string, plain string, quality int, usage_count long")
    rows = lambda df: sorted(tuple(x) for x in df.drop("source").collect())
    a, b = version(), version()
    assert rows(memory.merge_variants(a, b, ["k"])) == rows(memory.merge_variants(b, a, ["k"]))
    assert rows(memory.merge_variants(a, a, ["k"])) == rows(a.select("k", "rev", "updated_at", "plain", "quality", "usage_count"))


def test_term_candidates_leave_covered_words(spark):
    text = ["the data base is new", "a data base was old", "one data base", "data", "Data", "data!"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(text)], "doc_id long, ord int, plain string")
    got = {r.term_key: (r.occurrences, r.uncovered, r.words) for r in glossary.term_candidates(rows, "en", ["doc_id", "ord"]).collect()}
    assert got == {"data base": (3, 3, 2), "data": (6, 3, 1)}


def test_tags(spark):
    tok = "array<struct<t:string,v:string,id:int>>"
    rows = spark.createDataFrame([(1, [("open", "", 1), ("text", "x", None), ("close", "", 1)], [("open", "", 1), ("close", "", 1)]), (2, [("ph", "", 3)], [("open", "", 1), ("open", "", 2), ("close", "", 1)])], f"k long, source_tokens {tok}, target_tokens {tok}")
    assert sorted(tuple(r) for r in qa.tag_issues(rows, ["k"]).collect()) == [(2, "tag.extra", "error", "1,2"), (2, "tag.missing", "error", "3"), (2, "tag.unbalanced", "error", "interleaved 1; unclosed 1; unclosed 2")]


def test_audit_chain(spark):
    log = spark.createDataFrame([(k, i, f'[{i},"x"]') for k in (1, 2) for i in range(5)], "k long, id long, body string")
    chain = audit.chained(log, "k", "id")
    assert {r.k: r.first_bad for r in audit.verify_chain(chain, "k", "id").collect()} == {1: None, 2: None}
    forged = chain.withColumn("body", F.when((F.col("k") == 2) & (F.col("id") == 3), "[]").otherwise(F.col("body")))
    assert {r.k: r.first_bad for r in audit.verify_chain(forged, "k", "id").collect()} == {1: None, 2: 3}


def test_prices(spark):
    files = spark.createDataFrame([(1, "de", 0), (1, "de", 50), (1, "de", 500), (2, "fr", 10)], "order_id long, tgt_lang string, words long")
    rates = spark.createDataFrame([("de", 0.1, 20.0, 100), ("fr", 0.1, 20.0, None)], "tgt_lang string, rate double, minimum double, per_file long")
    assert sorted((r.order_id, r.words, round(r.price, 2)) for r in business.estimate(files, rates).collect()) == [(1, 600, 60.0), (2, 10, 20.0)]


@pytest.mark.parametrize(("lang", "text", "want"), [
    ("en", "One came. Two left! Why? Three…", ["One came.", "Two left!", "Why?", "Three…"]),
    ("en", "Mr. Smith paid 3.5 per cent. He left.", ["Mr. Smith paid 3.5 per cent.", "He left."]),
    ("en", "J. Doe wrote it. e.g. this stays", ["J. Doe wrote it. e.g. this stays"]),
    ("en", "Home | about us | Help", ["Home |", "about us |", "Help"]),
    ("en", 'He said "Go." Then he went.', ['He said "Go."', "Then he went."]),
    ("en", "Wait... what? No. iPhone works.", ["Wait... what?", "No.", "iPhone works."]),
    ("de", "Am 3. Mai kam er. Der 2. teil fehlt.", ["Am 3. Mai kam er.", "Der 2. teil fehlt."]),
    ("es", "Hola. ¿Qué tal? Bien.", ["Hola.", "¿Qué tal?", "Bien."]),
    ("fr", "Il dit « Oui. » Puis il part.", ["Il dit « Oui. »", "Puis il part."]),
    ("en", "", []), ("en", "no end", ["no end"]),
])
def test_sentences(lang, text, want):
    assert sentences(text, rules_for(lang)) == want


def test_user_rules_decide_first():
    assert sentences("Part two; then more. Yes", rules_for("en", breaks=((r"; ?", r"then"),), keeps=((r"\.", r" Yes"),))) == ["Part two;", "then more. Yes"]
    with pytest.raises(ValueError):
        rules_for("xx")


def test_segment_texts(spark):
    docs = spark.createDataFrame([(1, "A b. C d.\nE", "en"), (2, None, "en"), (3, "x. Y", "zh")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in segment_texts(docs).orderBy("doc_id", "ord").collect()] == [(1, 0, "A b."), (1, 1, "C d."), (1, 2, "E"), (3, 0, "x. Y")]



def test_highlights(spark):
    rows = spark.createDataFrame([(1, "Éa b! ea  B, eab ea-b"), (2, None), (3, "none")], "k long, x string").orderBy("k")
    got = [r[0] for r in rows.select(search.highlight_ranges(F.col("x"), "ea b")).collect()]
    assert [[tuple(y) for y in x] for x in got] == [[(0, 4), (6, 11), (17, 21)], [], []]


def test_forbidden_rendering_inside_an_accepted_one(spark):
    terms = spark.createDataFrame([("file", "file", "files", None), ("disk", "drive", "hard", ["hard disk"])], "term string, preferred string, forbidden string, alternatives array<string>")
    targets = {1: "Two files.", 2: "Two fileses.", 3: "The files, fileses", 4: "A file", 5: "profiles", 6: "a hard disk drive", 7: "a hard drive", 8: "hard disks, so hard"}
    rows = [(k, "the disk" if k > 5 else "the file", t) for k, t in targets.items()]
    got = glossary.term_mismatch(spark.createDataFrame(rows, "k int, source string, target string"), terms, ["k"], "en", "en")
    found = {1: None, 2: "forbidden", 3: "forbidden", 4: None, 5: "missing_preferred", 6: None, 7: "forbidden", 8: "forbidden"}
    assert {r["k"]: r["kind"] for r in got.collect()} == {k: v for k, v in found.items() if v}
    plain = glossary.term_mismatch(spark.createDataFrame(rows[:5], "k int, source string, target string"), terms.drop("alternatives"), ["k"], "en", "en")
    assert {r["k"]: r["kind"] for r in plain.collect()} == {k: v for k, v in found.items() if v and k < 6}


def test_earlier_memory_wins_ties_of_fuzzy_scores(spark):
    rows = spark.createDataFrame([(1, "one two three four five")], "k int, plain string")
    memory = spark.createDataFrame([(1, "one two three four six", 2, 5, "2024-02-01"), (2, "one two three four ten", 1, 0, "2024-01-01")], "tu_id long, plain string, priority int, quality int, updated_at string")
    assert [(r["tu_id"], r["rank"]) for r in matching.fuzzy_match(rows, memory, ["k"]).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_fuzzy_by_language_and_tags(spark):
    """Against all pairs: languages must agree, numerals and tags cost."""
    r = random.Random(9)
    text = lambda: " ".join(r.choice(["a", "b", "c", "d", "1", "2", "3.5"]) for _ in range(r.randint(1, 9)))
    slots = lambda: [r.choice(["open:b", "ph:br"]) for _ in range(r.randint(0, 3))]
    left = [(str(i), text(), r.choice(["en-GB", "de"]), slots()) for i in range(30)]
    right = [(str(i), text(), r.choice(["en", "de_AT", "fr"]), slots()) for i in range(30)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} string, plain string, lang string, slots array<string>")
    got = {(x["a"], x["b"]): x["score"] for x in matching.fuzzy_pairs(df(left, "a"), df(right, "b"), 60, ("lang",)).collect()}
    number = lambda w: w[0].isdigit()
    want = {}
    for i, a, la, sa in left:
        for j, b, lb, sb in right:
            x, y = a.split(), b.split()
            n = max(len(x), len(y))
            d = levenshtein(["#" if number(w) else w for w in x], ["#" if number(w) else w for w in y])
            misses = sum(p != q for p, q in zip(filter(number, x), filter(number, y), strict=False))
            tags = sum(abs(sa.count(k) - sb.count(k)) for k in {*sa, *sb})
            score = min(99, 100 * (n - d) // n - 2 * misses - min(5, tags))
            if la[:2] == lb[:2] and score >= 60:
                want[i, j] = score
    assert got == want and want
    with pytest.raises(ValueError):
        matching.fuzzy_pairs(df(left, "a"), df(right, "b"), 49)


def test_pairs_of_very_many_words(spark, monkeypatch):
    monkeypatch.setattr(matching, "ALPHABET", "".join(chr(0x4E00 + i) for i in range(12)))
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    other = words[:54] + ["x", "y", "z"] + words[57:]
    rows = lambda key, *texts: spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], f"{key} string, plain string")
    got = matching.fuzzy_pairs(rows("a", words, words[:6]), rows("b", other, words[:5], words[1:]), 50).collect()
    assert {(x["a"], x["b"]): x["score"] for x in got} == {("0", "0"): 95, ("0", "2"): 98, ("1", "1"): 83}


def test_cascade_with_tags_siblings_and_languages(spark):
    bold, plain = [("open", None, 1, None), ("text", "one two three four", None, None), ("close", None, 1, None)], [("text", "one two three four", None, None)]
    formats = [(1, "b", True, "inline", "<b>", "</b>")]
    base = (False, False, False, "en")
    rows = [(1, "one two three four", bold, formats, *base), (2, "one two three four", plain, [], *base), (3, "one two three four", plain, [], False, True, False, "en"), (4, "one two three four", plain, [], False, False, True, "en"), (5, "one two three four", plain, [], False, False, False, "de"), (6, "one two three five", plain, [], *base)]
    df = spark.createDataFrame([(k, p, p, t, f, c, s, x, lang) for k, p, t, f, c, s, x, lang in rows], f"k int, plain string, hash string, tokens {K.TOKENS}, formats {K.FORMATS}, confirmed boolean, sibling boolean, protected boolean, lang string")
    memory = spark.createDataFrame([(9, "one two three four", "one two three four", 1, 3, "x", "en-US", [("open", None, 1, "i"), ("text", "eins", None, None), ("close", None, 1, None)])], f"tu_id long, plain string, hash string, priority int, quality int, updated_at string, lang string, tokens {K.TOKENS}")
    got = {r.k: (r.outcome, r.origin, r.status) for r in matching.pretranslate(df, memory, ["k"], langs=("lang",)).collect()}
    assert got == {1: ("tagdiff", "tm_exact_tagdiff", "draft"), 2: ("exact", "tm_exact", "translated"), 3: ("skipped", None, None), 4: ("skipped", None, None), 5: ("unmatched", None, None), 6: ("fuzzy", "tm_fuzzy_75", "draft")}
    assert {r.k for r in matching.pretranslate(df, memory, ["k"], None, ("lang",)).where("outcome = 'unmatched'").collect()} == {5, 6}


def test_queries_of_the_cascade(spark, tmp_path):
    """Whole memories, by brute force over small tables."""
    r = random.Random(12)
    line = lambda: " ".join(r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(r.randint(2, 7)))
    pool = [line() for _ in range(25)]
    docs = [(i, "\n".join(r.choice(pool) if r.random() < 0.7 else line() for _ in range(4)), r.choice(["en", "de"]), f"s{i % 2}") for i in range(30)]
    items, good = [(i, r.choice(pool)) for i in range(6)], {i for i in range(30) if i % 4 == 0}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i in good)) for i, *_ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    segments = [(i, k, x, lang) for i, t, lang, _ in docs for k, x in enumerate(t.split("\n"))]
    units = [(i, t, "en", 1, 3, "2024-01-01") for i, t in items] + [(i * 100_000 + k + 1_000_000, x, lang, 2, i % 5, "2024-02-01") for i, k, x, lang in segments if i in good]
    score = lambda a, b: min(99, 100 * (max(len(a), len(b)) - levenshtein(a, b)) // max(len(a), len(b)))
    best = {}
    for text, lang in {(x, lang) for _, _, x, lang in segments}:
        hits = [(-score(text.split(), u[1].split()), u[3], -u[4], [-ord(c) for c in u[5]], u[0]) for u in units if u[2] == lang]
        best[text, lang] = [(h[4], -h[0], n) for n, h in enumerate(sorted(h for h in hits if -h[0] >= 75)[:3], 1)]
    want = sorted((i, k, *hit) for i, k, x, lang in segments for hit in best[x, lang])
    assert sorted((x.doc_id, x.ord, x.tu_id, x.score, x["rank"]) for x in queries.fuzzy_match(spark, str(tmp_path)).collect()) == want
    exact, donors = {(u[1], u[2]) for u in units}, {(x, lang) for i, _, x, lang in segments if i % 3 == 0}
    outcome, tiers = {}, {}
    for i, _, x, lang in segments:
        o = "skipped" if i % 3 == 0 else "exact" if (x, lang) in exact else "propagated" if (x, lang) in donors else "fuzzy" if best[x, lang] else "unmatched"
        n = len(x.split())
        c, w = outcome.get(o, (0, 0))
        outcome[o] = (c + 1, w + n)
        if o != "skipped":
            s = best[x, lang][0][1] if o == "fuzzy" else 0
            tier = "exact" if o in ("exact", "propagated") else "fuzzy_95_99" if s >= 95 else "fuzzy_85_94" if s >= 85 else "fuzzy_75_84" if s >= 75 else "no_match"
            tiers[tier] = tiers.get(tier, 0) + n
    assert {x.outcome: (x.segments, x.words) for x in queries.pretranslate_summary(spark, str(tmp_path)).collect()} == outcome
    assert {x.tier: x.words for x in queries.tier_analysis(spark, str(tmp_path)).collect()} == tiers


def test_plural_groups_may_differ(spark):
    rows = [(1, "s", "a", 1), (2, "s", "b", 1), (3, "t", "c", 2), (4, "t", "d", 2), (5, "t", "e", None), (6, "u", "f", None), (7, "u", "f", None), (8, "v", "f", 3), (9, "x", "g", None), (10, "x", "h", None)]
    df = spark.createDataFrame(rows, "k int, source string, target string, unit_group int")
    want = set()
    for k, s, t, g in rows:
        for k2, s2, t2, g2 in rows:
            if k != k2 and not (g is not None and g == g2):
                want |= {(k, "consistency.target_differs")} if s == s2 and t != t2 else set()
                want |= {(k, "consistency.source_differs")} if t == t2 and s != s2 else set()
    assert {tuple(x) for x in qa.inconsistent(df, ["k"], ["unit_group"]).collect()} == want


def test_audit_snapshots(spark):
    log = spark.createDataFrame([(i, "u1", "name", i % 2, f"d{i}") for i in range(6)], "id long, actor string, actor_label string, tenant_id int, detail string")
    after = audit.erased(log, "u1").where("id <> 2").withColumn("detail", F.when(F.col("id") == 4, "x").otherwise(F.col("detail")))
    assert {tuple(x) for x in audit.forbidden_changes(log, after).collect()} == {(2, "deleted"), (4, "updated")}
    assert [x.id for x in audit.page_of(log, 1, 5, 1).collect()] == [3]


@pytest.mark.parametrize("size", [8 << 20, 200])
def test_vectors_meet_in_blocks(spark, monkeypatch, size):
    """Against a plain product; with a third of equal vectors, rows without one, and queries that are rows."""
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    rng = random.Random(size)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else None if i % 17 == 1 else [float(rng.randint(-4, 4)) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.dot) for r in search.top_by_dot(df, df.where("vec_id % 10 = 0"), 4).collect()}
    vectors = {i: v for i, v in rows if v}
    want = {}
    for q in (i for i in vectors if i % 10 == 0):
        best = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))[:4]
        want |= {(q, n): (i, -d) for n, (d, i) in enumerate(best, 1)}
    assert got == want
    assert search.top_by_dot(df, df.where("false"), 4).collect() == []


def test_cascade_places_targets(spark):
    """Exact and fuzzy matches on the segment's own tags, donors from other tags, hidden tags carried."""
    text = lambda v: ("text", v, None, None)
    bold = [(4, "b", True, "run", "<b>", "</b>"), (5, "other", False, "block", "<mark/>", "")]
    pair = lambda n, v, k=None: [("open", None, n, k), text(v), ("close", None, n, None)]
    rows = [
        (1, "one two three four", pair(4, "one two three four") + [("ph", None, 5, None)], bold, False, None), (2, "one two three five", pair(4, "one two three five"), bold, False, None), (3, "lonely", [text("lonely")], [], False, None),
        (4, "known", pair(1, "known"), [(1, "b", True, "run", "<b>", "</b>")], True, pair(1, "bekannt")), (5, "known", pair(4, "known"), bold, False, None), (6, "known", [text("known")], [], False, None), (7, "empty", [text("empty")], [], True, None), (8, "empty", [text("empty")], [], False, None),
    ]
    df = spark.createDataFrame([(k, p, p, t, f, c, x) for k, p, t, f, c, x in rows], f"k int, plain string, hash string, tokens {K.TOKENS}, formats {K.FORMATS}, confirmed boolean, target {K.TOKENS}")
    memory = spark.createDataFrame([(9, "one two three four", "one two three four", 1, 3, "x", pair(1, "eins zwei", "b"))], f"tu_id long, plain string, hash string, priority int, quality int, updated_at string, tokens {K.TOKENS}")
    got = {r.k: (r.outcome, r.status, r.target and [tuple(x)[:3] for x in r.target], r.tags_matched) for r in pretranslated_targets(df, memory, ["k"]).collect()}
    strip = lambda xs: [x[:3] for x in xs]
    assert got == {
        1: ("exact", "translated", strip(pair(4, "eins zwei") + [("ph", None, 5)]), True), 2: ("fuzzy", "draft", strip(pair(4, "eins zwei")), True), 3: ("unmatched", None, None, None), 4: ("skipped", None, None, None),
        5: ("propagated", "draft", strip(pair(4, "bekannt")), True), 6: ("propagated", "draft", strip([text("bekannt")]), True), 7: ("skipped", None, None, None), 8: ("unmatched", None, None, None),
    }


def test_single_words_are_found_as_searched_forms_are(spark):
    """Forms of one word meet the words of a text; a form of several words brings the search back, with the same rules."""
    rows = [(1, "the file", "filess files"), (2, "a file", "re-files now"), (3, "files", "a file set of files"), (4, "file", "filé filé"), (5, "filé", "x"), (6, "profile", "x")]
    df = spark.createDataFrame(rows, "k int, source string, target string")
    got = []
    for other in ("filed", "files now"):
        terms = spark.createDataFrame([("file", "file set", "files", [other])], "term string, preferred string, forbidden string, alternatives array<string>")
        got.append({(r.k, r.kind, r.found) for r in glossary.term_mismatch(df, terms, ["k"], "en", "en").collect()})
    lone = spark.createDataFrame([("file", "dossier", "files", ["filed"])], "term string, preferred string, forbidden string, alternatives array<string>")
    assert got[0] == {(1, "forbidden", "files"), (2, "forbidden", "files"), (3, "forbidden", "files"), (4, "missing_preferred", None)}
    assert got[1] == {(1, "forbidden", "files"), (2, "missing_preferred", "files now"), (3, "forbidden", "files"), (4, "missing_preferred", None)}
    assert {(r.k, r.kind, r.found) for r in glossary.term_mismatch(df, lone, ["k"], "en", "en").collect()} == got[0]
    # Texts of single-word glossaries are not searched by substrings, and a small glossary shuffles none of them.
    plan = glossary.term_mismatch(df, lone, ["k"], "en", "en")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_products_stay_within_their_bound_and_equal_vectors_tie(spark, monkeypatch):
    """No product of a whole block by a whole block, and copies of a vector come in order of their id wherever they lie."""
    import numpy as np

    monkeypatch.setattr(search, "BLOCK_BYTES", 1 << 14)
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 8))
    df = spark.createDataFrame([(i, [float(x) for x in base[i % 40]]) for i in range(1200)], "vec_id long, embedding array<double>")
    got = {}
    for x in search.top_by_dot(df, df.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.dot))
    dots = base @ base.T
    for q, hits in got.items():
        order = sorted((i for i in range(1200) if i != q), key=lambda i: (-round(dots[q % 40, i % 40], 9), i))
        assert [i for _, i, _ in sorted(hits)] == order[:5]
    assert len(got) == 60
