"""The classifiers' arithmetic against plain Python: trees walked one by one, Bayes and Kneser-Ney by dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twintext.llm import lang_id, quality, toxicity
from twintext.llm.arrays import utf8


def test_trees_walked_one_by_one():
    r = np.random.default_rng(1)
    x = r.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality.fit_trees(x, y, n_trees=20, depth=3)
    got = model.score(x)

    def walk(row):
        margin = model.start
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            margin += leaf[node - len(f)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(got, [walk(row) for row in x]) and ((got > 0.5) == (y > 0)).mean() > 0.95


def test_statistics_by_hand():
    texts = ["a bb a\nccc dd\n\na bb a", "", "é — x", "one", "z " * 300]
    data, offsets = utf8(pa.array(texts))
    got = quality.statistics(data, offsets)
    at = {f: i for i, f in enumerate(quality.FEATURES)}
    for t, row in zip(texts, got, strict=True):
        w, lines = t.split(), [x for x in t.split("\n") if x]
        n = max(len(w), 1)
        want = {
            "log_bytes": math.log1p(len(t.encode())), "log_words": math.log1p(len(w)), "word_len": sum(len(x.encode()) for x in w) / n, "distinct_words": len(set(w)) / n,
            "same_as_last": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "distinct_pairs": len(set(zip(w, w[1:], strict=False))) / max(len(w) - 1, 1),
            "distinct_lines": len(set(lines)) / max(len(lines), 1), "top_word": max(Counter(w).values(), default=0) / n, "short_words": sum(len(x.encode()) < 4 for x in w) / n,
        }
        assert all(abs(row[at[k]] - v) < 1e-9 for k, v in want.items()), (t, {k: (row[at[k]], v) for k, v in want.items()})


def test_bayes_by_dictionaries(spark):
    r = random.Random(3)
    make = {"x": "abcdef", "y": "defghi", "z": "ghiäöü"}
    word = lambda k: "".join(r.choice(make[k]) for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word(k) for _ in range(r.randint(1, 12))) + r.choice(["", "! 7", "\n"]), k) for i, k in enumerate(r.choice("xxyz") for _ in range(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit_language(docs, F.lit(True))

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        return [t[i : i + n] for n in lang_id.ORDERS for i in range(len(t) - n + 1)]

    counts, size = defaultdict(Counter), Counter()
    for _, t, k in rows:
        counts[k].update(grams(t))
        size[k] += 1
    size_of = {k: sum(c.values()) + 0.5 * 2**lang_id.BITS for k, c in counts.items()}
    for r_ in lang_id.identify_language(docs, model).collect():
        text = rows[r_["doc_id"]][1]
        logs = {k: math.log(size[k] / len(rows)) + sum(math.log((counts[k][g] + 0.5) / size_of[k]) for g in grams(text)) for k in counts}
        best = max(sorted(logs), key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        # Hashed n-grams can collide, so close calls may differ.
        assert r_["lang_pred"] == best or share < 0.7
        assert abs(r_["score"] - share) < 0.1 or share < 0.9


def test_kneser_ney_by_dictionaries(spark):
    r = random.Random(4)
    vocabulary, bad = [f"w{i}" for i in range(40)], ["moron", "scum"]
    rows = [(i, " ".join(r.choice(vocabulary + bad * 6 * (i % 3 == 0)) for _ in range(r.randint(1, 50))), int(i % 3 == 0)) for i in range(240)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    back = {x[0] for x in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1000)) < int(toxicity.CALIBRATION * 1000)).select("doc_id").collect()}
    words = lambda t: re.findall(r"[a-z0-9]+", t)
    pairs = Counter()
    seen = set()
    for i, t, c in rows:
        if i not in back and (t, c) not in seen:
            seen.add((t, c))
            for v, w in zip(["<s>", *words(t)], words(t), strict=False):
                pairs[v, w, c] += 1
    kinds, before = Counter(), defaultdict(Counter)
    context, occurs = defaultdict(Counter), Counter()
    for (v, w, c), n in pairs.items():
        before[w][c] += 1
        kinds[c] += 1
        context[v][c] += n
        occurs[w] += n
        occurs[v, "as context"] += n
    either = {w: len({v for v, x, _ in pairs if x == w}) for w in before}
    total, types, d = sum(either.values()), len(either), toxicity.DISCOUNT
    kept = {w for w in {*before, *context} if occurs[w] >= toxicity.LEAST or occurs[w, "as context"] >= toxicity.LEAST}
    held = {c: max(sum(min(before[w][c], d) for w in before), 1) for c in (0, 1)}

    def low(w, c):
        shared = (either.get(w, 0) + 1) / (total + types + 1) if w in kept else 1 / (total + types + 1)
        return (max((before[w][c] if w in kept and w in before else 0) - d, 0) + held[c] * shared) / max(kinds[c], 1)

    def high(v, w, c):
        n = sum(m for (a, _, k), m in pairs.items() if a == v and k == c) if v in kept else 0
        if not n:
            return low(w, c)
        both = pairs[v, w, 0] + pairs[v, w, 1]
        spread = sum(min(m, d) for (a, _, k), m in pairs.items() if a == v and k == c)
        return (max((pairs[v, w, c] if both >= toxicity.LEAST else 0) - d, 0) + max(spread, 1e-9) * low(w, c)) / n

    cap = lambda x: max(-toxicity.MOST, min(toxicity.MOST, x))
    texts = [t for _, t, _ in rows[:40]] + ["", "unseen scum", "moron"]
    got = model.measures(pa.array(texts))
    for t, m in zip(texts, got, strict=True):
        w = words(t)
        ratio = [cap(math.log(high(v, x, 1)) - math.log(high(v, x, 0))) for v, x in zip(["<s>", *w], w, strict=False)]
        alone = sorted((cap(math.log(low(x, 1)) - math.log(low(x, 0))) for x in w), reverse=True)
        window = [sum(ratio[i : i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(len(w))]
        want = [sum(ratio) / max(len(w), 1), max(window, default=0), sum(alone[: toxicity.TOP]) / toxicity.TOP]
        assert np.allclose(m, want, atol=1e-6), (t, m, want)


def test_toxicity_learns_from_every_labelled_row(spark):
    """4,600 ordinary texts are more than any cap that there was: each one that isn't kept back for the curve starts one sequence."""
    import numpy as np
    from pyspark.sql import functions as F

    from twintext.llm import toxicity

    docs = spark.range(4700).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") < 100, "awful ").otherwise("kind "), F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < 100).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    back = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1000)) < int(toxicity.CALIBRATION * 1000)
    want = [docs.where(c).where(~back).count() for c in ("doc_id >= 100", "doc_id < 100")]
    start = model.words.find(np.array([toxicity.START]))[0]
    assert list(model.context[start]) == want
    assert np.isfinite(model.curve).all()


def test_toxicity_shuffles_one_row_of_each_labelled_text(spark, monkeypatch):
    """Texts without a label, and copies, meet no shuffle: a small table of ids and digests finds the rows."""
    plans, texts, write = {}, {}, toxicity.materialise

    def seen(df, name, **options):
        plans[name], out = df._jdf.queryExecution().executedPlan().toString(), write(df, name, **options)
        texts[name] = out
        return out

    monkeypatch.setattr(toxicity, "materialise", seen)
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "a b"), (3, "x y"), (4, None), (5, ""), (6, "e f"), (6, "e f"), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit_toxicity(docs, labels, F.lit(True))
        monkeypatch.setattr("twintext.llm.storage.BROADCAST_BYTES", 0)
        first = {tuple(r) for r in texts["toxic-texts"].collect()}
        assert "SortMergeJoin" not in plans["toxic-texts"]
        toxicity.fit_toxicity(docs, labels, F.lit(True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" in plans["toxic-texts"] and {tuple(r) for r in texts["toxic-texts"].collect()} == first
    assert {r[:2] for r in first} == {("a b", 1.0), ("c d", 1.0), (None, 0.0), ("", 0.0), ("e f", 0.0)}
