"""Pigeonhole edit matching against dynamic programming."""

import random
import re

from twintext.llm.decontaminate import budget, contamination, decontaminate, search_distance


def dp(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (row[-1], -1)
    for j, c in enumerate(text):
        last, row[0] = row[:], 0
        for i, p in enumerate(pattern, 1):
            row[i] = min(last[i - 1] + (p != c), last[i] + 1, row[i - 1] + 1)
        best = min(best, (row[-1], j), key=lambda x: x[0])
    return best


def words(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())


def tables(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 5))) for _ in range(60)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(1, 40)))) for i in range(12)] + [(12, None), (13, ""), (14, "??"), (15, "Zz yy Xx ww vv uu tt"), (15, "Zz yy Xx ww vv uu tt"), (None, "q r s t u v")]
    docs = []
    for i in range(80):
        text = prose(r.randint(0, 50))
        for _ in range(r.randint(0, 2)):
            item = (r.choice(items)[1] or "").split()
            for _ in range(r.randint(0, max(1, len(item) // 4))):
                k = r.randint(0, len(item))
                item[k : k + r.randint(0, 1)] = prose(r.randint(0, 1))
            at = r.randint(0, len(text))
            text[at:at] = item
        docs.append((i, " ".join(text)))
    return [*docs, (90, None), (91, ""), (92, "xx, ZZ yy\nxx ww vv uu TT!"), (92, "xx, ZZ yy\nxx ww vv uu TT!"), (None, "q r s t u v")], items


def expected(docs, items, rate):
    out = []
    for d, t in docs:
        for k, item in items:
            p = words(item)
            if p:
                n, at = dp(p, words(t))
                if n <= budget(len(p), rate):
                    out.append((d, k, n, budget(len(p), rate), len(p), at))
    return sorted(out, key=repr)


def test_search_distance():
    r = random.Random(1)
    for _ in range(300):
        p, t = [r.randint(0, 3) for _ in range(r.randint(1, 90))], [r.randint(0, 3) for _ in range(r.randint(0, 120))]
        assert search_distance(p, t) == dp(p, t)


def test_matches_dynamic_programming(spark, monkeypatch):
    docs, items = tables(2)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in contamination(d, b).collect()), key=repr)
    assert got == expected(docs, items, 0.2)
    # One pass over the documents for each block of items gives the same.
    monkeypatch.setattr("twintext.llm.decontaminate.item_blocks.__defaults__", ("item_id", "text", 60))
    assert sorted((tuple(r) for r in contamination(d, b).collect()), key=repr) == got
    hit = {r[0] for r in got}
    assert sorted((r["doc_id"] for r in decontaminate(d, b).collect()), key=repr) == sorted((i for i, _ in docs if i not in hit), key=repr)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contamination(d, b).collect() == [] == contamination(some, b).collect()
    assert decontaminate(some, b).count() == 1
    assert contamination(d, some.withColumnRenamed("doc_id", "item_id")).collect() == []
