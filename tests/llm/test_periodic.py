"""Periodic runs against a plain search."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintext.llm import periodic
from twintext.llm.periodic import longest_exponent, periodic_runs, scan, stammered

SCHEMA = "doc_id long, text string"


def plain(words):
    """(start, length, least period) of every run."""
    n, runs = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                runs.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in runs.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4)] + ["é", "日本"]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))]
            parts += unit * rng.choice([1, 1, 2, 3, 4, 9, 30]) + unit[: rng.randint(0, len(unit))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    return [*out, "", None, " \n ", "a", "a " * 23, "a " * 24, "  " * 30, "x" * 5000, "ab " * 40000]


def rows_of(df):
    return {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"LONG_BYTES": 200, "RANGE_WORK": 300}, {"GROUP_WORDS": 50, "BLOCK_BYTES": 400}])
def test_runs_are_those_of_a_plain_search(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(periodic, k, v)
    given = texts() if not limits else texts()[:-1]
    got = rows_of(periodic_runs(spark.createDataFrame(list(enumerate(given)), SCHEMA).repartition(3)))
    for i, text in enumerate(given):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain(words) if len(words) < 10000 else [(0, 40000, 1)]
        assert got[i] == (runs, collapsed(words, runs)), i


def test_scan_of_many_arrays():
    rng = np.random.default_rng(3)
    arrays = [np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(1, 12)) for _ in range(4)]).astype(np.int32) for _ in range(60)]
    for array, runs in zip(arrays, scan(arrays), strict=True):
        assert sorted((s, n, q) for (s, n), q in runs.items()) == plain(array.tolist())


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(1, "to be " * 20), (1, "to be " * 20), (1, "or not"), (None, "a b c " * 10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit(1)).withColumn("__text", F.lit("x")).withColumn("collapsed", F.lit("y"))
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect())
    assert got == [(0, [(0, 30, 3)], "a b c"), (1, [], "or not"), (1, [(0, 40, 2)], "to be"), (1, [(0, 40, 2)], "to be")]
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_longest_exponent_takes_the_first_of_equals(spark):
    runs = [(0, 24, 8), (30, 24, 1), (60, 48, 2), (200, 24, 1)]
    df = spark.createDataFrame([(1, runs), (2, [])], "id long, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r.id: r.best for r in df.select("id", longest_exponent(F.col("runs")).alias("best")).collect()}
    assert tuple(got[1]) == (30, 24, 1) and got[2] is None


def test_stammer(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 17 * 5))) for i in range(300)] + [(None, "a b"), (301, None)]
    got = {r.doc_id: r.text for r in stammered(spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))).collect()}
    changed = 0
    for i, text in rows:
        h = zlib.crc32(str(i).encode())
        g, words = h // 10, (text or "").split()
        if i is not None and h % 10 == 0 and words:
            n = len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            text = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
            changed += text != " ".join(words)
        assert (got[i] or "").split() == (text or "").split()
    assert changed > 10
