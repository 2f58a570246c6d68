"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from twintext.llm.repeats import remove_repeats, repeated_windows


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(40), prose(60)
    rows = [(i, prose(r.randint(0, 60))) for i in range(20)]
    rows += [(20 + i, prose(r.randint(0, 10)) + passage[r.randint(0, 5) :] + prose(r.randint(0, 10))) for i in range(25)]
    rows += [(50 + i, base[:k] + "#" + base[k:]) for i, k in enumerate(r.sample(range(len(base)), 6))]
    rows += [(60, "x" * 500), (61, "x" * 41 + "y"), (62, "ab" * 200), (63, None), (64, ""), (65, prose(3)), (None, base), (None, base), (66, base), (66, base), (67, "line of text here\n" * 30)]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 512), (2, 4), (3, 2)])
def test_matches_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, pieces int")
    got = remove_repeats(docs, length=40, letter=10, hot=hot).drop("pieces").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 40)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr("twintext.llm.storage.BROADCAST_BYTES", -1)
    rows = corpus(4)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, letter=10, hot=4).drop("pieces").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 40)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merged_transforms_find_repeated_windows():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(12, 40))) for _ in range(60)]
    seen = Counter(t[p : p + 12] for t in texts for p in range(len(t) - 11))
    got = repeated_windows([np.frombuffer(t, np.uint8) for t in texts], 12, 3)
    assert [list(g) for g in got] == [[seen[t[p : p + 12]] > 1 for p in range(len(t) - 11)] for t in texts]
