"""Exact dedup against a dictionary."""

import hashlib

import pytest
from pyspark.sql import functions as F

from twintext.llm import exact_dedup as module
from twintext.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "a"), (None, "c"), (6, "x" * 100_000), (7, "x" * 100_000), (8, "é"), (8, "é"), (9, "A"), (3, "c")]


def expected(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "max" else min)(ids, default=None)
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups(spark, keep):
    docs = spark.createDataFrame([(i, t, True, 1) for i, t in ROWS], "doc_id long, text string, kept boolean, group_size int")
    got = exact_dedup(docs, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS, keep)


def test_bytes_decide_when_digests_clash(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(module, "COPIES_PER_REPLICA", 2)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_dedup(docs, digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 2, "0"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS, "min")


def test_drop_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, __sha string")
    left = drop_exact_duplicates(docs, keep="max")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("text = 'a'").collect()) == [2]
    assert exact_dedup(docs.limit(0)).collect() == []


def test_filter_probes_and_runs(spark):
    """Over several runs the filter lets every digest of several rows through, and few others."""
    index = DigestIndex(spark)
    rows = [(i, f"text {i % 900 if i % 3 else i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [index.flush(docs.where(f"doc_id % 3 = {k}"), "doc_id", "text") for k in range(3)]
    index.compact()
    n = {}
    for _, t in rows:
        n[t] = n.get(t, 0) + 1
    probed = [r for run in runs for r in index.probe(run).collect()]
    assert len(probed) == 3000 and all(r["__hit"] for r in probed if n[rows[r["__id"]][1]] > 1)
    single = [r["__hit"] for r in probed if n[rows[r["__id"]][1]] == 1]
    assert single and sum(single) < 0.2 * len(single)
    found = {r["__id"]: (r["__keep"], r["__n"]) for run in runs for r in index.lookup(run).collect()}
    least = {}
    for i, t in rows:
        least[t] = min(least.get(t, i), i)
    assert found == {i: (least[t], n[t]) for i, t in rows}
