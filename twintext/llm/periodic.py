"""Periodic runs of words, by a scan of all lags.

A run is a stretch of words with smallest period q, of at least ``MIN_WORDS``
words and ``MIN_EXP`` periods, that no neighbouring word extends. Words are ids
in an array; for every lag q up to n / ``MIN_EXP`` the array is compared with
itself shifted by q, and the true stretches of that comparison, run-length
encoded, are the runs of period q. The same stretch also shows at multiples of
its period; the least lag is kept. (Of two periods of one such stretch the
smaller divides the greater, and both have the same maximal stretch.)

Documents are scanned many at once: texts of like lengths share one array, in
which no two documents share an id, so one vector comparison serves them all.
The work of one text grows with the square of its words. Texts of more than
``LONG_BYTES`` are therefore dealt to tasks as pairs of text and range of lags,
and the runs of the ranges are united afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.llm.arrays import row_blocks, utf8
from twintext.llm.storage import per_shard

MIN_WORDS = 24
MIN_EXP = 3
#: Longest text in UTF-8 bytes whose lags are scanned in one task.
LONG_BYTES = 1 << 16
#: Comparisons of a range of lags, and words of an array of several texts.
RANGE_WORK = 1 << 30
GROUP_WORDS = 1 << 16
#: Bytes of text that are split into words at once.
BLOCK_BYTES = 1 << 21
#: Shards of the copies of one long text.
SHARDS = 64
#: Words beside a matching one that are looked at before its stretch is measured.
NEAR = 7
WORD = r"[^\x20\x09-\x0D]+"
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII spaces."""
    return (text or "").encode().split()


def _ids(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    fresh = count()
    return np.fromiter((ids[w] if w in ids else ids.setdefault(w, next(fresh)) for w in words), np.int32, len(words))


def _stretches(equal: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Starts and lengths of the true stretches of at least ``need``: each holds every ``need``-th place once at least."""
    at = np.flatnonzero(equal[need - 1 :: need]) * need + (need - 1)
    if len(at):
        # A stretch of over 2 * NEAR reaches NEAR words to one side of any place in it.
        left, right = np.ones(len(at), bool), np.ones(len(at), bool)
        for k in range(1, NEAR + 1):
            left &= equal[at - k]
            right &= equal[np.minimum(at + k, len(equal) - 1)]
        at = at[left | right]
    if not len(at):
        return []
    gaps = np.concatenate([[-1], np.flatnonzero(~equal), [len(equal)]])
    after = np.unique(np.searchsorted(gaps, at))
    starts, lengths = gaps[after - 1] + 1, gaps[after] - gaps[after - 1] - 1
    return [(int(s), int(n)) for s, n in zip(starts, lengths, strict=True) if n >= need]


def scan(texts: list[np.ndarray], first: int = 1, last: int | None = None) -> list[dict[tuple[int, int], int]]:
    """For each array of word ids its runs at lags from ``first`` to ``last``: (start, length) -> least period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    if not len(sizes) or sizes[0] < MIN_WORDS:
        return found
    distinct = np.cumsum([0, *(int(texts[i].max()) + 1 if len(texts[i]) else 0 for i in order)])
    ids = np.concatenate([texts[i].astype(np.int64) + base for i, base in zip(order, distinct[:-1], strict=True)])
    ids = ids.astype(np.int32) if distinct[-1] < 2**31 else ids
    last = int(sizes[0]) // MIN_EXP if last is None else min(last, int(sizes[0]) // MIN_EXP)
    rising = -sizes
    for q in range(first, last + 1):
        shortest = max(MIN_WORDS, MIN_EXP * q)
        end = ends[np.searchsorted(rising, -shortest, "right") - 1]
        for start, n in _stretches(ids[q:end] == ids[: end - q], shortest - q):
            k = int(np.searchsorted(ends, start, "right"))
            found[order[k]].setdefault((start - int(begins[k]), n + q), q)
    return found


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Texts of like lengths, of at most ``GROUP_WORDS`` words together or a single one."""
    group, total = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and total + sizes[i] > GROUP_WORDS:
            yield group
            group, total = [], 0
        group.append(i)
        total += sizes[i]
    if group:
        yield group


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, one space between them, without those of a run after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, [s + q for s, _, q in runs], 1)
        np.add.at(change, [s + n for s, n, _ in runs], -1)
        words = [w for w, inside in zip(words, np.cumsum(change)[:-1], strict=True) if not inside]
    return b" ".join(words).decode()


def _listed(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return sorted((start, length, period) for (start, length), period in found.items())


def _as_structs(runs: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lags of short texts, in blocks of bounded bytes."""
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for lo, hi in row_blocks(offsets, BLOCK_BYTES):
            words = [_words(t) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            found: list = [()] * len(words)
            for group in _groups([len(w) for w in words]):
                for i, runs in zip(group, scan([_ids(words[i]) for i in group]), strict=True):
                    found[i] = _listed(runs)
            texts = pa.array([_collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([_as_structs(r) for r in found], _ARROW_RUN), texts], ["__id", "runs", "collapsed"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one text at the lags of a range."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            digest, text, first, last = (row.column(k)[0].as_py() for k in range(4))
            runs = _listed(scan([_ids(_words(text))], first, last)[0])
            yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([_as_structs(runs)], _ARROW_RUN)], ["__digest", "runs"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts with their runs at all lags: the same stretch keeps its least period."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            found: dict[tuple[int, int], int] = {}
            for r in sorted(row.column(2)[0].as_py() or [], key=lambda r: r["period"]):
                found.setdefault((r["start"], r["length"]), r["period"])
            runs = _listed(found)
            text = _collapsed(_words(row.column(1)[0].as_py()), runs)
            yield pa.RecordBatch.from_arrays([row.column(0), pa.array([_as_structs(runs)], _ARROW_RUN), pa.array([text], pa.string())], ["__id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds the periodic runs of words of whole texts.

    Words are maximal runs of characters other than ASCII spaces, numbered
    from 0. Returns one row per document: the id, ``runs`` (an array of
    ``start``, ``length`` and ``period`` by start, then period) and
    ``collapsed``: its words, one space between them, without those that a run
    holds after its first period.

    A null or empty text has no runs and collapses to an empty one. Repeated
    ids and rows each give a row; a null id stays null. Other columns are
    ignored. Words are compared exactly, by ids that one text gives them.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = f"__id {kind}, runs array<{_RUN}>, collapsed string"
    short = rows.where(F.octet_length("__text") <= LONG_BYTES).mapInArrow(_whole, out)

    long = rows.where(F.octet_length("__text") > LONG_BYTES).withColumn("__digest", F.sha2("__text", 256))
    # Equal texts are scanned once; a range of lags is about RANGE_WORK comparisons.
    once = long.groupBy("__digest").agg(F.first("__text").alias("__text")).withColumn("__n", F.regexp_count("__text", F.lit(WORD)).cast("bigint"))
    span = F.greatest(F.lit(1), F.floor(F.lit(RANGE_WORK) / F.greatest(F.lit(1), "__n"))).cast("bigint")
    lags = F.greatest(F.lit(1), F.floor(F.col("__n") / MIN_EXP)).cast("bigint")
    ranges = once.withColumn("__first", F.explode(F.sequence(F.lit(1).cast("bigint"), lags, span)))
    ranges = ranges.withColumn("__last", F.col("__first") + span - 1).repartition("__digest", "__first")
    runs = ranges.select("__digest", "__text", "__first", "__last").mapInArrow(_ranges, f"__digest string, runs array<{_RUN}>")
    runs = runs.groupBy("__digest").agg(F.flatten(F.collect_list("runs")).alias("__runs"))
    sharded = long.withColumn("__shard", F.pmod(F.xxhash64("__id"), F.lit(SHARDS)))
    whole = per_shard(sharded, runs, ["__digest"]).select("__id", "__text", "__runs").mapInArrow(_finish, out)
    return short.unionByName(whole).withColumnRenamed("__id", id_col)


def longest_exponent(runs: Column) -> Column:
    """Of runs by start, then period, the first of the greatest exact length / period; null if there are none."""
    fit = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, r: F.when(fit(best, r), r).otherwise(best))


def stammered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text of each row, with a periodic tail put into a tenth of the documents.

    With h the crc32 of the id, g = h / 10 and n words: if h % 10 is 0, each
    word i from a = g % n on becomes the word a + (i - a) % p, where
    p = 1 + (n - a) / (3 + g % 8). Rows with a null id, and all others, keep their text.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.array(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)))
    text = F.when(h % 10 == 0, F.get(F.transform(words, tail), F.lit(0))).otherwise(F.col(text_col))
    return docs.select(F.col(id_col).alias(id_col), text.alias(text_col))
