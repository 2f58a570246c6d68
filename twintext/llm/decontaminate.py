"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage by ``budget(n)`` word edits.
It is cut into one piece more than that, so one piece at least is intact in
any passage within the budget. Hashes of all word strings of the pieces'
lengths are looked up in the items' pieces; around each hit, Myers'
bit-parallel search over words finds the least distance of the item to any
passage there.

Items are read in blocks of bounded size, each broadcast and held against all
documents in one pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintext.llm.arrays import lowered, mixed, powers, row_blocks, rows_of, tokens, utf8

#: Share of an item's words that may be edited.
ERROR_RATE = 0.2
#: Most words of the items that are broadcast at once (a single longer item is alone in its block).
BLOCK_WORDS = 2_000_000
_FILTER_BITS = 20

HIT = "item_id {kind}, distance int, budget int, words int, last_word int"


def budget(n: int, rate: float) -> int:
    return int(n * rate + 1e-9)


def search_distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and the place where the first such part ends.

    Myers' bit-parallel algorithm over integers of len(pattern) bits.
    """
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best, end = m, -1
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = (down | ~(diagonal | up)) & ones, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & ones, (minus << 1) & ones
        up, down = (minus | ~(diagonal | plus)) & ones, plus & diagonal
        if score < best:
            best, end = score, j
    return best, end


class Pieces:
    """Pieces of a block of items, by hash of their words."""

    def __init__(self, ids: pa.Array, texts: pa.Array, rate: float):
        self.ids, self.kind, self.rate, self.items = ids.to_pylist(), ids.type, rate, []
        data, offsets = utf8(lowered(texts))
        words, starts, _ = tokens(data, offsets)
        bounds = np.searchsorted(rows_of(starts, offsets), np.arange(len(offsets)))
        by_length: dict[int, list] = defaultdict(list)
        for k in range(len(self.ids)):
            item = words[bounds[k] : bounds[k + 1]]
            self.items.append(item.tolist())
            n, parts = len(item), budget(len(item), rate) + 1
            for p in range(parts if n else 0):
                a, b = p * n // parts, (p + 1) * n // parts
                by_length[b - a].append((gram_hashes(item[a:b], b - a)[0], k, a))
        self.tables = {}
        for size, rows in by_length.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables[size] = (bits, keys, [r[1] for r in rows], [r[2] for r in rows])

    def hits(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, place where the item would start) of each intact piece."""
        for size, (bits, keys, items, at) in self.tables.items():
            h = gram_hashes(words, size)
            i = np.flatnonzero(bits[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            i = i[row[i] == row[i + size - 1]]
            first, last = np.searchsorted(keys, h[i], "left"), np.searchsorted(keys, h[i], "right")
            for j, a, b in zip(i[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
                for k in range(a, b):
                    yield int(row[j]), items[k], j - at[k]

    def find(self, column: pa.Array) -> list[list[tuple]]:
        """Per text, its hits: item, distance, budget, words, last word."""
        data, offsets = utf8(lowered(column))
        out: list[list[tuple]] = [[] for _ in range(len(column))]
        for i, j in row_blocks(offsets):
            o = offsets[i : j + 1] - offsets[i]
            words, starts, _ = tokens(data[offsets[i] : offsets[j]], o)
            row = rows_of(starts, o)
            near: dict[tuple[int, int], set] = defaultdict(set)
            for r, item, place in self.hits(words, row):
                near[r, item].add(place)
            if not near:
                continue
            bounds = np.searchsorted(row, np.arange(len(o)))
            for (r, item), places in sorted(near.items()):
                pattern, (lo, hi) = self.items[item], bounds[r : r + 2]
                e, best = budget(len(pattern), self.rate), None
                for a, b in _united(places, e, len(pattern)):
                    a = max(a, lo)
                    d, end = search_distance(pattern, words[a : min(b, hi)].tolist())
                    if d <= e and (best is None or d < best[0]):
                        best = (d, int(a + end - lo))
                if best is not None:
                    out[i + r].append((self.ids[item], best[0], e, len(pattern), best[1]))
        return out


def _united(places: set[int], e: int, n: int) -> Iterator[tuple[int, int]]:
    """Windows in which an item that would start near these places lies; overlapping ones are one."""
    begin = end = None
    for p in sorted(places):
        if end is not None and p - e <= end:
            end = p + n + e
        else:
            if end is not None:
                yield begin, end
            begin, end = p - e, p + n + e
    if end is not None:
        yield begin, end


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` words, by their first word."""
    n = max(0, len(words) - size + 1)
    h, p = np.zeros(n, np.uint64), powers(size)
    for k in range(size):
        h += words[k : k + n] * p[k]
    return mixed(h)


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The items in blocks of about ``block_words`` words at most."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    words = rows.agg(F.sum(F.ceil(F.length("text") / 2)).alias("n")).first()["n"] or 0
    n = -(-int(words) // block_words)
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).orderBy("id", "text").toArrow()
        if len(block):
            yield block["id"].combine_chunks(), block["text"].combine_chunks()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """All (document, item) pairs in which a passage of the text is within the item's error budget.

    Returns the id, ``item_id``, ``distance`` (least number of word edits),
    ``budget``, ``words`` (of the item) and ``last_word`` (place of the last
    word of the first nearest passage).

    Words are runs of ASCII letters, digits and other characters beyond ASCII,
    in lower case. A null or wordless text has no hit, a null or wordless item
    hits nothing, an item too short for an edit must occur as it is. Repeated
    rows each give their hits; other columns are ignored.
    """
    kind = items.select(item_col).schema[0].dataType
    id_kind = docs.select(id_col).schema[0].dataType
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = f"__id {id_kind.simpleString()}, {HIT.format(kind=kind.simpleString())}"
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in item_blocks(items, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Pieces(ids, texts, rate))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.find(batch.column("__text"))
                rows = [i for i, hits in enumerate(found) for _ in hits]
                if rows:
                    item, *rest = zip(*(h for hits in found for h in hits), strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(rows)), pa.array(item, shared.value.kind), *[pa.array(x, pa.int32()) for x in rest]], names=["__id", "item_id", "distance", "budget", "words", "last_word"])

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out.withColumnRenamed("__id", id_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The documents, all columns, without those that ``contamination`` finds."""
    for ids, texts in item_blocks(items, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Pieces(ids, texts, rate))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.find(batch.column(text_col))
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs

