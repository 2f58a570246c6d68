"""Removal of byte strings that occur elsewhere in the corpus, by merged Burrows-Wheeler transforms.

A string of ``length`` bytes is repeated if it also starts at another place of
any text. Three steps find all places where a repeated string starts:

1. Each window of ``length`` bytes has one anchor, the rightmost least hash of
   its grams. It depends on the window alone, so equal windows have equal
   anchors at equal offsets, and windows whose anchor occurs once are unique.
2. Windows of anchors that occur again are dealt by anchor. Each task reads its
   contexts as strings of letters (hashes of ``LETTER`` bytes, one string for
   each residue), builds the BWTs of bounded shards and merges them by
   refining their interleaving, one letter deeper each round, without sorting
   the suffixes again. Blocks of the interleaving that share the first
   ``length / LETTER`` letters are the repeated intervals.
3. The repeated windows of a text are united and their bytes cut out.

Equal whole texts enter once. An anchor with more than ``HOT`` occurrences is
split by the bytes that neighbouring windows share, and what is still hot then
by the windows themselves, so no task gets a group larger than ``HOT``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.llm.arrays import mixed, powers, row_blocks, utf8
from twintext.llm.storage import join_checked, materialise, per_shard

LENGTH = 400
#: Bytes of a gram and of a letter of the transforms; LENGTH is a multiple.
LETTER = 100
#: Most occurrences of an anchor that one task compares.
HOT = 512
#: Windows of a hot anchor that are dealt together.
CELL = 64
#: Bytes of contexts whose transforms are merged at once; a group of one anchor is not divided.
BATCH = 1 << 16
SHARDS = 256
_INVERSE = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, by their first byte."""
    n = len(data) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[: len(data)], out=sums[1:])
    scale = np.full(n, _INVERSE)
    scale[0] = 1
    return mixed((sums[width:] - sums[:n]) * np.multiply.accumulate(scale))


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost least value in each window, from the minima of blocks."""
    n = len(h)
    full = -(-n // width) * width
    x = np.full(full, np.uint64(2**64 - 1))
    x[:n] = h
    at = np.arange(full).reshape(-1, width)
    x = x.reshape(-1, width)
    head = np.minimum.accumulate(x, axis=1)
    head_at = np.maximum.accumulate(np.where(x == head, at, 0), axis=1).ravel()
    back = x[:, ::-1]
    tail = np.minimum.accumulate(back, axis=1)
    first = np.ones(back.shape, bool)
    first[:, 1:] = back[:, 1:] < tail[:, :-1]
    tail_at = np.minimum.accumulate(np.where(first, at[:, ::-1], full), axis=1)[:, ::-1].ravel()
    k = n - width + 1
    head, tail = head.ravel(), tail[:, ::-1].ravel()
    return np.where(head[width - 1 : n] <= tail[:k], head_at[width - 1 : n], tail_at[:k])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor hash: row, first and last window, anchor's place, hash, occurrences.

    Places count from the text's start. Neighbouring anchors of equal hash
    (periodic text) are one run of several occurrences.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = window_hashes(data, gram)
    least = sliding_argmin(h, length - gram + 1)
    row = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + length <= offsets[row + 1]
    p, m, row = np.flatnonzero(inside), least[inside], row[inside]
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    moved = np.ones(len(p), bool)
    moved[1:] = m[1:] != m[:-1]
    new = np.ones(len(p), bool)
    new[1:] = (h[m[1:]] != h[m[:-1]]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(p)) - 1
    start = offsets[row[begin]]
    return row[begin], p[begin] - start, p[end] - start, m[begin] - start, h[m[begin]], np.add.reduceat((moved | new).astype(np.int64), begin)


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of uint32 keys, by radix over 16 bits."""
    order = np.argsort((keys & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    if len(keys) and keys.max() > 0xFFFF:
        order = order[np.argsort((keys[order] >> np.uint32(16)).astype(np.uint16), kind="stable")]
    return order


class Shard:
    """The BWT of some strings: rows in suffix order, and the letter before each.

    ``letters`` are ranks from 1 of all strings end to end, each string's
    letters ``stride`` apart within its context; ``bounds`` are the contexts.
    """

    def __init__(self, letters: np.ndarray, bounds: np.ndarray, stride: int):
        n, sizes = len(letters), np.diff(bounds)
        chains = np.minimum(sizes, stride)
        at = np.arange(n) - np.repeat(bounds[:-1], sizes)
        first = at < stride
        # One row of an empty suffix for each string, after those of the letters.
        ends = n + np.concatenate([[0], np.cumsum(chains)])
        before = np.where(first, np.repeat(ends[:-1], sizes) + at, np.arange(n) - stride)
        of = np.repeat(np.arange(len(sizes)), chains)
        residue = np.arange(len(of)) - (ends[of] - n)
        last = bounds[of] + residue + (sizes[of] - 1 - residue) // stride * stride
        before = np.concatenate([before, last])
        ranks = np.append(letters, np.zeros(len(of), np.uint32)).astype(np.uint32)
        preceding = ranks[before]
        order = np.arange(n + len(of))
        for _ in range(int(-(-sizes.max() // stride)) + 1 if n else 0):
            order = before[order][_stable_order(preceding[order])]
        self.rows, self.bwt = order, preceding[order]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaving of the shards' rows after ``depth`` refinements, and the block of each row.

    Rows in one block agree in their first ``depth`` letters.
    """
    source = np.repeat(np.arange(len(shards), dtype=np.int32), [len(s.rows) for s in shards])
    block = np.zeros(len(source), np.int32)
    for _ in range(depth):
        letter = np.empty(len(source), np.uint32)
        for i, s in enumerate(shards):
            letter[source == i] = s.bwt
        order = _stable_order(letter)
        letter, old = letter[order], block[order]
        new = np.zeros(len(source), np.int32)
        new[1:] = (letter[1:] != letter[:-1]) | (old[1:] != old[:-1])
        source, block = source[order], np.cumsum(new, dtype=np.int32)
    return source, block


def repeated_windows(contexts: list[np.ndarray], length: int, letter: int, n_shards: int = 4) -> list[np.ndarray]:
    """Of each context, whether each of its windows occurs again in any of them."""
    sizes = np.array([len(c) for c in contexts])
    data = np.concatenate(contexts)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = window_hashes(data, letter)
    counts = sizes - letter + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(bounds[-1]) + np.repeat(starts[:-1] - bounds[:-1], counts)
    _, ranks = np.unique(hashes[place], return_inverse=True)
    ranks = (ranks + 1).astype(np.uint32)
    cuts = np.unique(np.linspace(0, len(contexts), min(n_shards, len(contexts)) + 1).astype(int))
    shards = [Shard(ranks[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], letter) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    source, block = merge(shards, length // letter)
    window = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) <= np.repeat(counts - 1 - (length - letter), counts)
    of_block, place = [], []
    for i, (s, a, b) in enumerate(zip(shards, cuts[:-1], cuts[1:], strict=True)):
        real = s.rows < bounds[b] - bounds[a]
        place.append(s.rows[real] + bounds[a])
        of_block.append(block[source == i][real])
    place, of_block = np.concatenate(place), np.concatenate(of_block)
    keep = window[place]
    place, of_block = place[keep], of_block[keep]
    again = np.zeros(bounds[-1], bool)
    again[place] = np.bincount(of_block, minlength=int(block[-1]) + 1)[of_block] > 1
    return [again[bounds[i] : bounds[i] + sizes[i] - length + 1] for i in range(len(contexts))]


def _true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_RUNS = "key binary, first int, last int"
_CONTEXT = "key binary, place int, kind int, g long, bytes binary"
#: How the windows of an anchor are dealt: together, by cells, or one by one (hot anchors that neighbour themselves).
WHOLE, CELLS, SINGLE = 0, 1, 2


def _find_anchors(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in row_blocks(offsets):
                row, lo, hi, m, h, n = anchor_runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row + i)), pa.array(h.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (lo, hi, m, n)]], names=["key", "g", "lo", "hi", "m", "n"])

    return find


def _contexts(length: int):
    """The bytes of each anchor's windows; those of hot anchors by cells of windows."""
    cell = min(CELL, length // 4)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "place", "kind", "g", "bytes"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, text, anchors in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("anchors").to_pylist(), strict=True):
                t = text.as_py().encode()
                for a in anchors:
                    lo, hi, m = a["lo"], a["hi"], a["m"]
                    if a["kind"] != CELLS:
                        rows.append((key, lo, a["kind"], a["g"], t[lo : hi + length]))
                        p = hi + 1
                    else:
                        p = lo
                    while p <= hi:  # a window's cell is fixed by its distance to the anchor
                        c = (m - p) // cell
                        first, last = m - (c + 1) * cell + 1, m - c * cell
                        q = min(hi, last)
                        rows.append((key, p, CELLS, xxhash.xxh64_intdigest(t[last : first + length], c) - (1 << 63), t[p : q + length]))
                        p = q + 1
                    size += len(rows[-1][4]) + 64
                    if size > 1 << 22:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    return find


def _merge_groups(length: int, letter: int):
    """Merges the transforms of whole groups, some at a time. Rows come in order of their group."""

    def solve(keys: list, places: list, contexts: list) -> pa.RecordBatch | None:
        out = ([], [], [])
        for key, place, flags in zip(keys, places, repeated_windows(contexts, length, letter), strict=True):
            first, last = _true_runs(flags)
            out[0].extend([key] * len(first))
            out[1].append(first + place)
            out[2].append(last + place)
        if out[0]:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *[pa.array(np.concatenate(x), pa.int32()) for x in out[1:]]], names=["key", "first", "last"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, contexts, size, group = [], [], [], 0, None
        for batch in batches:
            for key, place, g, text in zip(*[batch.column(c).to_pylist() for c in ("key", "place", "g", "bytes")], strict=True):
                if g != group and size > BATCH:
                    if (found := solve(keys, places, contexts)) is not None:
                        yield found
                    keys, places, contexts, size = [], [], [], 0
                group = g
                keys.append(key)
                places.append(place)
                contexts.append(np.frombuffer(text, np.uint8))
                size += len(text)
        if keys and (found := solve(keys, places, contexts)) is not None:
            yield found

    return find


def _windows(length: int):
    """The 128-bit hash of each window of a context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, text in zip(*[batch.column(c).to_pylist() for c in ("key", "place", "bytes")], strict=True):
                n = len(text) - length + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + length]) for i in range(n)), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(np.arange(n) + place, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["key", "place", "a", "b"])

    return find


def _kept_pieces(length: int):
    """Unites each text's repeated windows; returns the pieces that stay (start, bytes; the last is open)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, removed, spans = [], [], []
            for runs in batch.column("runs").to_pylist():
                runs = sorted((r["first"], r["last"] + length) for r in runs)
                kept, end, gone, n = [], 0, 0, 0
                for a, b in runs:
                    if a > end or not n:
                        if a > end:
                            kept.append({"start": end, "n": a - end})
                        n, gone, end = n + 1, gone + b - a, b
                    elif b > end:
                        gone, end = gone + b - end, b
                pieces.append([*kept, {"start": end, "n": (1 << 31) - 2 - end}])
                removed.append(gone)
                spans.append(n)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(pieces, kind), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["key", "pieces", "removed", "spans"])

    return find


def repeated_runs(texts: DataFrame, length: int = LENGTH, letter: int = LETTER, hot: int = HOT) -> DataFrame:
    """Runs of windows (key, first, last) that occur again in ``texts`` (key binary, text), as places of first bytes."""
    if length % letter or length < 2 * letter:
        raise ValueError("length is a multiple of letter, twice at least")
    big = texts.where(F.octet_length("text") >= length)
    anchors = materialise(big.mapInArrow(_find_anchors(length, letter), "key binary, g long, lo int, hi int, m int, n int"), "repeat-anchors")
    again = anchors.groupBy("g").agg(F.sum("n").alias("__n"), F.max("n").alias("__most")).where("__n > 1")
    again = again.select("g", F.when(F.col("__n") <= hot, WHOLE).when(F.col("__most") == 1, CELLS).otherwise(SINGLE).alias("kind"))
    again = materialise(again, "repeat-groups")
    shard = F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int")
    found = join_checked(anchors, again, ["g"], lambda: per_shard(anchors.withColumn("__shard", shard), again, ["g"]))
    per_text = materialise(found.groupBy("key").agg(F.collect_list(F.struct("g", "lo", "hi", "m", "kind")).alias("anchors")), "repeat-texts")
    contexts = materialise(join_checked(big, per_text, ["key"], row_bytes=F.size("anchors") * 32 + 64).select("key", "text", "anchors").mapInArrow(_contexts(length), _CONTEXT), "repeat-contexts", compression="zstd")

    cells = contexts.where(F.col("kind") == CELLS).withColumn("__shard", shard)
    sizes = materialise(cells.groupBy("g", "__shard").count().groupBy("g").agg(F.sum("count").alias("__n")).where("__n > 1"), "repeat-cells")
    sized = per_shard(cells, sizes, ["g"])
    small = contexts.where(F.col("kind") == WHOLE).select("key", "place", "g", "bytes").unionByName(sized.where(F.col("__n") <= hot).select("key", "place", "g", "bytes"))
    runs = small.repartition("g").sortWithinPartitions("g").mapInArrow(_merge_groups(length, letter), _RUNS)
    single = contexts.where(F.col("kind") == SINGLE).select("key", "place", "bytes").unionByName(sized.where(F.col("__n") > hot).select("key", "place", "bytes"))
    if single.limit(1).count():
        each = single.mapInArrow(_windows(length), "key binary, place int, a long, b long")
        each = materialise(each.withColumn("__shard", shard), "repeat-windows", compression="zstd")
        counts = each.groupBy("a", "b", "__shard").count().groupBy("a", "b").agg(F.sum("count").alias("__n")).where("__n > 1").drop("__n")
        runs = runs.unionByName(per_shard(each, counts, ["a", "b"]).select("key", F.col("place").alias("first"), F.col("place").alias("last")))
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, letter: int = LETTER, hot: int = HOT) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which also starts anywhere else.

    Returns one row per document: the id, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and ``pieces`` (start
    and bytes of what stays, or null where all stays).

    Texts are UTF-8 bytes, null is empty, and shorter texts than ``length``
    stay whole. Copies of a whole text of at least that length are removed
    from all rows, repeated rows and null ids included. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    by_text = materialise(rows.select("key", "id", F.octet_length("text").alias("n")).where(F.col("n") >= length).groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")), "repeat-keys")
    copies = by_text.groupBy("key").agg(F.min("id").alias("__rep"), F.sum("n").alias("__n")).where("__n > 1")
    copies = materialise(copies.select("key", "__rep", F.lit(True).alias("__copy")), "repeat-copies")
    marked = join_checked(rows, copies, ["key"], how="left").withColumn("__copy", F.coalesce("__copy", F.lit(False)))
    # Copies enter once, as the row of the least id.
    texts = marked.where(~F.col("__copy") | F.col("id").eqNullSafe(F.col("__rep"))).select("key", "text")
    runs = repeated_runs(texts, length, letter, hot)
    cuts = materialise(runs.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs")).mapInArrow(_kept_pieces(length), "key binary, pieces array<struct<start:int,n:int>>, removed long, spans long"), "repeat-cuts")
    out = join_checked(marked, cuts, ["key"], how="left", row_bytes=F.size("pieces") * 16 + 64)
    raw = F.encode("text", "utf-8")

    def glued(pieces: Column) -> Column:
        parts = F.transform(pieces, lambda x: F.substring(raw, x["start"] + 1, x["n"]))
        return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))

    size = F.length(raw).cast("long")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n")))
    pieces = F.when(F.col("__copy"), whole).otherwise(F.col("pieces"))
    return out.select(
        F.col("id").alias(id_col), size.alias("n_bytes"),
        F.when(F.col("__copy"), size).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("__copy"), F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("__copy"), F.sha2(F.lit(b""), 256)).when(F.col("pieces").isNotNull(), F.sha2(glued(F.col("pieces")), 256)).otherwise(F.sha2(raw, 256)).alias("kept_sha256"),
        pieces.alias("pieces"),
    )
