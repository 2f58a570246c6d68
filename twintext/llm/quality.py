"""Quality scores by histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from the statistics of a bounded sample of
labelled rows, flattened into arrays (complete binary trees, level by level),
and walked for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.llm.arrays import row_blocks, row_sums, rows_of, tokens, utf8

#: Most labelled rows that a model is fitted on, the first by hash of the id.
MAX_LABELLED = 20_000

_GROUPS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9, 13), "line": (10,),
    "stop": b".", "comma": b",", "shout": b"!?", "quote": b"\"'`", "bar": b"|", "mark": b"#$%&*@^~+=<>\\/_",
    "bracket": b"()[]{}", "dash": b"-:;", "lead": range(0xC0, 256), "follow": range(0x80, 0xC0),
}
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS.values()):
    _CLASS[list(_g)] = _i
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[[10, 13]] = False

FEATURES = [*_GROUPS, "control", "log_bytes", "log_words", "word_len", "long_words", "short_words", "same_as_last", "distinct_words", "distinct_pairs", "line_len", "distinct_lines", "top_word"]


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: how many distinct hashes, and how often the commonest occurs."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[begin], counts)
    return np.bincount(r[begin], minlength=n).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    k = len(_GROUPS) + 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(row * k + _CLASS[data], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    words, starts, lengths = tokens(data, offsets, _NOT_SPACE)
    of = rows_of(starts, offsets)
    bounds = np.searchsorted(of, np.arange(n + 1))
    count = np.diff(bounds).astype(float)
    per = np.maximum(count, 1)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    distinct, top = _distinct(of, words, n)
    pairs = words[:-1] * np.uint64(31) + words[1:] if len(words) else words
    inner = of[:-1] == of[1:] if len(words) else np.zeros(0, bool)
    pair_kinds, _ = _distinct(of[:-1][inner], pairs[inner], n)
    lines, line_starts, line_lengths = tokens(data, offsets, _NOT_LINE)
    line_of = rows_of(line_starts, offsets)
    n_lines = np.bincount(line_of, minlength=n).astype(float)
    line_kinds, _ = _distinct(line_of, lines, n)
    more = [
        np.log1p(size), np.log1p(count), row_sums(lengths, bounds) / per, row_sums(lengths > 14, bounds) / per, row_sums(lengths < 4, bounds) / per,
        row_sums(same, bounds) / per, distinct / per, pair_kinds / np.maximum(count - 1, 1),
        np.bincount(line_of, line_lengths, n) / np.maximum(n_lines, 1), line_kinds / np.maximum(n_lines, 1), top / per,
    ]
    return np.column_stack([shares, *more])


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: (tree, inner node) and (tree, leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all trees are walked one level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            f = self.feature[trees, node]
            node = 2 * node + 1 + (x[np.arange(len(x))[:, None], f] > self.cut[trees, node])
        margin = self.start + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Boosts trees on the logistic loss; splits come from histograms of gradients over quantile bins."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]) if n else np.zeros((0, k), int)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, leaves))
    margin = np.full(n, start)
    flat = binned + np.arange(k) * bins
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            key = ((node - base)[:, None] * (k * bins) + flat).ravel()
            gh = [np.cumsum(np.bincount(key, np.repeat(v, k), width * k * bins).reshape(width, k, bins), axis=2) for v in (g, h)]
            total = [v[:, :1, -1:] for v in gh]
            right = [a - b for a, b in zip(total, gh, strict=True)]
            gain = gh[0] ** 2 / (gh[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(gh[1] < least) | (right[1] < least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9:
                    feature[t, base + i], cut[t, base + i] = j, edges[j][b]
            f = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += leaf[t, at]
    return Trees(feature, cut, leaf, start)


def labelled_sample(labels: DataFrame, learn: Column, label_col: str, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids: (id, __label), the first by hash; an id labelled twice takes the larger label."""
    rows = labels.where(learn).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("double")).alias("__label"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(bound)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("__text"))
        x = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_blocks(offsets)]
        x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column("__label"), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, **params) -> Trees:
    """Fits on at most ``max_labelled`` labelled rows for which ``learn`` (over the id) holds; only their statistics reach the driver."""
    chosen = labelled_sample(labels, learn, label_col, id_col, max_labelled)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = texts.select("__text", "__label").mapInArrow(_features, "y double, x array<double>").toArrow()
    x = np.stack(rows["x"].to_numpy(zero_copy_only=False)) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(x) else []
    return fit_trees(x[order], rows["y"].to_numpy()[order], **params)


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text: the id and ``score``, the probability of label 1.

    A null text counts as empty and is scored too. Repeated rows each give a
    row; other columns are ignored. A model fitted on no rows gives 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            parts = [shared.value.score(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in row_blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["__id", "score"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(scored, f"__id {kind.simpleString()}, score double").withColumnRenamed("__id", id_col)
