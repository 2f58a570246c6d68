"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of a bounded sample per language are summed by Spark; the matrix of log
probabilities (languages by buckets) is broadcast, and batches are scored by
looking up the buckets of all their n-grams at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.llm.arrays import row_blocks, row_sums, utf8

BITS = 15
ORDERS = (1, 2, 3)
#: Expected number of documents per language that the model learns from, chosen by hash of the id.
DOCS_PER_LANG = 2_000
#: Most languages that a model tells apart (its table holds them times the buckets); more are an error.
MAX_LANGS = 1_000
UNKNOWN = "und"

_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])
_MULT = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts (non-letters as a space), row bounds, and which rows have a letter."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _ALPHA[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        letter[points == c] = chr(c).isalpha()
    return np.where(letter, points, np.uint32(32)), bounds, row_sums(letter, bounds) > 0


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position but the last order - 1."""
    h = np.full(max(0, len(points) - order + 1), order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ points[i : i + len(h)]) * _MULT[i % 3]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BITS)


def _text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    _, offsets = utf8(column)
    for i, j in row_blocks(offsets):
        yield i, j, *code_points(column.slice(i, j - i))


def _grams(points: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and bounds of those that lie within one text."""
    found = buckets(points, order)
    ends = np.maximum(bounds[:-1], np.minimum(bounds[1:] - order + 1, len(found)))
    return found, np.column_stack([np.minimum(bounds[:-1], len(found)), np.minimum(ends, len(found))])


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, best = [], []
        for _, _, points, bounds, lettered in _text_blocks(column):
            total = np.tile(self.log_prior, (len(bounds) - 1, 1))
            for order in ORDERS:
                found, spans = _grams(points, bounds, order)
                for k in range(len(self.langs)):
                    sums = np.concatenate([[0], np.cumsum(self.log_prob[k][found], dtype=np.float64)])
                    total[:, k] += sums[spans[:, 1]] - sums[spans[:, 0]]
            if not self.langs:
                lettered[:] = False
                total = np.zeros((len(lettered), 1))
            top = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names += [self.langs[k] if ok else UNKNOWN for k, ok in zip(top, lettered, strict=True)]
            best.append(np.where(lettered, share, 0.0))
        return names, np.concatenate(best) if best else np.zeros(0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (lang, bucket, n) over a whole partition; its size is bounded by languages times buckets."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("__lang").to_pylist()
        for i, _, points, bounds, _ in _text_blocks(batch.column("__text")):
            for order in ORDERS:
                found, spans = _grams(points, bounds, order)
                for r, (a, b) in enumerate(spans):
                    if b > a:
                        total = totals.setdefault(langs[i + r], np.zeros(1 << BITS, np.int64))
                        total += np.bincount(found[a:b], minlength=1 << BITS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])


def fit_language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, alpha: float = 0.5) -> LanguageModel:
    """Learns from rows with a language for which ``learn`` holds, about ``docs_per_lang`` of each language."""
    rows = docs.where(learn).where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    sizes = {r[0]: r[1] for r in rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"a model tells at most {MAX_LANGS} languages apart")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << BITS)), np.zeros(0))
    share = docs.sparkSession.createDataFrame([(k, docs_per_lang / n) for k, n in sizes.items()], "__lang string, __share double")
    place = F.pmod(F.xxhash64("__id", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(share), "__lang").where(place < F.col("__share")).select("__lang", "__text")
    counts = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), 1 << BITS))
    at = {k: i for i, k in enumerate(langs)}
    table[[at[k] for k in counts["lang"].to_pylist()], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    table += alpha
    prior = np.array([sizes[k] for k in langs], float)
    return LanguageModel(langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum()))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of every whole text: the id, ``lang_pred``, ``score``.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text for a model that learned from nothing. Ties go to the first language
    by code point. Repeated rows each give a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.score(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(names, pa.string()), pa.array(score)], names=["__id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(predicted, f"__id {kind.simpleString()}, lang_pred string, score double").withColumnRenamed("__id", id_col)
