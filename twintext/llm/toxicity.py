"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, one of toxic and one of ordinary text, share the counts to which
they back off: how many different words precede a word in either class. Each
token's log-likelihood ratio is averaged over the text and over sliding
windows, so that a few expressions in a long text still count; a logistic
curve, fitted on labelled rows that the counts have not seen, turns these
values into a score. The third is the mean of the strongest ``TOP`` tokens
by their own shared-backoff models: insults are few among the words around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.llm.arrays import lowered, mixed, row_blocks, row_sums, rows_of, tokens, utf8
from twintext.llm.storage import join_checked, materialise, sieved

#: Share of the labelled rows kept back to fit the curve.
CALIBRATION = 0.3
#: Tokens of a window.
WINDOW = 24
#: Strongest tokens whose mean is taken, and the most that one token counts.
TOP, MOST = 2, 4.0
#: Taken from each count and given to the shared backoff: what occurs no more often than this is smoothed entirely.
DISCOUNT = 4.0
#: Least occurrences of a word that the models keep a row for; rarer ones use the shared counts.
LEAST = 2
START = np.uint64(0x5BD1E995)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9DDFEA08EB382D69) ^ right, 1)


class HashTable:
    """Open addressing over 64-bit hashes: row numbers of keys, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left, slot, self.probes = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64), 0
        while len(left):
            self.probes += 1
            free = self.rows[slot] < 0
            at, who = np.unique(slot[free], return_index=True)
            who = left[free][who]
            self.keys[at], self.rows[at] = keys[who], who
            rest = self.rows[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        row = np.where(self.keys[slot] == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((row < 0) & (self.rows[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            s = slot[open_]
            hit = (self.keys[s] == keys[open_]) & (self.rows[s] >= 0)
            row[open_[hit]] = self.rows[s[hit]]
            open_ = open_[~hit & (self.rows[s] >= 0)]
        return row


@dataclass
class KneserNey:
    """Both classes' models as arrays; class 0 is ordinary, class 1 toxic."""

    words: HashTable
    pairs: HashTable
    continued: np.ndarray  # (word, class): different words before it
    shared: np.ndarray  # (word): P of the shared backoff
    rare: float  # the same for words without a row
    kinds: np.ndarray  # (class): pairs in all
    held: np.ndarray  # (class): pairs that the discount takes from words
    context: np.ndarray  # (word, class): occurrences as a context
    follows: np.ndarray  # (word, class): occurrences that the discount takes from pairs
    counts: np.ndarray  # (pair, class)
    curve: np.ndarray

    def ratios(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(token | last token, toxic) - log P(token | last token, ordinary), and the same without the last token."""
        before = np.concatenate([[START], words[:-1]])
        before[first] = START
        w, v, p = self.words.find(words), self.words.find(before), self.pairs.find(pair_hash(before, words))
        logs, lows = [], []
        for c in (0, 1):
            n = np.where(w >= 0, self.continued[w, c], 0)
            shared = np.where(w >= 0, self.shared[w], self.rare)
            low = (np.maximum(n - DISCOUNT, 0) + self.held[c] * shared) / max(self.kinds[c], 1)
            lows.append(np.log(low))
            total = np.where(v >= 0, self.context[v, c], 0)
            seen = np.where(p >= 0, self.counts[p, c], 0)
            spread = np.where(v >= 0, self.follows[v, c], 0)
            # A context without a row, or one of this class without text, is all backoff.
            logs.append(np.log(np.where(total > 0, (np.maximum(seen - DISCOUNT, 0) + np.maximum(spread, 1e-9) * low) / np.maximum(total, 1), low)))
        return np.clip(logs[1] - logs[0], -MOST, MOST), np.clip(lows[1] - lows[0], -MOST, MOST)

    def measures(self, column: pa.Array) -> np.ndarray:
        """Per text: the mean log-ratio, the largest mean over a window, and that of the strongest tokens."""
        data, offsets = utf8(lowered(column))
        out = []
        for i, j in row_blocks(offsets):
            o = offsets[i : j + 1] - offsets[i]
            words, starts, _ = tokens(data[offsets[i] : offsets[j]], o)
            of = rows_of(starts, o)
            bounds = np.searchsorted(of, np.arange(len(o)))
            sizes = np.diff(bounds)
            r, rest = self.ratios(words, bounds[:-1][sizes > 0]) if len(words) else (np.zeros(0), np.zeros(0))
            mean = row_sums(r, bounds) / np.maximum(sizes, 1)
            total = np.concatenate([[0], np.cumsum(r)])
            end = np.minimum(np.arange(len(words)) + WINDOW, bounds[of + 1])
            windows = (total[end] - total[: len(words)]) / WINDOW
            most, top = np.zeros(len(o) - 1), np.zeros(len(o) - 1)
            if len(words):
                full, begin = sizes > 0, bounds[:-1][sizes > 0]
                most[full] = np.maximum.reduceat(windows, begin)
                for k in range(TOP):  # a text of fewer tokens adds zeros
                    high = np.maximum.reduceat(rest, begin)
                    top[full] += np.where(sizes[full] > k, high, 0) / TOP
                    at = np.flatnonzero(rest == np.repeat(high, sizes[full]))
                    rest[at[np.unique(of[at], return_index=True)[1]]] = -np.inf
            out.append(np.column_stack([mean, most, top]))
        return np.concatenate(out) if out else np.zeros((0, 3))

    def score(self, column: pa.Array) -> np.ndarray:
        m = self.measures(column)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + m @ self.curve[1:], -40, 40)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring tokens with their class, one row for each occurrence."""
    for batch in batches:
        labels = batch.column("__label").to_numpy()
        data, offsets = utf8(lowered(batch.column("__text")))
        for i, j in row_blocks(offsets):
            o = offsets[i : j + 1] - offsets[i]
            words, starts, _ = tokens(data[offsets[i] : offsets[j]], o)
            if len(words):
                of = rows_of(starts, o)
                before = np.concatenate([[START], words[:-1]])
                before[np.flatnonzero(np.diff(of, prepend=-1))] = START
                yield pa.RecordBatch.from_arrays([pa.array(before.view(np.int64)), pa.array(words.view(np.int64)), pa.array(labels[i + of] > 0)], names=["v", "w", "toxic"])


def _logistic(held: DataFrame, columns: tuple[str, ...], steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression of y on the columns by Newton steps, whose sums Spark makes over all rows."""
    x, b = [F.lit(1.0), *[F.col(c) for c in columns]], np.zeros(len(columns) + 1)
    # Rounded to an integer of 1e-9 each: sums don't depend on the order of rows.
    exact = lambda c: F.sum(F.round(c * 1e9).cast("decimal(28,0)"))
    for _ in range(steps):
        z = sum((c * F.lit(float(w)) for c, w in zip(x[1:], b[1:], strict=True)), F.lit(float(b[0])))
        rows = held.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
        upper = [(i, j) for i in range(len(b)) for j in range(i, len(b))]
        sums = rows.agg(*[exact(c * (F.col("y") - F.col("p"))) for c in x], *[exact(x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i, j in upper]).first()
        if sums[0] is None:
            break
        sums = np.array([float(s) / 1e9 for s in sums])
        h = ridge * np.eye(len(b))
        for (i, j), s in zip(upper, sums[len(b) :], strict=True):
            h[i, j] += s
            h[j, i] += s * (i != j)
        move = np.linalg.solve(h, sums[: len(b)] - ridge * b)
        b += np.clip(move, -5, 5)
        if abs(move).max() < 1e-7:
            break
    return b


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> KneserNey:
    """Fits on every labelled row for which ``learn`` holds.

    Counts, and the sums of the curve's steps, are aggregated by Spark. Words
    below ``LEAST`` occurrences stay there, and so do pairs that the discount
    takes entirely: these count as unseen in the model too. What reaches the
    driver is the model, which grows with the vocabulary.
    """
    rows = labels.where(learn).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("double")).alias("__label"))
    back = F.pmod(F.xxhash64("__id", F.lit("curve")), F.lit(1000)) < int(CALIBRATION * 1000)
    chosen = rows.withColumn("__back", back)
    # Ids and digests find one row of each text; only these rows' texts are shuffled.
    chosen = materialise(chosen, "toxic-labels")
    # A null text is another than the empty one.
    named = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)), F.unhex(F.lit(""))).alias("__digest"), F.col(text_col).alias("__text"))
    judged = join_checked(named.select("__id", "__digest"), chosen, ["__id"]).groupBy("__digest", "__label", "__back").agg(F.min("__id").alias("__id"))
    judged = materialise(judged, "toxic-judged")
    keys = ["__id", "__digest"]
    texts = join_checked(named, judged, keys, lambda: sieved(named, judged, keys).join(judged, keys)).groupBy("__digest", "__label", "__back").agg(F.first("__text").alias("__text")).select("__text", "__label", "__back")
    texts = materialise(texts, "toxic-texts", compression="zstd")

    by = {c: F.count(F.when(F.col("toxic") == bool(c), F.lit(1))) for c in (0, 1)}
    pairs = texts.where(~F.col("__back")).select("__text", "__label").mapInArrow(_pairs, "v long, w long, toxic boolean")
    pairs = pairs.groupBy("v", "w").agg(by[0].alias("n0"), by[1].alias("n1"))
    pairs = materialise(pairs, "toxic-pairs", compression="zstd")
    kinds = {c: F.count(F.when(F.col(f"n{c}") > 0, F.lit(1))) for c in (0, 1)}
    words = pairs.groupBy("w").agg(kinds[0].alias("c0"), kinds[1].alias("c1"), F.count(F.lit(1)).alias("c"), F.sum(F.col("n0") + F.col("n1")).alias("n"))
    taken = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT)))
    contexts = pairs.groupBy("v").agg(taken("n0").alias("f0"), taken("n1").alias("f1"), F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum(F.col("n0") + F.col("n1")).alias("m"))
    sums = words.agg(F.sum("c0"), F.sum("c1"), taken("c0"), taken("c1"), F.sum("c"), F.count(F.lit(1))).first()
    kept = words.join(contexts, F.col("w") == F.col("v"), "full").where(f"coalesce(n, 0) >= {LEAST} or coalesce(m, 0) >= {LEAST}")
    kept = kept.select(F.coalesce("w", "v").alias("w"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("c0", "c1", "c", "f0", "f1", "t0", "t1")]).toArrow()
    often = pairs.where(f"n0 > {DISCOUNT} or n1 > {DISCOUNT}").toArrow()

    col = lambda t, *names: np.column_stack([t[c].to_numpy() for c in names]).astype(np.float64).reshape(len(t), len(names))
    key = lambda t, name: t[name].to_numpy().astype(np.int64).view(np.uint64)
    total, types = float(sums[4] or 0), float(sums[5] or 0)
    model = KneserNey(
        words=HashTable(key(kept, "w")), pairs=HashTable(pair_hash(key(often, "v"), key(often, "w"))),
        continued=np.vstack([col(kept, "c0", "c1"), [0, 0]]), shared=np.append((col(kept, "c")[:, 0] + 1) / (total + types + 1), 0), rare=1 / (total + types + 1),
        kinds=np.array([sums[0] or 0, sums[1] or 0], float), held=np.array([max(sums[2] or 0, 1), max(sums[3] or 0, 1)], float),
        context=np.vstack([col(kept, "t0", "t1"), [0, 0]]), follows=np.vstack([col(kept, "f0", "f1"), [0, 0]]), counts=np.vstack([col(often, "n0", "n1"), [0, 0]]), curve=np.zeros(4),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value.measures(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([batch.column("__label"), *[pa.array(x) for x in m.T]], names=["y", "a", "b", "c"])

    held = texts.where("__back").select("__text", "__label").mapInArrow(measured, "y double, a double, b double, c double")
    held = materialise(held.withColumn("y", (F.col("y") > 0).cast("double")), "toxic-held")
    model.curve = _logistic(held, ("a", "b", "c"))
    rates = rows.agg(F.avg((F.col("__label") > 0).cast("double")), F.count(F.lit(1))).first()
    among = held.agg(F.avg("y")).first()[0]
    share = float(np.clip(0.5 if among is None else among, 1e-3, 1 - 1e-3))
    base = float(np.clip(rates[0] if rates[1] else 0.5, 1e-3, 1 - 1e-3))
    # Equal texts count once in the curve; the intercept goes back to the share of all labels.
    model.curve[0] += np.log(base / (1 - base)) - np.log(share / (1 - share))
    return model


def score_toxicity(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every whole text: the id, ``score`` (0 to 1) and the columns in ``keep``.

    A null or empty text has no evidence and takes the curve's value at 0.
    Repeated rows each give a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    extra = [f"__keep_{c}" for c in keep]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(shared.value.score(batch.column("__text"))), *[batch.column(c) for c in extra]], names=["__id", "score", *extra])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(scored, ", ".join([f"__id {types['__id']}", "score double", *[f"{c} {types[c]}" for c in extra]]))
    return out.select(F.col("__id").alias(id_col), "score", *[F.col(f"__keep_{c}").alias(c) for c in keep])


def drop_toxic(docs: DataFrame, model: KneserNey, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(text_col)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
