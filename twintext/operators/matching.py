"""Matching segments against memories: exact, propagated, fuzzy, and the cascade of all three."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from twintext.functions import text as T
from twintext.functions import tokens as K
from twintext.stages import materialise, numbered

#: Characters that stand for the distinct words of a pair: any row of single UTF-16 units would do.
ALPHABET = "".join(chr(0x4E00 + i) for i in range(16_384))
#: Characters that stand for words by their hashes, of four hexadecimal digits each.
FIRST_CODE, CODES = 0x3400, 0xD7FF - 0x3400
#: Words whose counts order the runs of ``fuzzy_pairs``; any number gives the same pairs.
FREQUENT = 1 << 16
#: Counters of a text's bag of words, of four bits each, which rules pairs out before their texts are moved.
BINS = 64
#: Bits of the hash of a run: two runs that share one are a candidate more, never a pair.
TOKEN_BITS = 40
# Bounds of a fuzzy threshold, and what a numeral and a tag cost.
FLOOR, CEILING, NUMBER_PENALTY, TAG_PENALTY, TAG_CAP = 50, 99, 2, 1, 5


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per line that isn't blank: the id, ``ord`` (place among all lines), ``line`` and ``keep``."""
    lines = docs.select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("ord", "line"))
    return lines.where(F.trim("line") != "")


def normalized(rows: DataFrame, col: str) -> DataFrame:
    """Adds ``plain`` and ``hash``."""
    return rows.withColumn("plain", T.normalize(F.col(col))).withColumn("hash", T.text_hash(F.col("plain")))


def _langs(rows: DataFrame, langs: tuple[str, ...]) -> DataFrame:
    """Adds the primary subtags of the language columns, by which segments and units meet."""
    return rows.withColumns({f"__{c}": T.primary_subtag(F.col(c)) for c in langs})


def exact_match(rows: DataFrame, memories: DataFrame, key: list[str], langs: tuple[str, ...] = ()) -> DataFrame:
    """The best exact hit of each segment (columns key and hash) in memories (hash, tu_id, priority, quality, updated_at).

    ``langs`` names the language columns of both sides (source and target)
    that must agree by primary subtag. The first memory by priority with a hit
    wins; in it the highest quality, then the latest change, then the least
    tu_id (a number). Retired units (``deleted``, if there is such a column)
    have no hits.
    """
    live = memories.where("not deleted").drop("deleted") if "deleted" in memories.columns else memories
    on = ["hash", *[f"__{c}" for c in langs]]
    rest = [c for c in live.columns if c not in ("hash", "priority", "quality", "updated_at", "tu_id", *langs)]
    order = F.struct((-F.col("priority")).alias("p"), F.col("quality").alias("q"), F.col("updated_at").alias("u"), (-F.col("tu_id")).alias("t"), *rest)
    best = _langs(live, langs).groupBy(*on).agg(F.max(order).alias("x"))
    best = best.select(*on, (-F.col("x.t")).alias("tu_id"), (-F.col("x.p")).alias("priority"), F.col("x.q").alias("quality"), F.col("x.u").alias("updated_at"), *[F.col(f"x.{c}").alias(c) for c in rest])
    return _langs(rows, langs).select(*key, *on).join(best, on).drop(*on[1:])


def propagation(rows: DataFrame, key: list[str], langs: tuple[str, ...] = ()) -> DataFrame:
    """The donor of each unconfirmed segment: the first confirmed one with its hash and languages (columns key, hash, confirmed)."""
    rows = _langs(rows, langs)
    on = ["hash", *[f"__{c}" for c in langs]]
    donors = rows.where("confirmed").groupBy(*on).agg(F.min(F.struct(*key)).alias("donor"))
    return rows.where("not confirmed").join(donors, on).select(*key, "hash", *[F.col(f"donor.{k}").alias(f"donor_{k}") for k in key])


def segment_context(rows: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """Hashes of the neighbouring segments of the file (null at its ends)."""
    w = Window.partitionBy(file_col).orderBy("ord")
    return rows.withColumn("prev_hash", F.lag("hash").over(w)).withColumn("next_hash", F.lead("hash").over(w))


def confirmed_context(rows: DataFrame, file_col: str = "doc_id", hash_col: str = "target_hash") -> DataFrame:
    """Target hashes of the nearest confirmed segments before and after each segment of the file.

    ``rows`` has ord, confirmed and the hash of the target. The segment that
    is being confirmed counts as one itself, so its neighbours are those of a
    log of confirmed targets with it in its place.
    """
    w = Window.partitionBy(file_col).orderBy("ord")
    known = F.when(F.col("confirmed"), F.col(hash_col))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("prev_target", before).withColumn("next_target", after)


def context_match(rows: DataFrame, memory: DataFrame, key: list[str]) -> DataFrame:
    """Segments whose hash and both neighbours equal a memory variant's (hash, prev_hash, next_hash, tu_id)."""
    m = memory.select("tu_id", *[F.col(c).alias(f"__{c}") for c in ("hash", "prev_hash", "next_hash")])
    same = (F.col("hash") == F.col("__hash")) & F.col("prev_hash").eqNullSafe(F.col("__prev_hash")) & F.col("next_hash").eqNullSafe(F.col("__next_hash"))
    return rows.join(m, same).groupBy(*key).agg(F.min("tu_id").alias("tu_id"))


def ambiguous_siblings(rows: DataFrame, file_col: str = "doc_id", group_col: str = "unit_group") -> DataFrame:
    """Segments whose hash occurs again in their unit group of the file."""
    w = Window.partitionBy(file_col, group_col, "hash")
    return rows.where(F.col(group_col).isNotNull()).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")


def words_distance(a: Column, b: Column, limit: Column | int | None = None, words: Column | None = None) -> Column:
    """Levenshtein distance over words, -1 beyond ``limit``: each distinct word of the pair becomes one character.

    A pair of more distinct words than there are characters gives null here;
    ``fuzzy_pairs`` measures such pairs word by word. ``words`` is a column of
    the pair's distinct words: with it they are not found anew for each word.
    """
    words = F.array_distinct(F.concat(a, b)) if words is None else words
    coded = lambda x: F.array_join(F.transform(x, lambda w: F.substr(F.lit(ALPHABET), F.array_position(words, w).cast("int"), F.lit(1))), "")
    found = F.levenshtein(coded(a), coded(b)) if limit is None else F.call_function("levenshtein", coded(a), coded(b), F.lit(limit).cast("int") if isinstance(limit, int) else limit.cast("int"))
    return F.when(F.size(words) <= len(ALPHABET), found)


def _long_distance(a: list[str], b: list[str], limit: int) -> int:
    """The same for pairs of any size, within a band around the diagonal."""
    if abs(len(a) - len(b)) > limit:
        return -1
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in t]) for t in (a, b))
    row = np.arange(len(y) + 1)
    for i, w in enumerate(x, 1):
        lo, hi = max(1, i - limit), min(len(y), i + limit)
        new = np.full(len(y) + 1, limit + 1)
        new[0] = i
        new[lo : hi + 1] = np.minimum(row[lo - 1 : hi] + (y[lo - 1 : hi] != w), row[lo : hi + 1] + 1)
        # An insertion adds one to the cell before: a running minimum of value less place.
        at = np.arange(lo - 1, hi + 1)
        new[lo - 1 : hi + 1] = np.minimum.accumulate(new[lo - 1 : hi + 1] - at) + at
        row = new
    return int(row[-1]) if row[-1] <= limit else -1


@F.pandas_udf(IntegerType())
def _long_distances(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([_long_distance(list(x), list(y), int(n)) for x, y, n in zip(a, b, limit, strict=True)], dtype="int32")


def edit_limit(a: Column, b: Column, least: int) -> Column:
    """Most edits with which a pair can still score ``least``."""
    return F.floor(F.greatest(F.size(a), F.size(b)) * F.lit(100 - least) / 100).cast("int")


def scored(distance: Column, a: Column, b: Column, a_numerals: Column, b_numerals: Column, least: int, tag_difference: Column | int = 0) -> Column:
    """0 to 99: the share of words that stay, less 2 for each numeral that differs in place and 1 for each tag (5 at most)."""
    longer = F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0))
    base = F.floor(F.lit(100) * (longer - distance) / longer)
    n = F.least(F.size(a_numerals), F.size(b_numerals))
    differ = F.size(F.filter(F.zip_with(F.slice(a_numerals, 1, n), F.slice(b_numerals, 1, n), lambda x, y: x != y), lambda x: x))
    tags = F.least(F.lit(TAG_CAP), F.lit(TAG_PENALTY) * (F.lit(tag_difference) if isinstance(tag_difference, int) else tag_difference))
    found = F.least(F.lit(CEILING), base - NUMBER_PENALTY * differ - tags).cast("int")
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (distance >= 0) & (found >= least), found)


def score(a: Column, b: Column, a_numerals: Column, b_numerals: Column, least: int, tag_difference: Column | int = 0) -> Column:
    """``scored`` with the distance of the words; null below ``least``."""
    return scored(words_distance(a, b, edit_limit(a, b, least)), a, b, a_numerals, b_numerals, least, tag_difference)


def _threshold(least: int) -> int:
    if not FLOOR <= least <= CEILING:
        raise ValueError(f"a threshold lies from {FLOOR} to {CEILING}")
    return least


def _shares(least: int) -> int | None:
    """From so many words on, two texts within the threshold share a pair of neighbouring words."""
    edits = lambda n: n * (100 - least) // 100
    return next((k for k in range(2, 200) if all(n - 1 - 2 * edits(n) >= 1 for n in range(k, 1000))), None) if least > 50 else None


def _mixed(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """A hash of two."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(y, "uint64")
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _missing(n: np.ndarray, q: int, least: int) -> np.ndarray:
    """How many of the tokens of a text of ``n`` words can be missing from a partner, whatever its length."""
    most = np.zeros(len(n), "int64")
    for i, k in enumerate(n):
        m = np.arange(k, k * 100 // least + 1)
        most[i] = (k - m + q * (m * (100 - least) // 100)).max()
    return most


def _prefix(q: int, n: np.ndarray, words: np.ndarray, counts: np.ndarray, langs: np.ndarray, wanted: np.ndarray, least: int) -> pa.ListArray:
    """The rarest runs of ``q`` words of each wanted text, as many as can be missing and one more, rarest first.

    Rarity is any order of runs that both sides share: here the product of the
    words' counts, then the hash. Equal runs of a text are different tokens:
    the run and how many came before.
    """
    text = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(wanted[text] & ((np.arange(len(text)) + q) <= np.repeat(np.cumsum(n), n)))
    text, token, weight = text[at], words[at], counts[at]
    if q == 2:
        token, weight = _mixed(token, words[at + 1]), weight * counts[at + 1]
    order = np.lexsort((token, text))
    same = np.r_[False, (token[order][1:] == token[order][:-1]) & (text[order][1:] == text[order][:-1])]
    place = np.arange(len(order))
    before = np.empty(len(order), "uint64")
    before[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    token = _mixed(_mixed(token, before), langs[text] + np.uint64(q))
    order = np.lexsort((token, weight, text))
    size = np.bincount(text, minlength=len(n))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    lengths, which = np.unique(n, return_inverse=True)
    kept = np.minimum(size, _missing(lengths, q, least)[which] + 1)
    # The last bit tells the runs of one word from those of two.
    values = (token[order][rank < np.repeat(kept, size)] >> np.uint64(64 - TOKEN_BITS)) << np.uint64(1) | np.uint64(q - 1)
    values = values.view("int64")
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], "int32"), pa.array(values))


def _bags(text: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """How many words of each text fall on each counter, 15 at most, two counters a byte."""
    held = np.minimum(np.bincount(text * BINS + (words % np.uint64(BINS)).astype("int64"), minlength=n * BINS), 15).astype("uint8").reshape(n, BINS)
    return held[:, ::2] << 4 | held[:, 1::2]


def _sketched(key: str, langs: list[str], frequent: dict[int, int], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows with words (w) their number, their bag, and the rarest runs of one and of two words."""
    from_ = _shares(least)
    known = np.array(sorted(frequent), "uint64")
    times = np.array([frequent[int(k)] for k in known] or [1], "float64")
    hashed = lambda x: pd.util.hash_array(np.asarray(x.to_pandas(), dtype=object), categorize=False)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield batch.slice(i, 1000)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = batch.column("w")
            n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype("int64")
            flat = w.flatten().dictionary_encode()
            which = flat.indices.to_numpy()
            distinct = hashed(flat.dictionary)
            place = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            count = np.where(known[place] == distinct, times[place], 1.0) if len(known) else np.ones(len(distinct))
            lang = np.zeros(len(n), "uint64")
            for c in langs:
                lang = _mixed(lang, hashed(batch.column(c).cast("string").fill_null("\0")))
            bags = _bags(np.repeat(np.arange(len(n)), n), distinct[which], len(n))
            # Single words of texts that can meet a short one, pairs of neighbours of all others.
            single = n < (from_ * 100 // least + 1) if from_ else n >= 0
            pairs = n >= from_ if from_ else n < 0
            runs = [_prefix(q, n, distinct[which], count[which], lang, x, least) for q, x in ((1, single), (2, pairs))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, "int32"), pa.array([x.tobytes() for x in bags], "binary"), *runs], names=[key, "n", "bag", "p1", "p2"])

    return add


def _likely(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs whose bags allow the distance: each edit takes one word from a counter and adds one to another at most."""

    def bags(column: pa.Array) -> np.ndarray:
        held = np.frombuffer(b"".join(column.to_pylist()), "uint8").reshape(-1, BINS // 2)
        return np.concatenate([held >> 4, held & 15], 1).astype("int16")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = bags(batch.column("bag_a")) - bags(batch.column("bag_b"))
            edits = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
            longer = np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()).astype("int64")
            yield batch.select(["a", "b"]).filter(pa.array(edits <= longer * (100 - least) // 100))

    return find


def _code(words: Column) -> Column:
    """A character for each word, by its hash."""
    hexes = F.transform(words, lambda w: F.hex(F.pmod(F.xxhash64(w), F.lit(CODES)) + FIRST_CODE))
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-16BE")


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: int = 75, langs: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of texts (left: a, plain; right: b, plain) that score at least ``least``: a, b, score.

    A prefix filter: an edit changes at most q runs of q words, so two texts
    within the distance that ``least`` allows share one of their rarest runs,
    of so many that the others could be missing. Pairs of neighbouring words
    are used where the texts are long enough for that, single words elsewhere.
    No pair is lost. What is rare follows from the counts of the right side's
    ``FREQUENT`` most frequent words (all others count once), so each text
    finds its own runs, and only these are shuffled. ``langs`` are columns of both
    sides whose primary subtags must agree. With ``slots`` (tags as role and
    kind; left also ``all_slots``) on both sides tags count.
    """
    _threshold(least)
    on = [f"__{c}" for c in langs]
    tagged = "slots" in left.columns and "slots" in right.columns
    words = T.fuzzy_words(F.col("plain"))
    often = right.select(F.explode(words).alias("x")).groupBy("x").count().where("count > 1").orderBy(F.desc("count"), "x").limit(FREQUENT).toPandas()
    frequent = dict(zip(pd.util.hash_array(often["x"].to_numpy(dtype=object), categorize=False).tolist(), often["count"].tolist(), strict=True))

    def prepare(df: DataFrame, key: str) -> DataFrame:
        rows = _langs(df, langs).select(key, *on, words.alias("w")).where(F.size("w") > 0)
        runs = [StructField(p, ArrayType(LongType())) for p in ("p1", "p2")]
        schema = StructType([rows.schema[key], StructField("n", IntegerType()), StructField("bag", BinaryType()), *runs])
        return materialise(rows.mapInArrow(_sketched(key, on, frequent, least), schema), "fuzzy-runs")

    l, r = prepare(left, "a"), prepare(right, "b")  # noqa: E741

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        rows = [df.select(key, F.col("n").alias(f"n_{key}"), F.posexplode(f"p{q}").alias("__rank", "token")).withColumn(f"left_{key}", F.col(f"n_{key}") - q + 1 - F.col("__rank")) for q in (1, 2)]
        return rows[0].unionByName(rows[1]).select(key, "token", f"n_{key}", f"left_{key}")

    near = f"least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {least}"
    # If this is the first token that both have, no more than what follows it is shared.
    q = "(1 + cast(token & 1 AS int))"
    enough = f"least(left_a, left_b) >= greatest(n_a, n_b) - {q} + 1 - {q} * (greatest(n_a, n_b) * {100 - least} div 100)"
    candidates = prefixes(l, "a").join(prefixes(r, "b"), "token").where(near).where(enough).select("a", "b").distinct()
    # The bags of words bound the distance from below: most candidates end here, without their texts.
    bags = lambda df, key: df.select(key, *[F.col(c).alias(f"{c}_{key}") for c in ("n", "bag")])
    both = candidates.join(bags(l, "a"), "a").join(bags(r, "b"), "b").select("a", "b", "n_a", "n_b", "bag_a", "bag_b")
    candidates = materialise(both.mapInArrow(_likely(least), StructType([l.schema["a"], r.schema["b"]])), "fuzzy-near")
    # Texts are moved as they are, and are words again where a pair has met.
    texts = {x: numbered(df, candidates.select(x).distinct(), x) if dict(df.dtypes)[x] == "bigint" else df for x, df in (("a", left), ("b", right))}
    pairs = candidates.join(texts["a"].select("a", "plain", *[c for c in ("slots", "all_slots") if tagged and c in left.columns]), "a")
    pairs = pairs.join(texts["b"].select("b", F.col("plain").alias("plain2"), *[F.col("slots").alias("slots2")] * tagged), "b")
    for x in ("", "2"):
        plain = F.col(f"plain{x}")
        pairs = pairs.withColumns({f"w{x}": T.fuzzy_words(plain), f"num{x}": T.numerals(plain)}).drop(f"plain{x}")
    if tagged:
        both = K.slot_difference(F.col("slots"), F.col("slots2"))
        pairs = pairs.withColumn("__tags", F.least(both, K.slot_difference(F.col("all_slots"), F.col("slots2"))) if "all_slots" in pairs.columns else both)
    tags = F.col("__tags") if tagged else 0
    # The distance of one character a word, by its hash, is no more than that of the words, and is it where no two words of the pair share a character.
    coded = pairs.withColumns({"code": _code(F.col("w")), "code2": _code(F.col("w2")), "__limit": edit_limit(F.col("w"), F.col("w2"), least)})
    coded = coded.withColumn("__bound", F.call_function("levenshtein", F.col("code"), F.col("code2"), F.col("__limit")))
    coded = coded.withColumn("__words", F.array_distinct(F.concat("w", "w2")))
    apart = F.size("__words") == F.size(F.array_distinct(F.split(F.concat("code", "code2"), "")))
    within = F.when((F.col("__bound") < 0) | apart, F.col("__bound")).otherwise(words_distance(F.col("w"), F.col("w2"), F.col("__limit"), F.col("__words")))
    sides = ("w", "w2", "num", "num2")
    result = lambda d: scored(d, *[F.col(c) for c in sides], least, tags).alias("score")
    measured = materialise(coded.withColumn("__d", within).select("a", "b", "__d", result(F.col("__d"))), "fuzzy-measured")
    found = measured.where(F.col("score").isNotNull()).select("a", "b", "score")
    big = measured.where("__d is null")
    if big.limit(1).count():
        limit = edit_limit(F.col("w"), F.col("w2"), least)
        found = found.unionByName(pairs.join(big.select("a", "b"), ["a", "b"], "left_semi").withColumn("__d", _long_distances("w", "w2", limit)).select("a", "b", result(F.col("__d"))).where(F.col("score").isNotNull()))
    return found


def fuzzy_match(rows: DataFrame, memory: DataFrame, key: list[str], least: int = 75, limit: int = 3, langs: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` best units (tu_id, plain, quality, updated_at) for each segment (key, plain).

    Equal texts (with equal tags) of either side are scored once. Order: score, priority of
    the memory (if it has that column; the least wins), quality, latest
    change, tu_id.
    """
    extra = [c for c in (*langs, "slots", "all_slots") if c in rows.columns]
    # Written, as both the texts and the answers read it.
    asked = materialise(rows.select(*key, "plain", *extra, _text_id("plain", *extra).alias("__text"), F.monotonically_increasing_id().alias("a")), "asked")
    texts, asked_ids = _firsts(asked, "a", ["plain", *extra])
    units = memory.where("not deleted") if "deleted" in memory.columns else memory
    own = [*langs, *[c for c in ("slots",) if c in memory.columns]]
    held = [c for c in ("priority",) if c in memory.columns]
    units = materialise(units.select("tu_id", *held, "quality", "updated_at", "plain", *own, _text_id("plain", *own).alias("__text"), F.monotonically_increasing_id().alias("b")), "units")
    known, known_ids = _firsts(units, "b", ["plain", *own])
    pairs = fuzzy_pairs(texts, known, least, langs)
    priority = F.col("priority") if "priority" in memory.columns else F.lit(None).cast("int")
    order = [F.col("priority").asc_nulls_last(), F.col("quality").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("tu_id")]
    # Units of one text score alike, so no more than ``limit`` of them are needed; a text of very many units is ranked in shards first.
    ranked = units.select("__text", "tu_id", priority.alias("priority"), "quality", "updated_at", F.pmod(F.xxhash64("tu_id"), F.lit(64)).alias("__shard"))
    for by in (["__text", "__shard"], ["__text"]):
        ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= limit)
    ranked = ranked.join(known_ids, "__text").select("b", "tu_id", "priority", "quality", "updated_at")
    best = Window.partitionBy("a").orderBy(F.col("score").desc(), *order)
    top = pairs.join(ranked, "b").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    top = top.join(asked_ids, "a").select("__text", "tu_id", "score", "rank")
    return asked.select(*key, "__text").join(top, "__text").select(*key, "tu_id", "score", "rank")


def _text_id(*columns: str) -> Column:
    """128 bits of a digest."""
    return F.unhex(F.left(F.sha2(F.to_json(F.struct(*columns)), 256), F.lit(32)))


def _firsts(rows: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of a written table with a row id ``name`` the first row (id and ``columns``) of each text (``__text``), and each text's id.

    Only digests are shuffled.
    """
    ids = materialise(rows.groupBy("__text").agg(F.min(name).alias(name)), "text-ids")
    return numbered(rows, ids.select(name), name).select(name, *columns), ids


def pretranslate(rows: DataFrame, memory: DataFrame, key: list[str], least: int | None = 75, langs: tuple[str, ...] = (), keep: tuple[str, ...] = ("plain",)) -> DataFrame:
    """Each segment's outcome: exact, tagdiff, propagated, fuzzy, unmatched or skipped, with origin, status and unit.

    ``rows`` has key, plain, hash, confirmed; ``memory`` has tu_id, plain,
    hash, priority, quality, updated_at. Confirmed segments are skipped, and
    so are those with ``protected`` or ``sibling`` set (where ``rows`` has
    those columns): plural forms of one string want different targets. With
    ``tokens`` and ``formats`` in the rows, and ``tokens`` (target tokens) in
    the memory, an exact match whose tags don't correspond is a ``tagdiff``.
    Only an exact match with its tags is translated; all else is a draft.
    Fuzzy runs only on what is left, and not at all where ``least`` is null or
    ``spaced`` (a column) is false. ``keep`` names the columns of the rows that
    come back; texts that it leaves out are not shuffled.
    """
    skip = F.col("confirmed")
    for c in ("protected", "sibling"):
        skip = skip | F.coalesce(c, F.lit(False)) if c in rows.columns else skip
    unread = [c for c in ("plain",) if least is None and c not in keep]
    rows = materialise(rows.withColumns({"__skip": skip, "__row": F.monotonically_increasing_id()}).drop(*unread), "segments")
    open_ = rows.where("not __skip")
    tagged = {"tokens", "formats"} <= set(rows.columns) and "tokens" in memory.columns
    hits = memory.drop("plain", *["tokens"] * (not tagged))
    exact = exact_match(open_, hits, key, langs).select(*key, F.col("tu_id").alias("exact_tu"), *[F.col("tokens").alias("exact_tokens")] * tagged)
    donor = propagation(rows, key, langs).select(*key, F.lit(True).alias("donated"))
    held = [c for c in dict.fromkeys((*keep, *("tokens", "formats") * tagged, "__skip", "__row")) if c not in key]
    placed = materialise(rows.select(*key, *held).join(exact, key, "left").join(donor, key, "left"), "placed")
    if least is None:
        out = placed.withColumn("fuzzy_tu", F.lit(None).cast("long")).withColumn("score", F.lit(None).cast("int"))
    else:
        rest = numbered(rows, placed.where("not __skip and exact_tu is null and donated is null").select("__row"), "__row")
        rest = rest.where("spaced") if "spaced" in rows.columns else rest
        out = placed.join(fuzzy_match(rest, memory, key, least, 1, langs).select(*key, F.col("tu_id").alias("fuzzy_tu"), "score"), key, "left")
    fits = K.tags_matched(F.col("exact_tokens"), F.col("tokens"), F.col("formats")) if tagged else F.lit(True)
    outcome = (
        F.when(F.col("__skip"), "skipped").when(F.col("exact_tu").isNotNull(), F.when(fits, "exact").otherwise("tagdiff")).when(F.col("donated"), "propagated")
        .when(F.col("fuzzy_tu").isNotNull(), "fuzzy").otherwise("unmatched")
    )
    out = out.withColumn("outcome", outcome)
    origins = {"exact": F.lit("tm_exact"), "tagdiff": F.lit("tm_exact_tagdiff"), "propagated": F.lit("propagated"), "fuzzy": T.fuzzy_origin(F.col("score"))}
    origin = F.coalesce(*[F.when(F.col("outcome") == k, v) for k, v in origins.items()])
    status = F.when(F.col("outcome") == "exact", "translated").when(F.col("outcome").isin("tagdiff", "propagated", "fuzzy"), "draft")
    return out.select(*key, *[c for c in keep if c not in key], "outcome", origin.alias("origin"), status.alias("status"), F.coalesce("exact_tu", "fuzzy_tu").alias("tu_id"))
