"""Mixing sources to target weights by capped water-filling.

Each source may give at most ``max_epochs`` times its words. Sources whose
share exceeds that are clamped; their excess goes to the others in proportion
to their weights, until none is above its limit. A source's target is then
taken as whole repetitions of all its documents and one fractional repetition:
its documents in a seeded order until the words are reached, the last of them
in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.llm.storage import BROADCAST_BYTES, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Positions have 60 bits; those above this one name the range of a source in which documents are put in order (1024 ranges).
BUCKET_SHIFT = 50


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than the ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), source_col: str = "source") -> DataFrame:
    """Weights dealt cyclically to the distinct sources by code point, null last.

    It ranks the sources, not the rows: one row per source meets in a task.
    """
    names = sources.select(source_col).distinct()
    rank = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return names.select(source_col, F.element_at(values, (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to sources with columns size and weight.

    Each round is one aggregate over the sources; only its three sums reach
    the driver. Rounds end when no further source is clamped.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    if total is None:
        total = sources.agg(F.sum("size")).first()[0] or 0
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(F.lit(0.0))).alias("held"),
            F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, F.lit(1))).alias("n"),
        ).first()
        if row["n"] == clamped or not row["weight"]:
            break
        clamped, level = row["n"], (float(total) - row["held"]) / row["weight"]
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target.cast("double"))


def _position(key: Column, seed: int) -> Column:
    """A seeded pseudo-random 60-bit position of a document, as in SQL: sha-256 of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: float = 3.0,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Decides how many words the mix takes of each document.

    ``weights`` has one row per source (``source_col``, weight). The mix holds
    as many words as the documents together. Returns one row per document: the
    id, ``size`` (words), ``source_size``, ``target`` (words that its source
    should give), ``taken`` (words taken, repetitions counted) and the columns
    named in ``keep``; ``mixed_documents`` gives whole documents.

    A null text has size 0, as an empty one; such documents are never taken. A
    null source is a source of its own. A source without a weight gets none. Repeated rows
    are documents of their own, the order of equal ones being without
    consequence. Empty tables give an empty result.
    """
    placed = _placed(_sized(docs, id_col, text_col, source_col, seed, keep), weights, source_col, max_epochs)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__start")))
    taken = F.col("__whole") * F.col("size") + part
    return placed.select(F.col("__id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep])


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size"), _position(F.col(id_col), seed).alias("__pos"),
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    return materialise(rows.withColumn("__bucket", F.shiftright("__pos", BUCKET_SHIFT).cast("int")), "mix-sizes")


def _placed(rows: DataFrame, weights: DataFrame, source_col: str, max_epochs: float) -> DataFrame:
    """Sized rows with what their source gives (source_size, target, __whole, __rest) and the words before them in its order (__start)."""
    in_buckets = materialise(rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sizes = in_buckets.groupBy("__source").agg(F.sum("words").alias("size"))
    given = weights.select(F.col(source_col).alias("__name"), F.col("weight").cast("double").alias("weight"))
    sources = sizes.join(given, F.col("__source").eqNullSafe(F.col("__name")), "left").select("__source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sources = materialise(sources, "mix-sources")
    targets = water_fill(sources, max_epochs=max_epochs).select(F.col("__source").alias("__name"), F.col("size").alias("source_size"), "target")
    targets = targets.withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("__rest", (F.round("target") - F.col("__whole") * F.col("source_size")).cast("long"))

    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = in_buckets.withColumn("__before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    buckets = buckets.join(targets, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name").withColumnRenamed("__source", "__of").withColumnRenamed("__bucket", "__in")
    placed = rows.join(buckets, F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__in")))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__pos", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("__start", F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def mixed_documents(
    docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, seed: int = 0,
) -> DataFrame:
    """The documents that ``mix`` takes words of, all columns, with ``size``, ``source_size``, ``target`` and ``taken``.

    A source's documents are taken in one order up to a cut, so each row is
    judged by its own place and its source's cut: texts are neither joined by
    id nor sorted. Of rows with the id and size of the cut those of the least
    text digest come first. Columns of these names are replaced.
    """
    rows = materialise(_placed(_sized(docs, id_col, text_col, source_col, seed), weights, source_col, max_epochs), "mix-placed")
    key, own = F.struct("__pos", "__id", "size"), F.struct(F.col("__source"))
    inside = (F.col("size") > 0) & (F.col("__start") <= F.col("__rest")) & (F.col("__rest") < F.col("__start") + F.col("size"))
    sums = [F.first(c).alias(c) for c in ("source_size", "target", "__whole", "__rest")]
    cuts = materialise(rows.groupBy(own.alias("__of")).agg(*sums, F.min(F.when(inside, key)).alias("__key")), "mix-cuts")
    few = cuts.count() * 256 <= BROADCAST_BYTES
    sent = F.broadcast(cuts) if few else cuts
    # Where the rows of the cut's id and size begin, and how many there are.
    ties = rows.select(own.alias("__of"), key.alias("__key"), "__start").join(sent.select("__of", "__key"), ["__of", "__key"])
    ties = ties.groupBy("__of").agg(F.min("__start").alias("__first"), F.count(F.lit(1)).alias("__same"))
    cuts = materialise(cuts.join(ties, "__of", "left"), "mix-cuts")
    given = ("size", "source_size", "target", "taken")
    named = docs.drop(*given).withColumns({"__id": F.col(id_col), "size": word_count(F.col(text_col)), "__pos": _position(F.col(id_col), seed), "__of": F.struct(F.col(source_col).alias("__source"))})
    met = named.join(F.broadcast(cuts) if few else cuts, "__of")
    place = F.when(F.col("__key").isNull() | (key < F.col("__key")), F.col("size")).when(key > F.col("__key"), 0)
    single = F.when(F.col("__same") == 1, F.col("__rest") - F.col("__first"))
    met = met.withColumn("__part", F.coalesce(place, single))
    columns = [F.col(c) for c in docs.columns if c not in given]
    out = lambda df: df.select(*columns, "size", "source_size", "target", (F.col("__whole") * F.col("size") + F.col("__part")).cast("long").alias("taken")).where("taken > 0")
    # Rows that share the cut's id and size: the first of them are whole, one is partial.
    tied = met.where("__part is null").withColumn("__nth", F.row_number().over(Window.partitionBy("__of").orderBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))))
    left = F.col("__rest") - F.col("__first") - (F.col("__nth") - 1) * F.col("size")
    tied = tied.withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), left))).drop("__nth")
    return out(met.where("__part is not null")).unionByName(out(tied)) if cuts.where("__same > 1").limit(1).count() else out(met)
