"""Versioned memories: merge, write-back, description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_variants(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Merges two versions of a table of variants (key, rev, updated_at, plain, quality, usage_count).

    Of a key that both have, the greater (rev, updated_at, plain, quality)
    wins; equal revisions of different content give the next revision. The
    usage counts take the larger. ``source`` tells whose row stays.
    The result is the same whichever side is ours, but for ``source``.
    """
    side = lambda df, s: df.select(*[F.col(k).alias(f"__{k}") if s == "t" else F.col(k) for k in key], F.struct("rev", "updated_at", "plain", "quality").alias(f"{s}_row"), F.col("usage_count").alias(f"{s}_use"))
    on = [F.col(k) == F.col(f"__{k}") for k in key]
    both = side(ours, "o").join(side(theirs, "t"), on, "full")
    wins = F.greatest("o_row", "t_row")
    clash = (F.col("o_row.rev") == F.col("t_row.rev")) & ((F.col("o_row.plain") != F.col("t_row.plain")) | ~F.col("o_row.quality").eqNullSafe(F.col("t_row.quality")))
    source = F.when(F.col("t_row").isNull() | (F.col("o_row") == F.col("t_row")), F.lit("ours")).when(F.col("o_row").isNull() | (F.col("t_row") > F.col("o_row")), F.lit("theirs")).otherwise("ours")
    row = both.select(*[F.coalesce(k, f"__{k}").alias(k) for k in key], wins.alias("w"), clash.alias("clash"), source.alias("source"), F.greatest("o_use", "t_use").alias("usage_count"))
    return row.select(*key, (F.col("w.rev") + F.coalesce("clash", F.lit(False)).cast("int")).alias("rev"), F.col("w.updated_at").alias("updated_at"), F.col("w.plain").alias("plain"), F.col("w.quality").alias("quality"), "usage_count", "source")


def merge_summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("usage_count").alias("uses"))


def write_back(snapshot: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Applies confirmed translations (key, plain, quality, updated_at) to a snapshot (the same and rev).

    A new key starts at revision 1; a changed one goes up by 1; quality never
    falls. Of several changes to a key the latest counts, by updated_at and plain.
    """
    last = changes.groupBy(*key).agg(F.max(F.struct("updated_at", "plain", "quality")).alias("c"), F.max("quality").alias("best"))
    both = snapshot.join(last, key, "full")
    changed = F.col("c").isNotNull()
    return both.select(
        *key, F.when(changed, F.col("c.plain")).otherwise(F.col("plain")).alias("plain"),
        F.greatest("quality", "best").alias("quality"),
        F.when(changed, F.col("c.updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        (F.coalesce("rev", F.lit(0)) + changed.cast("int")).alias("rev"),
    )


def describe(variants: DataFrame) -> DataFrame:
    """Units and variants by language."""
    return variants.groupBy("lang").agg(F.count_distinct("tu_id").alias("units"), F.count(F.lit(1)).alias("variants"))
