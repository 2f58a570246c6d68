"""The cascade with its targets: what a match says, on the tags of the segment that it is for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.functions.hidden import carry_hidden_tags
from twintext.operators.matching import pretranslate, propagation
from twintext.stages import materialise


def pretranslated_targets(rows: DataFrame, memory: DataFrame, key: list[str], least: int | None = 75, langs: tuple[str, ...] = (), keep: tuple[str, ...] = ("plain",)) -> DataFrame:
    """Each segment's outcome as ``pretranslate`` gives it, with ``target`` (tokens) and ``tags_matched``.

    ``rows`` has what ``pretranslate`` needs, and tokens, formats and target
    (tokens; null: none); ``memory`` has tokens, the units' target sides. An
    exact or fuzzy match brings its unit's tokens, a propagated one those of
    the first confirmed segment of the same source that has a target. They are
    placed on the segment's own visible tags, or as text alone where those
    don't correspond, and the segment's hidden tags are carried. Skipped and
    unmatched segments have no target. ``keep`` names the columns of the rows
    that come back.
    """
    protected = F.col("confirmed") | (F.coalesce("protected", F.lit(False)) if "protected" in rows.columns else F.lit(False))
    # Written, as the cascade, the donors and the placing read it.
    rows = materialise(rows.withColumns({"protected": protected, "confirmed": F.col("confirmed") & F.col("target").isNotNull()}), "rows")
    found = materialise(pretranslate(rows.drop("target"), memory, key, least, langs, keep), "outcomes")
    names = {k: f"donor_{k}" for k in key}
    donors = rows.select(*[F.col(k).alias(n) for k, n in names.items()], K.to_memory(F.col("target"), F.col("formats")).alias("donor"))
    given = propagation(rows, key, langs).select(*key, *names.values()).join(donors, list(names.values())).select(*key, "donor")
    units = memory.groupBy("tu_id").agg(F.first("tokens").alias("unit"))
    # Segments without a unit, mostly the larger part, would meet in one task as the null key of a join.
    hits = found.where("tu_id is not null").join(units, "tu_id", "left")
    others = found.where("tu_id is null").withColumn("unit", F.lit(None).cast(dict(units.dtypes)["unit"]))
    matched = hits.unionByName(others).join(given, key, "left").join(rows.select(*key, "tokens", "formats"), key)
    match = F.when(F.col("outcome") == "propagated", F.col("donor")).when(F.col("tu_id").isNotNull(), F.col("unit"))
    # Written, so that the two steps in Python don't meet in one expression.
    matched = materialise(matched.select(*found.columns, "tokens", "formats", match.alias("match")), "matches", compression="zstd")
    placed = matched.withColumn("placed", K.place_match(F.col("match"), F.col("tokens"), F.col("formats")))
    placed = materialise(placed.select(*found.columns, "tokens", "formats", F.when(F.col("match").isNotNull(), F.col("placed.tokens")).alias("target"), F.when(F.col("match").isNotNull(), F.col("placed.tags_matched")).alias("tags_matched")), "placed-matches", compression="zstd")
    return placed.withColumn("target", carry_hidden_tags(F.col("target"), F.col("tokens"), F.col("formats"))).drop("tokens", "formats")
