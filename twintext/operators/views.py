"""Read-side views: panels, forecasts, draft selection, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.operators.qa import SEVERITY


def panel_counts(issues: DataFrame, severities: tuple[str, ...] = (), rules: tuple[str, ...] = ()) -> DataFrame:
    """Counts by severity and by rule, each under the other one's choice (nothing chosen: all)."""
    chosen = lambda c, values: F.col(c).isin(*values) if values else F.lit(True)
    by_severity = issues.where(chosen("rule", rules)).groupBy(F.lit("severity").alias("facet"), F.col("severity").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    by_rule = issues.where(chosen("severity", severities)).groupBy(F.lit("rule").alias("facet"), F.col("rule").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by_severity.unionByName(by_rule)


def panel_issues(issues: DataFrame, key: list[str], severities: tuple[str, ...] = (), rule: str | None = None, dismissed: bool = False) -> DataFrame:
    """The issues that a panel lists, by place of their segment, the worst first, then in the order of the rules."""
    rows = issues.where(F.col("severity").isin(*severities)) if severities else issues
    rows = rows.where(F.col("rule") == rule) if rule else rows
    rows = rows if dismissed or "dismissed" not in rows.columns else rows.where("not dismissed")
    rank = F.array_position(F.lit(["info", "warning", "error"]).cast("array<string>"), F.col("severity"))
    return rows.orderBy(*key, rank.desc(), F.array_position(F.lit(list(SEVERITY)).cast("array<string>"), F.col("rule")))


def origin_counts(segments: DataFrame) -> DataFrame:
    """Segments by origin, the empty one for none."""
    return segments.groupBy(F.coalesce("origin", F.lit("")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def grid(segments: DataFrame, statuses: tuple[str, ...] = (), origin: str | None = None, marks: str = "any", text: str = "", open_id: int | None = None) -> DataFrame:
    """Segments (id, status, origin, source, target, worst) that a filter shows; the open one always stays.

    ``marks`` is any, flagged, errors or clean; ``text`` is looked for in
    source and target, cases folded.
    """
    shown = F.col("status").isin(*statuses) if statuses else F.lit(True)
    shown = shown & (F.coalesce("origin", F.lit("")) == origin if origin is not None else F.lit(True))
    worst = F.col("worst")
    shown = shown & {"any": F.lit(True), "flagged": worst.isNotNull(), "errors": F.coalesce(worst == "error", F.lit(False)), "clean": worst.isNull()}[marks]
    if text:
        holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
        shown = shown & (holds("source") | holds("target"))
    return segments.where(shown if open_id is None else shown | (F.col("id") == open_id))


def tier_forecast(words: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    """Micros due per group (by, tier, words) under a rate card (tier, micros, currency).

    Null unless the priced tiers share one currency; unpriced words are counted.
    """
    rows = words.groupBy(by, "tier").agg(F.sum("words").alias("words")).join(rates, "tier", "left")
    due = F.sum(F.col("words") * F.col("micros"))
    return rows.groupBy(by).agg(
        F.when(F.count_distinct("currency") == 1, due).cast("long").alias("micros_due"), F.when(F.count_distinct("currency") == 1, F.min("currency")).alias("currency"),
        F.sum(F.when(F.col("micros").isNull(), F.col("words")).otherwise(0)).alias("unpriced_words"),
    )


def draft_selection(rows: DataFrame, covered: DataFrame, key: list[str], file_col: str = "doc_id", around: int = 1) -> DataFrame:
    """Open segments that no match covers, with the lines around them.

    ``rows`` has key, plain, hash and confirmed; ``covered`` has hash. Equal
    texts are drafted once, at their first place.
    """
    w = Window.partitionBy(file_col).orderBy("ord")
    near = [F.lag("plain", i).over(w) for i in range(around, 0, -1)] + [F.lead("plain", i).over(w) for i in range(1, around + 1)]
    rows = rows.withColumn("context", F.array_join(F.array_compact(F.array(*near)), "\n"))
    open_ = rows.where("not confirmed").join(covered.select("hash").distinct(), "hash", "left_anti")
    first = open_.groupBy("hash").agg(F.min(F.struct(*key, "plain", "context")).alias("x"))
    return first.select(*[F.col(f"x.{c}").alias(c) for c in (*key, "plain", "context")])


def source_preview(rows: DataFrame, by: str, order: str, text: str, n: int = 3) -> DataFrame:
    """Per file its number of segments and the first ``n``."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("__r", F.row_number().over(w.orderBy(order))).withColumn("segments", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__r") <= n).select(by, "segments", F.col("__r").cast("long").alias("place"), F.col(text).alias("text"))


def quote_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """An order's price lines (order_id, tgt_lang, price) only where their sum is the stored price within 0.005."""
    total = lines.groupBy("order_id").agg(F.sum("price").alias("total"))
    fits = orders.join(total, "order_id").where(F.abs(F.col("total") - F.col("price")) < 0.005).select("order_id")
    return lines.join(fits, "order_id", "left_semi")


def term_entries(variants: DataFrame, preferred: DataFrame) -> DataFrame:
    """Terms with their preferred rendering, alternatives and forbidden ones by primary language."""
    chosen = preferred.select("term_id", "lang", F.col("variant_id").alias("preferred"))
    rows = variants.withColumn("lang", T.primary_subtag(F.col("lang"))).join(chosen, ["term_id", "lang"], "left")
    other = F.when(~F.col("forbidden") & (F.col("variant_id") != F.col("preferred")), F.col("variant_id"))
    out = rows.groupBy("term_id", "lang").agg(F.max("preferred").alias("preferred"), F.array_sort(F.collect_set(other)).alias("a"), F.array_sort(F.collect_set(F.when(F.col("forbidden"), F.col("variant_id")))).alias("f"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("term_id", "lang", "preferred", text("a").alias("alternatives"), text("f").alias("forbidden"))


def stale_uses(found: DataFrame, limit: int = 500) -> DataFrame:
    """The first ``limit`` stale uses of mismatches (key columns, kind, found) with the number of all.

    Stale is a forbidden rendering, or an alternative where the preferred one is missing.
    """
    stale = found.where("kind = 'forbidden' or found is not null")
    keys = [c for c in found.columns if c not in ("kind", "found")]
    total = stale.agg(F.count(F.lit(1)).alias("total"))
    return stale.orderBy(*keys).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)
