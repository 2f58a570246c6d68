"""Memories of units and their variants: merging two of them, edits, retiring, confirming.

A memory is a set of tables: ``units`` (uuid, rev, updated_at, created_at,
created_by, deleted, attrs), ``variants`` (uuid, lang, rev, updated_at, tokens,
plain, hash, prev_hash, next_hash, quality, usage_count, last_used_at,
created_at), ``history`` (uuid, lang, rev, tokens, quality), ``vectors`` (uuid,
lang, vec) and ``profiles`` (lang, delta). Results are new snapshots.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.functions import tokens as K
from twintext.stages import materialise

# The quality of a confirmed translation, and the longest text that an edit may bring.
CONFIRMED, MAX_TEXT = 3, 5_000
#: The characters of ``T.SPACE``, one by one.
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(T.SPACE, c))
KEY = ["uuid", "lang"]
_CONTENT = ("rev", "updated_at", "tokens", "quality", "prev_hash", "next_hash")


@dataclass(frozen=True)
class Memory:
    units: DataFrame
    variants: DataFrame
    history: DataFrame
    vectors: DataFrame
    profiles: DataFrame


def _both(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Full join on the key, each side's row as a struct: o and t."""
    side = lambda df, s: df.select(*key, F.struct(*[F.col(c) for c in df.columns]).alias(s))
    return side(ours, "o").join(side(theirs, "t"), key, "full")


def merge_units(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Units of both, with ``is_new`` and ``retired`` (a tombstone that came from theirs).

    Revision and change take the greater, creation the lesser; a tombstone of
    either side stays. Of an attribute that both have, the greater (rev,
    updated_at, value) wins. The result doesn't depend on which side is ours.
    """
    both = _both(ours, theirs, ["uuid"])
    least, most = lambda c: F.least(f"o.{c}", f"t.{c}").alias(c), lambda c: F.greatest(f"o.{c}", f"t.{c}").alias(c)
    empty = F.create_map().cast("map<string,string>")
    o, t = F.coalesce("o.attrs", empty), F.coalesce("t.attrs", empty)
    order = lambda s, v: F.struct(F.col(f"{s}.rev").alias("rev"), F.col(f"{s}.updated_at").alias("at"), v.alias("v"))
    pick = lambda k, x, y: F.when(y.isNull(), x).when(x.isNull(), y).when(order("t", y) > order("o", x), y).otherwise(x)
    return both.select(
        "uuid", most("rev"), most("updated_at"), least("created_at"), least("created_by"), most("deleted"), F.map_zip_with(o, t, pick).alias("attrs"),
        F.col("o").isNull().alias("is_new"), (F.coalesce(~F.col("o.deleted"), F.lit(False)) & F.coalesce("t.deleted", F.lit(False))).alias("retired"),
    )


def _outcomes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per variant (o, t) the outcome: add, keep (ours alone), src or dst; whether contents differ, and revisions tie."""
    both = _both(ours, theirs, KEY)
    content = lambda s: F.struct(*[F.coalesce(F.col(f"{s}.{c}"), F.lit("")).alias(c) if c.endswith("_hash") else F.col(f"{s}.{c}").alias(c) for c in _CONTENT])
    outcome = F.when(F.col("o").isNull(), "add").when(F.col("t").isNull(), "keep").when(content("t") > content("o"), "src").otherwise("dst")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("tokens", "quality", "prev_hash", "next_hash")]
    differs = F.col("o").isNotNull() & F.col("t").isNotNull() & ~(same[0] & same[1] & same[2] & same[3])
    return both.select(*KEY, "o", "t", outcome.alias("outcome"), differs.alias("differs"), F.coalesce(F.col("o.rev") == F.col("t.rev"), F.lit(False)).alias("same_rev"))


def merge_variants(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Variants of both: the greater by revision, change and content; equal revisions of other content take the next one.

    Use counts and last use take the greater, creation the lesser.
    """
    x = _outcomes(ours, theirs)
    win = F.when(F.col("outcome").isin("add", "src"), F.col("t")).otherwise(F.col("o"))
    x = x.withColumn("w", win)
    rev = F.col("w.rev") + (F.col("differs") & F.col("same_rev")).cast("int")
    fixed = ["updated_at", "tokens", "plain", "hash", "prev_hash", "next_hash", "quality"]
    return x.select(*KEY, rev.alias("rev"), *[F.col(f"w.{c}").alias(c) for c in fixed], F.greatest("o.usage_count", "t.usage_count").alias("usage_count"), F.greatest("o.last_used_at", "t.last_used_at").alias("last_used_at"), F.least("o.created_at", "t.created_at").alias("created_at"), "outcome")


def merge_history(ours: Memory, theirs: Memory) -> DataFrame:
    """Kept revisions (uuid, lang, rev, tokens, quality, origin): ours, what the merge displaces, and theirs.

    A revision that is already held stays as it is; ``origin`` is held,
    retained or copied, and ``conflict`` tells of other content that lost its
    place.
    """
    x = _outcomes(ours.variants, theirs.variants).where("differs")
    lost = F.when(F.col("outcome") == "src", F.col("o")).otherwise(F.col("t"))
    displaced = x.select(*KEY, lost.alias("l")).select(*KEY, "l.rev", "l.tokens", "l.quality")
    row = lambda df, rank, origin: df.select(*KEY, "rev", F.struct(F.lit(rank).alias("rank"), F.lit(origin).alias("origin"), "tokens", "quality").alias("x"))
    every = row(ours.history, 0, "held").unionByName(row(displaced, 1, "retained")).unionByName(row(theirs.history, 2, "copied"))
    kept = every.groupBy(*KEY, "rev").agg(F.min("x").alias("x"), F.count_distinct(F.struct("x.tokens", "x.quality")).alias("contents"))
    return kept.select(*KEY, "rev", "x.tokens", "x.quality", "x.origin", (F.col("contents") > 1).alias("conflict"))


def merge_vectors(ours: Memory, theirs: Memory) -> DataFrame:
    """Our vectors but for those whose variant now has another text."""
    gone = _outcomes(ours.variants, theirs.variants).where((F.col("outcome") == "src") & (F.col("o.plain") != F.col("t.plain")))
    return ours.vectors.join(gone.select(*KEY), KEY, "left_anti")


def merge_profiles(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Segmentation rules (lang, delta): ours where both have some, with a warning where they differ."""
    both = _both(ours, theirs, ["lang"])
    differ = F.coalesce(F.col("o.delta") != F.col("t.delta"), F.lit(False))
    return both.select("lang", F.coalesce("o.delta", "t.delta").alias("delta"), F.when(differ, F.concat(F.lit('segmentation rules for "'), "lang", F.lit('" differ; ours were kept'))).alias("warning"))


def merge(ours: Memory, theirs: Memory, versions: tuple[int, int] = (1, 1)) -> Memory:
    """Both memories as one. Memories of different normalisers (``versions``) are refused: their hashes don't compare."""
    if versions[0] != versions[1]:
        raise ValueError(f"the memories were written by normaliser versions {versions[0]} and {versions[1]}")
    return Memory(
        merge_units(ours.units, theirs.units).drop("is_new", "retired"), merge_variants(ours.variants, theirs.variants).drop("outcome"),
        merge_history(ours, theirs).drop("origin", "conflict"), merge_vectors(ours, theirs), merge_profiles(ours.profiles, theirs.profiles).drop("warning"),
    )


def merge_counts(ours: Memory, theirs: Memory) -> DataFrame:
    """One row: what a merge adds, replaces, keeps, retires and retains."""
    n = lambda c: F.count(F.when(c, 1))
    units = merge_units(ours.units, theirs.units).agg(n(F.col("is_new")).alias("units_added"), n(F.col("retired")).alias("tombstones"))
    x = _outcomes(ours.variants, theirs.variants)
    is_ = lambda o: F.col("outcome") == o
    variants = x.agg(n(is_("add")).alias("variants_added"), n(is_("src") & F.col("differs")).alias("variants_replaced"), n(is_("dst") & F.col("differs")).alias("variants_kept"))
    history = merge_history(ours, theirs).agg(n(F.col("origin") == "retained").alias("history_retained"), n(F.col("origin") == "copied").alias("history_copied"), n(F.col("conflict")).alias("history_conflicts"))
    # One row each.
    return units.crossJoin(variants).crossJoin(history)


def edit_reasons(edits: DataFrame, variants: DataFrame, units: DataFrame) -> DataFrame:
    """Each edit (uuid, lang, base_rev, text) with its variant, the new text and what it comes to.

    ``reason`` is blank, too_long, not_found, stale or tagged for what is
    refused, unchanged, or null for an edit that applies. Several edits of a
    variant at one revision are all but one stale: the least text goes first.
    """
    text = F.btrim(K.xml_legal(F.col("text")), F.lit(SPACES))
    live = variants.join(units.where("not deleted").select("uuid"), "uuid").select(*KEY, F.col("rev").alias("__rev"), F.col("tokens").alias("__tokens"), F.col("plain").alias("__plain"), F.col("quality").alias("__quality"))
    rows = edits.withColumn("text", text)
    # Texts that are refused for their length are not carried through the joins for what they say.
    rows = rows.select(*KEY, "base_rev", "text", (F.col("text") == "").alias("__blank"), (F.length("text") > MAX_TEXT).alias("__long"), F.when(F.length("text") <= MAX_TEXT, F.col("text")).alias("__short"))
    # Only keys of several edits have a first one to find; their texts alone are compared.
    several = materialise(edits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*KEY), "several")
    first = edits.join(several, KEY, "left_semi").withColumn("text", text).groupBy(*KEY).agg(F.min("text").alias("__first"))
    rows = rows.join(live, KEY, "left").join(first, KEY, "left")
    tags = F.exists(F.col("__tokens"), lambda x: x["t"] != "text")
    same = (F.size("__tokens") == 1) & (F.element_at("__tokens", 1)["v"] == F.col("__short")) & (F.col("__plain") == T.normalize(F.col("__short")))
    reason = (
        F.when(F.col("__blank"), "blank").when(F.col("__long"), "too_long").when(F.col("__rev").isNull(), "not_found")
        .when((F.col("__rev") != F.col("base_rev")) | (F.col("__short") != F.col("__first")), "stale").when(tags, "tagged").when(F.coalesce(same, F.lit(False)), "unchanged")
    )
    return rows.select(*KEY, "base_rev", "text", reason.alias("reason"))


def apply_edits(memory: Memory, edits: DataFrame, at: str) -> Memory:
    """The memory after the edits that ``edit_reasons`` accepts; the old text goes to the history, its vector goes."""
    good = edit_reasons(edits, memory.variants, memory.units).where("reason is null").select(*KEY, F.col("text").alias("__new")).distinct()
    new = T.normalize(F.col("__new"))
    rows = memory.variants.join(good, KEY, "left")
    hit = F.col("__new").isNotNull()
    change = {
        "tokens": F.array(K.token("text", F.col("__new"))), "plain": new, "hash": T.text_hash(new), "rev": F.col("rev") + 1,
        "quality": F.greatest(F.col("quality"), F.lit(CONFIRMED)), "updated_at": F.lit(at),
    }
    variants = rows.select(*[F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in memory.variants.columns])
    old = memory.variants.join(good.select(*KEY), KEY).select(*memory.history.columns)
    return Memory(memory.units, variants, memory.history.unionByName(old), memory.vectors.join(good.select(*KEY), KEY, "left_anti"), memory.profiles)


def retire(units: DataFrame, requests: DataFrame, at: str) -> DataFrame:
    """Units with tombstones for the requests (uuid, base_rev) whose revision is the unit's; a tombstone is never undone."""
    wanted = requests.groupBy("uuid").agg(F.collect_set("base_rev").alias("__revs"))
    rows = units.join(wanted, "uuid", "left")
    hit = F.coalesce(F.array_contains("__revs", F.col("rev")), F.lit(False)) & ~F.col("deleted")
    return rows.select(*[F.when(hit, v).otherwise(F.col(c)).alias(c) if (v := {"deleted": F.lit(True), "rev": F.col("rev") + 1, "updated_at": F.lit(at)}.get(c)) is not None else F.col(c) for c in units.columns])


def confirm_reasons(segments: DataFrame) -> DataFrame:
    """Why a segment (tokens, target, formats, status, base_updated_at, updated_at) can't be confirmed, or null.

    A locked segment, a stale one, one without a visible target, one whose
    tags don't nest, and one that is confirmed already.
    """
    blank = F.col("target").isNull() | K.is_blank(F.col("target"), F.col("formats"))
    reason = (
        F.when(F.col("status") == "locked", "locked").when(F.col("base_updated_at") != F.col("updated_at"), "stale").when(blank, "blank")
        .when(F.size(K.structure_errors(F.col("target"))) > 0, "unbalanced").when(F.col("status") == "confirmed", "confirmed")
    )
    return segments.withColumn("reason", reason)


def confirmed_variants(segments: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """What confirmed segments (id, tokens, target, formats, hash, updated_at) bring to a memory: both sides as variants of a unit."""
    side = lambda lang, col: F.struct(F.lit(lang).alias("lang"), K.to_memory(F.col(col), F.col("formats")).alias("tokens"))
    rows = segments.select("hash", "updated_at", F.explode(F.array(side(src_lang, "tokens"), side(tgt_lang, "target"))).alias("v"))
    plain = T.normalize(K.plain_text(F.col("v.tokens")))
    return rows.select(F.col("hash").alias("source_hash"), "v.lang", "v.tokens", plain.alias("plain"), T.text_hash(plain).alias("hash"), F.lit(CONFIRMED).alias("quality"), "updated_at")


def write_back(variants: DataFrame, changes: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New variants, displaced history rows, and keys whose vector no longer fits.

    ``changes`` (uuid, lang, tokens, plain, quality, updated_at): of several to
    a key the latest counts. A revision goes to the history only if its tag
    kinds differ from the new ones'; quality never falls.
    """
    last = changes.groupBy(*KEY).agg(F.max(F.struct("updated_at", "plain", "tokens")).alias("c"), F.max("quality").alias("best"))
    both = variants.join(last, KEY, "full")
    changed = F.col("c").isNotNull()
    keep = lambda c, new: F.when(changed, new).otherwise(F.col(c)).alias(c)
    new = both.select(*KEY, (F.coalesce("rev", F.lit(0)) + changed.cast("int")).alias("rev"), keep("updated_at", F.col("c.updated_at")), keep("tokens", F.col("c.tokens")), keep("plain", F.col("c.plain")), keep("hash", T.text_hash(F.col("c.plain"))), F.greatest("quality", "best").alias("quality"))
    had = both.where(changed & F.col("rev").isNotNull())
    history = had.where(K.kind_multiset(F.col("tokens")) != K.kind_multiset(F.col("c.tokens"))).select(*KEY, "rev", "tokens", "quality")
    return new, history, had.where(F.col("plain") != F.col("c.plain")).select(*KEY)
