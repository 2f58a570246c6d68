"""A glossary as an append-only log: revisions, decisions and tombstones folded into states, and sessions that write to it.

Nothing in the log is changed or deleted. What a glossary was at some time is
a fold of the entries up to it; folds are aggregates that combine before they
shuffle, so a term that is edited very often is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.operators.glossary import preferred_variant

#: Columns of a log: ``op`` is variant, decision or tombstone.
LOG = "id bigint, at string, op string, term_id bigint, variant_id bigint, lang string, text string, note string, forbidden boolean, kind string, rejected array<string>, project string, segment bigint"


def refusals(log: DataFrame) -> DataFrame:
    """Adds ``refused``: why an entry has no effect, or null.

    Renderings and choices need letters or marks after normalisation; a first
    entry of a variant needs a text, which is judged by the log as a whole.
    """
    empty = T.term_key(F.coalesce("text", F.lit(""))) == ""
    first = log.where("op = 'variant' and text is not null").groupBy("variant_id").agg(F.min(F.struct("at", "id")).alias("__begun"))
    known = log.join(first, "variant_id", "left")
    early = (F.col("op") == "variant") & (F.col("__begun").isNull() | (F.struct("at", "id") < F.col("__begun")))
    reason = (
        F.when(~F.col("op").isin("variant", "decision", "tombstone"), "unknown").when((F.col("op") == "decision") & empty, "no choice")
        .when((F.col("op") == "variant") & F.col("text").isNotNull() & empty, "no text").when(early, "no variant")
    )
    return known.withColumn("refused", reason).select(*log.columns, "refused")


def _effective(log: DataFrame) -> DataFrame:
    return refusals(log).where("refused is null").drop("refused")


def _keys(texts: Column) -> Column:
    """The key of each text of an array, empty for null ones. All are normalised as one string: lambdas can't hold the NFC step."""
    mark = "\u0001"
    plain = F.transform(texts, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit(mark), F.lit("")))
    return F.when(F.size(texts) > 0, F.split(T.term_key(F.array_join(plain, mark)), f" ?{mark} ?")).otherwise(F.array().cast("array<string>"))


def _others(texts: Column, chosen: Column) -> Column:
    """The texts whose key is another one than ``chosen``."""
    keys = _keys(texts)
    rows = F.arrays_zip(texts, keys, F.array_repeat(chosen, F.size(keys))).cast("array<struct<text:string,key:string,chosen:string>>")
    return F.transform(F.filter(rows, lambda x: x["key"] != x["chosen"]), lambda x: x["text"])


def rejected_keys(rejected: Column, chosen: Column) -> Column:
    """The renderings offered and not taken, as keys: distinct, without empty ones and the chosen."""
    return F.array_remove(F.array_remove(F.array_distinct(_keys(F.coalesce(rejected, F.array().cast("array<string>")))), ""), chosen)


def decisions(log: DataFrame) -> DataFrame:
    """The decisions of a log: id, term_id, lang, chosen and rejected (keys), kind, project, segment and decided_at."""
    d = _effective(log).where("op = 'decision'")
    chosen = T.term_key(F.col("text"))
    return d.select("id", "term_id", "lang", chosen.alias("chosen"), rejected_keys(F.col("rejected"), chosen).alias("rejected"), "kind", "project", "segment", F.col("at").alias("decided_at"))


def variant_versions(log: DataFrame) -> DataFrame:
    """Every state that a variant was in: term_id, variant_id, lang, rev, text, plain, note, forbidden, ``valid_from`` and ``valid_to`` (null: still).

    An entry without text, note or forbidden keeps what was there; an empty
    note clears it. The first entry gives the term and language.
    """
    v = _effective(log).where("op = 'variant'")
    w = Window.partitionBy("variant_id").orderBy("at", "id")
    so_far = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    begun = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    note = so_far("note")
    rows = v.select(
        begun("term_id").alias("term_id"), "variant_id", begun("lang").alias("lang"), F.row_number().over(w).alias("rev"), so_far("text").alias("text"),
        F.when(note != "", note).alias("note"), F.coalesce(so_far("forbidden"), F.lit(False)).alias("forbidden"), F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"),
    )
    return rows.withColumn("plain", T.term_key(F.col("text")))


def variants_as_of(log: DataFrame, at: str) -> DataFrame:
    """The variants at a time (entries of that time included), those of deleted terms left out."""
    v = _effective(log.where(F.col("at") <= at))
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", "id", F.col(c).alias("v"))))["v"].alias(c)
    first = F.min(F.struct("at", "id", "term_id", "lang"))
    now = v.where("op = 'variant'").groupBy("variant_id").agg(first.alias("x"), latest("text"), latest("note"), latest("forbidden"), F.count(F.lit(1)).alias("rev"))
    rows = now.select(F.col("x.term_id").alias("term_id"), "variant_id", F.col("x.lang").alias("lang"), "rev", "text", T.term_key(F.col("text")).alias("plain"), F.when(F.col("note") != "", F.col("note")).alias("note"), F.coalesce("forbidden", F.lit(False)).alias("forbidden"))
    gone = v.where("op = 'tombstone'").select("term_id").distinct()
    return rows.join(gone, "term_id", "left_anti")


def entries_as_of(log: DataFrame, at: str) -> DataFrame:
    """Each term and primary language at a time: ``preferred`` (a variant), its ``plain`` key, and how many ``variants`` and ``forbidden`` ones there are."""
    v = variants_as_of(log, at)
    best = preferred_variant(v, decisions(log.where(F.col("at") <= at)))
    sums = v.groupBy("term_id", T.primary_subtag(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("variants"), F.sum(F.col("forbidden").cast("bigint")).alias("forbidden"))
    return sums.join(best.select("term_id", "lang", F.col("variant_id").alias("preferred"), "plain", "decided_at"), ["term_id", "lang"], "left")


def ruling_ranges(log: DataFrame) -> DataFrame:
    """What a term's last ruling in a primary language was, and when: term_id, lang, chosen, kind, valid_from, valid_to (null: still)."""
    d = decisions(log).where("kind not in ('deprecation', 'segment_exception')").withColumn("lang", T.primary_subtag(F.col("lang")))
    w = Window.partitionBy("term_id", "lang").orderBy("decided_at", "id")
    return d.select("term_id", "lang", "chosen", "kind", "id", F.col("decided_at").alias("valid_from"), F.lead("decided_at").over(w).alias("valid_to"))


# Sessions. Events: session_id, seq (their order), op, key, rendering, edit, term_id, offered.

#: What an event can do; the last two close the session.
SESSION_OPS = ("flag", "choose", "propose", "skip", "reopen", "commit", "discard")
EDITS = ("override", "deprecate")


def _judged(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events with the flag they are for and ``refused``, and each session's closing."""
    # A repeated event is the same event; of two under one number the least stands.
    names = ("op", "key", "rendering", "edit", "term_id", "offered")
    once = events.groupBy("session_id", "seq").agg(F.min(F.struct(*names)).alias("e")).select("session_id", "seq", *[F.col(f"e.{c}").alias(c) for c in names])
    closed = once.where("op in ('commit', 'discard')").groupBy("session_id").agg(F.min(F.struct("seq", "op")).alias("c")).select("session_id", F.col("c.seq").alias("closed_at"), F.col("c.op").alias("closed"))
    flags = once.where(F.col("op") == "flag").where((F.col("key") != "") & (F.col("key") == T.term_key(F.col("key")))).groupBy("session_id", "key").agg(F.min(F.struct("seq", "term_id", "offered")).alias("flag"))
    rows = once.join(closed, "session_id", "left").join(flags, ["session_id", "key"], "left")
    text = T.term_key(F.coalesce("rendering", F.lit("")))
    closing = F.col("op").isin("commit", "discard")
    reason = (
        F.when(~F.coalesce(F.col("op").isin(*SESSION_OPS), F.lit(False)), "unknown").when(F.col("seq") > F.col("closed_at"), "closed")
        .when(~closing & F.col("flag").isNull(), "no flag").when((F.col("op") == "flag") & (F.col("seq") > F.col("flag.seq")), "flagged twice")
        .when(~closing & (F.col("seq") < F.col("flag.seq")), "no flag").when(F.col("op").isin("choose", "propose") & (text == ""), "no rendering")
        .when((F.col("op") == "propose") & F.col("flag.term_id").isNull(), "no entry").when((F.col("op") == "propose") & ~F.coalesce(F.col("edit").isin(*EDITS), F.lit(False)), "unknown edit")
    )
    return rows.withColumn("refused", reason), closed


def session_refusals(events: DataFrame) -> DataFrame:
    """Events that have no effect: session_id, seq and ``refused`` (why)."""
    return _judged(events)[0].where("refused is not null").select("session_id", "seq", "refused")


def session_states(events: DataFrame) -> DataFrame:
    """Where each flag of each session stands after all its events, in whatever order they came.

    The last event of a flag by ``seq`` that has an effect decides: choose
    (``decided``; of kind accepted_suggestion if the rendering was offered,
    else custom), propose (``proposed``; override or deprecation, of an entry
    that exists), skip (``skipped``) or reopen (``flagged``). Returns
    session_id, key, flag_seq, state, kind, rendering, ``rejected`` (offered
    renderings other than it), and ``status`` of the session: open, committed
    or discarded.
    """
    rows, closed = _judged(events)
    good = rows.where("refused is null and op not in ('commit', 'discard')")
    last = good.groupBy("session_id", "key").agg(F.max(F.struct("seq", "op", "rendering", "edit")).alias("e"), F.min("flag").alias("flag"))
    chosen = T.term_key(F.col("e.rendering"))
    offered = F.coalesce("flag.offered", F.array().cast("array<string>"))
    state = F.when(F.col("e.op") == "choose", "decided").when(F.col("e.op") == "propose", "proposed").when(F.col("e.op") == "skip", "skipped").otherwise("flagged")
    kind = (
        F.when((F.col("e.op") == "choose") & F.array_contains(_keys(offered), chosen), "accepted_suggestion").when(F.col("e.op") == "choose", "custom")
        .when(F.col("e.op") == "propose", F.when(F.col("e.edit") == "deprecate", "deprecation").otherwise("override"))
    )
    status = F.when(F.col("closed") == "commit", "committed").when(F.col("closed") == "discard", "discarded").otherwise("open")
    settled = state.isin("decided", "proposed")
    return last.join(closed, "session_id", "left").select(
        "session_id", "key", F.col("flag.seq").alias("flag_seq"), F.col("flag.term_id").alias("term_id"), state.alias("state"), kind.alias("kind"), F.when(settled, F.col("e.rendering")).alias("rendering"),
        F.when(settled, _others(offered, chosen)).alias("rejected"), status.alias("status"), "closed_at",
    )


def committed_entries(states: DataFrame) -> DataFrame:
    """What committed sessions write to the log, by session and order of the flags."""
    return states.where("status = 'committed' and state in ('decided', 'proposed')").select("session_id", "flag_seq", "key", "term_id", "kind", "rendering", "rejected")


def remaining_flags(states: DataFrame) -> DataFrame:
    """Flags that nobody decided, which the next session asks about again."""
    return states.where("state in ('flagged', 'skipped')").select("session_id", "flag_seq", "key", "term_id")
