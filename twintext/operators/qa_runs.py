"""Quality runs over whole projects: each pair by its own languages, and reruns of what an edit can move.

A rerun keeps the findings of the last run as a table that it maintains: the
changed pairs give the keys whose findings can differ (their own, and those of
pairs that share a source or a target with one of them, as it was or as it is),
only these are found anew, and the others are taken over with their dismissals.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.operators import qa
from twintext.stages import having, lacking, materialise

#: Rules on a pair and its neighbours; all others look at one pair.
CONSISTENCY = ("consistency.target_differs", "consistency.source_differs")
PAIR_RULES = tuple(r for r in qa.SEVERITY if r.startswith(("seg.", "num.", "punct.")))


def _tag(lang: Column) -> Column:
    return F.replace(F.lower(lang), F.lit("_"), F.lit("-"))


def spacing(target: Column, lang: Column) -> Column:
    """``punct.spacing`` by the language of each row."""
    found = F.lit(None).cast("boolean")
    for tag in (t for t in qa.SPACING if t):
        own = _tag(lang) == tag if "-" in tag else (T.primary_subtag(lang) == tag) & ~_tag(lang).isin(*[t for t in qa.SPACING if "-" in t])
        found = F.coalesce(found, F.when(own, qa.punct_spacing(target, tag)))
    return F.coalesce(found, qa.punct_spacing(target, ""))


def pair_issues(pairs: DataFrame, key: list[str], src_lang: str = "src_lang", tgt_lang: str = "tgt_lang", rules: tuple[str, ...] = PAIR_RULES) -> DataFrame:
    """The issues (key, rule, severity) of ``qa.issues``, each pair by the languages in its columns.

    A null target has no issue but ``seg.empty``; a null language follows the
    general rules.
    """
    s, t = F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))
    there, tgt = F.col("target").isNotNull(), F.coalesce(tgt_lang, F.lit(""))

    @F.pandas_udf("struct<missing:boolean,altered:boolean>")
    def numbers(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [qa.compare_numerals(*r) if r[0] else ((), ()) for r in zip(a, b, x, y, strict=True)]
        return pd.DataFrame({"missing": [bool(m) for m, _ in found], "altered": [bool(c) for _, c in found]})

    rows = pairs
    if {"num.missing", "num.altered"} & set(rules):
        digits = s.rlike("[0-9]") & there
        rows = pairs.withColumn("__num", numbers(F.when(digits, s).otherwise(""), F.when(digits, t).otherwise(""), F.coalesce(src_lang, F.lit("")), tgt))
    checks = {
        "seg.empty": F.col("status").isin("translated", "confirmed") & (F.trim(t) == ""), "seg.untranslated": there & qa.untranslated(s, t),
        "num.missing": F.col("__num.missing"), "num.altered": F.col("__num.altered"), "punct.terminal": there & qa.punct_terminal(s, t), "punct.brackets": there & qa.punct_brackets(s, t),
        "punct.inverted": there & (T.primary_subtag(tgt) == "es") & qa.punct_inverted(t), "punct.spacing": there & spacing(t, tgt),
    }
    found = F.array_compact(F.array(*[F.when(checks[r], F.struct(F.lit(r).alias("rule"), F.lit(qa.SEVERITY[r]).alias("severity"))) for r in rules]))
    return rows.select(*key, F.explode(found).alias("i")).select(*key, "i.rule", "i.severity")


def _found(rows: DataFrame, key: list[str], rule: str, group: list[str]) -> DataFrame:
    same, other = ("source", "target") if rule == CONSISTENCY[0] else ("target", "source")
    hit = qa._differing(rows.where("source is not null and target is not null"), key, group, same, other)
    return hit.select(*key, F.lit(rule).alias("rule"), F.lit(qa.SEVERITY[rule]).alias("severity"))


def full_run(pairs: DataFrame, key: list[str], rules: tuple[str, ...] = PAIR_RULES, group: tuple[str, ...] = ()) -> DataFrame:
    """All issues of all pairs (key, source, target, status, src_lang, tgt_lang): the rules on one pair, and both on consistency."""
    parts = [pair_issues(pairs, key, rules=rules), *[_found(pairs, key, r, list(group)) for r in CONSISTENCY]]
    return reduce(DataFrame.unionByName, parts)


def apply_changes(pairs: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The pairs after an edit: ``changes`` has the changed and new rows, with ``removed`` for those that go (null: false)."""
    kept = lacking(pairs, changes, key)
    return kept.unionByName(changes.where(~F.coalesce("removed", F.lit(False))).select(*pairs.columns))


def rerun(pairs: DataFrame, changes: DataFrame, before: DataFrame, key: list[str], rules: tuple[str, ...] = PAIR_RULES, group: tuple[str, ...] = ()) -> DataFrame:
    """The issues after an edit, from those before it (key, rule, severity, dismissed).

    Equal to ``full_run`` over the pairs after the edit, with dismissals taken
    over by key and rule. A key comes at most once in ``changes``. Pairs are
    sieved by the keys, sources and targets that the edit touches; just those
    rows are shuffled and judged.
    """
    keys = changes.select(*key).distinct()
    new = changes.where(~F.coalesce("removed", F.lit(False))).select(*pairs.columns)
    old = having(pairs, keys, key).select("source", "target")
    touched = materialise(old.unionByName(new.select("source", "target")), "touched")
    after = apply_changes(pairs, changes, key)
    anew = [pair_issues(new, key, rules=rules)]
    kept = [before.where(~F.col("rule").isin(*CONSISTENCY)).join(keys, key, "left_anti")]
    for rule, side in zip(CONSISTENCY, ("source", "target"), strict=True):
        near = having(after, touched.where(F.col(side).isNotNull()).select(side), [side])
        near = materialise(near.select(*key, "source", "target", *group), "near")
        anew.append(_found(near, key, rule, list(group)))
        judged = near.select(*key).unionByName(keys).distinct()
        kept.append(before.where(F.col("rule") == rule).join(judged, key, "left_anti"))
    found = qa.carried(reduce(DataFrame.unionByName, anew), before, key)
    return reduce(DataFrame.unionByName, kept).select(*key, "rule", "severity", "dismissed").unionByName(found)
