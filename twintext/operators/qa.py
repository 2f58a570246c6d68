"""Quality rules over segment pairs (source, target) as one wide projection of issues."""

from __future__ import annotations

import functools
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintext.functions import text as T
from twintext.functions import tokens as K
from twintext.stages import having, materialise

# Rules and their severity.
SEVERITY = {
    "tag.missing": "error", "tag.extra": "error", "tag.unbalanced": "error", "seg.empty": "error", "seg.untranslated": "warning",
    "consistency.target_differs": "warning", "consistency.source_differs": "info", "num.missing": "error", "num.altered": "warning",
    "punct.terminal": "info", "punct.brackets": "warning", "punct.inverted": "warning", "punct.spacing": "info", "term.glossary_mismatch": "warning",
}
# Brackets and quotes that balance, what may close a sentence, and list marks.
PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"))
PARITY = ('"', "“”„")
CLOSERS = r"[\s\"'“”‘’«»‹›)\]}]*\z"
TERMINAL = ".!?…"
ENUMERATOR = r"^\s*[0-9A-Za-z]{1,2}\)"
SPACES = "[ \u00a0\u202f\u2009]"
FOLLOWER = r"(?=$|[\s\"'”’»)\]}.,;:!?…])"
# Marks by language: no space before; a no-break space before; one after.
SPACING = {"fr": (",.", ";:!?»", "«"), "fr-ca": (",.;", ":»", "«"), "fr-ch": (",.;", "", ""), "": (",.;:", "", "")}
# Number marks by language: thousands, decimal. An unknown language has no decimal mark.
GROUP_SPACES = " \u00a0\u202f\u2009"
NUMBERS = {"en": (",", "."), "de": ("." + GROUP_SPACES, ","), "es": ("." + GROUP_SPACES, ","), "it": ("." + GROUP_SPACES, ","), "pt": ("." + GROUP_SPACES, ","), "nl": ("." + GROUP_SPACES, ","), "fr": (GROUP_SPACES, ",")}
NUMBER_TAGS = {"es-mx": (",", "."), "es-us": (",", "."), "de-ch": ("'’" + GROUP_SPACES, "."), "fr-ch": ("'’" + GROUP_SPACES, "."), "it-ch": ("'’" + GROUP_SPACES, ".")}
UNKNOWN_NUMBERS = (GROUP_SPACES, "")


def _by_tag(lang: str, tags: dict, primaries: dict, otherwise):
    """A table's entry for the whole tag, else for its primary subtag, else the general one."""
    tag = lang.lower().replace("_", "-")
    return tags.get(tag, primaries.get(tag.split("-")[0], otherwise))


NUMERAL = re.compile(r"[0-9]{1,3}(?:[ \u00a0\u202f\u2009][0-9]{3}(?![0-9]))+(?:[.,][0-9]+)?|[0-9]+(?:[.,'’][0-9]+)*")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def terminal_mark(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"([{TERMINAL}]){CLOSERS}", 1), F.lit(""))


def punct_terminal(source: Column, target: Column) -> Column:
    """One side ends with a sentence mark, the other doesn't."""
    return (F.trim(target) != "") & (terminal_mark(source).isNull() != terminal_mark(target).isNull())


def imbalances(text: Column) -> Column:
    """The families of brackets and quotes that don't balance, with their counts."""
    body = F.regexp_replace(text, ENUMERATOR, "")
    pairs = [F.when(_count(body, a) != _count(body, b), F.concat(F.lit(a + b), _count(body, a).cast("string"), F.lit("x"), _count(body, b).cast("string"))) for a, b in PAIRS]
    total = lambda marks: sum((_count(body, m) for m in marks[1:]), _count(body, marks[0]))
    quotes = [F.when(total(m) % 2 != 0, F.concat(F.lit(m[0]), total(m).cast("string"))) for m in PARITY]
    return F.array_compact(F.array(*pairs, *quotes))


def punct_brackets(source: Column, target: Column) -> Column:
    # Most texts have none of these marks, and so nothing that could be out of balance.
    marks = "".join(re.escape(m) for p in (*PAIRS, *PARITY) for m in "".join(p))
    return target.rlike(f"[{marks}]") & (F.size(F.array_except(imbalances(target), imbalances(source))) > 0)


def punct_inverted(target: Column) -> Column:
    """Spanish targets: more runs of closing than of opening marks."""
    runs = lambda pattern: F.regexp_count(target, F.lit(pattern))
    closing = lambda m: runs(rf"(?<![?!])[?!]*{re.escape(m)}[?!]*(?![?!]){FOLLOWER}")
    return (closing("?") > runs("(?<![¿¡])[¿¡]*¿[¿¡]*")) | (closing("!") > runs("(?<![¿¡])[¿¡]*¡[¿¡]*"))


def punct_spacing(target: Column, lang: str) -> Column:
    """Double spaces, a space before a mark that takes none, a missing or plain no-break space."""
    before, hard, after = _by_tag(lang, SPACING, SPACING, SPACING[""])
    others = "".join(m for m in before if m != ".")
    found = target.rlike(rf"{SPACES}(?:{SPACES}|[{others}]|\.(?!\.))")
    if hard:
        found = found | target.rlike(rf"[ \p{{L}}\p{{N}}][{hard}]{FOLLOWER}")
    if after:
        found = found | target.rlike(rf"[{after}][ \p{{L}}\p{{N}}]")
    return (F.trim(target) != "") & found


def untranslated(source: Column, target: Column) -> Column:
    return (source == target) & source.rlike(r"\p{L}")


def number_marks(lang: str) -> tuple[str, str]:
    return _by_tag(lang, NUMBER_TAGS, NUMBERS, UNKNOWN_NUMBERS)


@functools.cache
def _reading(marks: tuple[str, str]) -> re.Pattern:
    thousands, decimal = (re.escape(x) for x in marks)
    return re.compile(f"([0-9]{{1,3}}(?:[{thousands}][0-9]{{3}})+|[0-9]+)" + (f"(?:[{decimal}]([0-9]+))?" if decimal else "()"))


def _stripped(digits: str) -> str:
    return digits.lstrip("0") or digits[-1:]


def numeral_value(surface: str, lang: str) -> str | None:
    """A numeral as the language reads it; None if it wouldn't write it as one number."""
    m = _reading(number_marks(lang)).fullmatch(surface)
    return m and _stripped(re.sub("[^0-9]", "", m[1])) + (f".{m[2]}" if m[2] else "")


def compare_numerals(source: str, target: str, src: str, tgt: str) -> tuple[list[str], list[str]]:
    """Numerals of the source missing from the target, and those found by their digits only.

    Each pass takes what the one before left: equal spelling, equal value,
    equal digits. What the target then has left still holds any number of
    source numerals whose parts it has, such as those of a date.
    """
    digits = lambda s: re.sub("[^0-9]", "", s)
    left, right = NUMERAL.findall(source), NUMERAL.findall(target)
    altered: list[str] = []
    for level, (key_s, key_t) in enumerate(((str, str), (lambda s: numeral_value(s, src), lambda s: numeral_value(s, tgt)), (digits, digits))):
        pool = Counter(k for s in right if (k := key_t(s)) is not None)
        spent: Counter = Counter()
        rest = []
        for s in left:
            k = key_s(s)
            if k is not None and pool[k] > 0:
                pool[k] -= 1
                spent[k] += 1
                if level == 2:
                    altered.append(s)
            else:
                rest.append(s)
        after = []
        for s in right:
            k = key_t(s)
            if k is not None and spent[k] > 0:
                spent[k] -= 1
            else:
                after.append(s)
        left, right = rest, after
    parts = lambda s: [_stripped(p) for p in re.findall("[0-9]+", s)]
    held = {_stripped(digits(s)) for s in right} | {p for s in right if numeral_value(s, tgt) is None for p in parts(s)}
    needs = lambda s: parts(s) if numeral_value(s, src) is None else [_stripped(digits(s))]
    return [s for s in left if not held.issuperset(needs(s))], altered


def number_issues(src: str, tgt: str):
    @F.pandas_udf("struct<missing:array<string>,altered:array<string>>")
    def issues(source: pd.Series, target: pd.Series) -> pd.DataFrame:
        found = [compare_numerals(s or "", t or "", src, tgt) for s, t in zip(source, target, strict=True)]
        return pd.DataFrame({"missing": [m for m, _ in found], "altered": [a for _, a in found]})

    return issues


def issues(pairs: DataFrame, key: list[str], src_lang: str, tgt_lang: str, rules: tuple[str, ...] = tuple(SEVERITY)) -> DataFrame:
    """One row per issue (key, rule, severity) of the rules on a single pair: seg, num and punct.

    ``pairs`` has source, target and status; a null target has no issue but
    ``seg.empty``. Where it has ``untranslated_allowed``, those pairs may stay
    as they are (a left join with the list by hash gives the column).
    """
    allowed = F.coalesce("untranslated_allowed", F.lit(False)) if "untranslated_allowed" in pairs.columns else F.lit(False)
    s, t = F.col("source"), F.coalesce("target", F.lit(""))
    there = F.col("target").isNotNull()
    numbers = number_issues(src_lang, tgt_lang)
    # Only pairs whose source has a digit go to Python.
    digits = s.rlike("[0-9]")
    rows = pairs.withColumn("__num", numbers(F.when(digits, s), F.when(digits, t))) if {"num.missing", "num.altered"} & set(rules) else pairs
    checks = {
        "seg.empty": F.col("status").isin("translated", "confirmed") & (F.trim(t) == ""), "seg.untranslated": there & untranslated(s, t) & ~allowed,
        "num.missing": there & (F.size("__num.missing") > 0) if "__num" in rows.columns else F.lit(False),
        "num.altered": there & (F.size("__num.altered") > 0) if "__num" in rows.columns else F.lit(False),
        "punct.terminal": there & punct_terminal(s, t), "punct.brackets": there & punct_brackets(s, t),
        "punct.inverted": there & punct_inverted(t) if tgt_lang.startswith("es") else F.lit(False), "punct.spacing": there & punct_spacing(t, tgt_lang),
    }
    found = F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(SEVERITY[r]).alias("severity"))) for r, c in checks.items() if r in rules])
    # Not compacted before: in a lambda's argument each condition would be interpreted.
    return rows.select(*key, F.explode(found).alias("i")).where("i is not null").select(*key, "i.rule", "i.severity")


def inconsistent(pairs: DataFrame, key: list[str], group: list[str] | None = None) -> DataFrame:
    """Pairs whose source has another target elsewhere, or whose target another source.

    ``group`` names columns of a plural group: its members may differ among
    themselves, so only pairs outside a pair's own group count (a null group
    is none). Least and greatest of all and of the own group are enough, so
    groups aren't gathered.
    """
    rules = (("source", "target", "consistency.target_differs"), ("target", "source", "consistency.source_differs"))
    found = [_differing(pairs, key, group or [], same, other).withColumn("rule", F.lit(rule)) for same, other, rule in rules]
    return found[0].unionByName(found[1])


def _differing(pairs: DataFrame, key: list[str], group: list[str], same: str, other: str) -> DataFrame:
    """Pairs (key) with an equal ``same`` and another ``other`` outside their own group."""
    if not group:
        # Digests of 128 bits are shuffled in place of the texts, and then only those of texts that differ.
        digest = lambda c: F.unhex(F.left(F.sha2(c, 256), F.lit(32))).alias(c)
        pairs = pairs.select(*key, digest(same), digest(other))
        several = pairs.groupBy(same).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo <> hi").select(same)
        return having(pairs, materialise(several, "several"), [same]).select(*key)
    # Two least and two greatest groups' values tell what lies outside any one group.
    own = F.when(F.concat(*[F.col(g).cast("string") for g in group]).isNotNull(), F.to_json(F.struct(*group))).otherwise(F.to_json(F.struct(*key)))
    rows = pairs.withColumn("__own", own)
    each = rows.groupBy(same, "__own").agg(F.min(other).alias("lo"), F.max(other).alias("hi"))
    low = Window.partitionBy(same).orderBy("lo", "__own")
    high = Window.partitionBy(same).orderBy(F.col("hi").desc(), "__own")
    ends = each.withColumn("i", F.row_number().over(low)).withColumn("j", F.row_number().over(high)).where("i <= 2 or j <= 2")
    ends = ends.groupBy(same).agg(F.array_sort(F.collect_list(F.struct("lo", "__own"))).alias("lows"), F.sort_array(F.collect_list(F.struct("hi", "__own")), asc=False).alias("highs"))
    outside = lambda c, v: F.try_element_at(F.filter(c, lambda x: x["__own"] != F.col("__own")), F.lit(1))[v]
    return rows.join(ends, same).where((outside("lows", "lo") != F.col(other)) | (outside("highs", "hi") != F.col(other))).select(*key)


def carried(issues_now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Issues with ``dismissed`` carried over from the last run by key and rule."""
    old = before.where("dismissed").select(*key, "rule", F.lit(True).alias("__was")).distinct()
    return issues_now.join(old, [*key, "rule"], "left").select(*issues_now.columns, F.coalesce("__was", F.lit(False)).alias("dismissed"))


def marks(found: DataFrame, key: list[str]) -> DataFrame:
    """Per segment: worst open severity and number of open issues."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    out = found.groupBy(*key).agg(F.max(rank).alias("__r"), F.count(F.lit(1)).alias("n"))
    return out.select(*key, F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("__r") + 1).alias("worst"), "n")


def tag_issues(pairs: DataFrame, key: list[str], source_col: str = "source_tokens", target_col: str = "target_tokens") -> DataFrame:
    """Tags missing from or extra in the target, and tags that don't nest: rule, severity and what is wrong.

    ``message`` lists the ids, or the codes of ``structure_errors``; they count
    for each role apart.
    """
    s, t = F.col(source_col), F.col(target_col)
    ids = lambda x: F.array_join(F.array_distinct(F.concat(x["pairs"], x["placeholders"])).cast("array<string>"), ",")
    rows = pairs.select(*key, ids(K.missing_tags(s, t)).alias("tag.missing"), ids(K.missing_tags(t, s)).alias("tag.extra"), F.array_join(F.transform(K.structure_errors(t), lambda e: F.concat_ws(" ", e["code"], e["id"].cast("string"))), "; ").alias("tag.unbalanced"))
    rules = ("tag.missing", "tag.extra", "tag.unbalanced")
    found = F.array_compact(F.array(*[F.when(F.col(f"`{r}`") != "", F.struct(F.lit(r).alias("rule"), F.lit(SEVERITY[r]).alias("severity"), F.col(f"`{r}`").alias("message"))) for r in rules]))
    return rows.select(*key, F.explode(found).alias("i")).select(*key, "i.*")


def next_open(rows: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """For each segment the place of the next one that is neither confirmed nor locked."""
    w = Window.partitionBy(file_col).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_open", F.min(F.when(~F.col("status").isin("confirmed", "locked"), F.col("ord"))).over(w))


def glossary_issues(mismatches: DataFrame, key: list[str]) -> DataFrame:
    return mismatches.select(*key, F.lit("term.glossary_mismatch").alias("rule"), F.lit(SEVERITY["term.glossary_mismatch"]).alias("severity")).distinct()
