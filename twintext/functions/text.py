"""Text expressions: normalisation, hashes, words, keys. Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space, what separates words, and the typographic variants that count as one character.
SPACE = "[\t-\r    -     　﻿]"
SEPARATOR = "[\t-\r    -​    　﻿]"
VARIANTS = "‘’‚‛′“”„‟«»″–—‒   ­"
CANONICAL = "'''''" + '"""""""' + "---" + "   "  # the soft hyphen has no counterpart and goes
READABLE = r"[\p{L}\p{N}]"
FUZZY_TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+"
CONCORDANCE_WORD = r"[\p{L}\p{M}\p{N}]+"
UNSPACED = ("zh", "ja", "th", "lo", "km", "my", "bo")
ENDINGS = {"de": ("e", "en", "er", "es", "em", "n", "s"), "es": ("s", "es"), "fr": ("s", "x", "e", "es"), "en": ("s", "es")}


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M")))


def nfc(text: Column) -> Column:
    """Only texts with a character from U+0300 go to Python; all others are in NFC already."""
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


def normalize(text: Column) -> Column:
    """NFC, typographic variants folded, white space collapsed and trimmed; case stays."""
    folded = F.replace(F.translate(nfc(text), VARIANTS, CANONICAL), F.lit("…"), F.lit("..."))
    return F.regexp_replace(F.regexp_replace(folded, SPACE + "+", " "), "^ | $", "")


def text_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def count_words(text: Column) -> Column:
    """Runs between separators that hold a letter or a digit."""
    return F.size(F.filter(F.split(text, SEPARATOR + "+"), lambda w: w.rlike(READABLE))).cast("long")


def primary_subtag(lang: Column) -> Column:
    return F.split(F.lower(lang), "[-_]")[0]


def has_spaced_words(lang: Column) -> Column:
    return ~primary_subtag(lang).isin(*UNSPACED)


def segment_words(text: Column, locked: Column, fallback_copy: Column) -> Column:
    return F.when(locked | fallback_copy, F.lit(0)).otherwise(count_words(text)).cast("long")


def term_key(text: Column) -> Column:
    return F.lower(normalize(text))


def fold(text: Column) -> Column:
    """Without marks and in lower case; ASCII texts stay in the JVM."""
    return F.lower(F.coalesce(_unmarked(F.when(text.rlike("[^\\x{0}-\\x{7f}]"), text)), text))


def concordance_text(text: Column) -> Column:
    """The folded words between single spaces, with one at either end, so that a phrase is a substring."""
    words = F.regexp_extract_all(text, F.lit(CONCORDANCE_WORD), F.lit(0))
    return F.concat(F.lit(" "), fold(F.array_join(words, " ")), F.lit(" "))


def fuzzy_words(text: Column) -> Column:
    """Lower-case words; every numeral is one class ``#``.

    The words are joined, changed as one text and split again, which takes no
    lambda: neither step moves a word's bounds.
    """
    joined = F.array_join(F.regexp_extract_all(text, F.lit(FUZZY_TOKEN), F.lit(0)), " ")
    found = F.split(F.regexp_replace(F.lower(joined), r"\p{N}[\p{N}.,]*", "#"), " ")
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(found)


def numerals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{N}+(?:[.,]\p{N}+)*"), F.lit(0))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def email_key(text: Column) -> Column:
    """An address as it is compared: trimmed, in lower case."""
    return F.lower(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""))


def tmx_to_iso(text: Column) -> Column:
    """``20240131T120000Z`` as ISO 8601 with milliseconds; null for anything else."""
    parts = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$", "$1-$2-$3T$4:$5:$6.000Z")
    good = F.coalesce(F.try_to_timestamp(F.regexp_replace(parts, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss.SSS ")).isNotNull(), F.lit(False))
    return F.when(text.rlike(r"^\d{8}T\d{6}Z$") & good, parts)


def iso_to_tmx(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\.\d+", ""), "[-:]", "")


def is_calendar_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")


def whole_word(text: Column, needle: Column, lang: str | None = None) -> Column:
    """Whether ``needle`` (a key) occurs in the text as whole words, its last one with a known ending or none."""
    endings = "|".join(ENDINGS.get(lang or "", ()))
    suffix = f"(?:{endings})?" if endings else ""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), escape_regex(needle), F.lit(suffix + r"(?![\p{L}\p{N}])"))
    return F.regexp_like(F.lower(text), pattern)


def whole_word_spans(text: Column, needle: Column, lang: str | None = None) -> Column:
    """Spans (start, end) of the places that ``whole_word`` finds, endings included; empty for a null needle."""
    endings = "|".join(ENDINGS.get(lang or "", ()))
    suffix = f"(?:{endings})?" if endings else ""
    pattern = F.concat(F.lit("^"), escape_regex(needle), F.lit(suffix + r"(?![\p{L}\p{N}])"))
    low, size = F.lower(text), F.length(needle)
    starts = F.when(F.length(low) >= size, F.sequence(F.lit(1), F.length(low) - size + 1)).otherwise(F.array().cast("array<int>"))
    before = lambda i: (i > 1) & F.regexp_like(F.substr(low, i - 1, F.lit(1)), F.lit(r"[\p{L}\p{N}]"))
    starts = F.filter(starts, lambda i: (F.substr(low, i, size) == needle) & ~before(i))
    spans = F.transform(starts, lambda i: F.struct(i.alias("start"), (i + F.length(F.regexp_substr(F.substr(low, i), pattern))).alias("end")))
    return F.coalesce(F.filter(spans, lambda x: x["end"] > x["start"]), F.array().cast("array<struct<start:int,end:int>>"))


def csv_cell(text: Column) -> Column:
    """A cell that no spreadsheet reads as a formula, quoted where needed."""
    safe = F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def fuzzy_origin(score: Column) -> Column:
    return F.concat(F.lit("tm_fuzzy_"), score.cast("string"))


def fuzzy_score_of(origin: Column) -> Column:
    return F.nullif(F.regexp_extract(origin, r"^tm_fuzzy_(\d{1,3})$", 1), F.lit("")).cast("int")


def tier_for_origin(origin: Column) -> Column:
    score = fuzzy_score_of(origin)
    return (
        F.when(origin.isin("tm_exact", "tm_exact_tagdiff", "propagated"), "exact").when(origin == "tm_ice", "ice")
        .when(score.between(95, 99), "fuzzy_95_99").when(score.between(85, 94), "fuzzy_85_94")
        .when(score.between(75, 84), "fuzzy_75_84").when(score.between(50, 74), "fuzzy_50_74").otherwise("no_match")
    )


#: Tiers in the order in which they are listed and paid.
TIERS = ("exact", "ice", "fuzzy_95_99", "fuzzy_85_94", "fuzzy_75_84", "fuzzy_50_74", "no_match")


def format_micros(micros: Column, digits: int = 2) -> Column:
    """Micros (a long) as fixed-point text, half away from zero, without passing through floating point."""
    unit = 10 ** (6 - digits)
    whole = F.abs(micros) + F.lit(unit // 2)
    parts = F.floor(whole / F.lit(unit).cast("decimal(20,0)")).cast("long")
    text = F.lpad(parts.cast("string"), F.greatest(F.length(parts.cast("string")), F.lit(digits + 1)), F.lit("0"))
    sign = F.when((micros < 0) & (parts != 0), "-").otherwise("")
    return F.concat(sign, F.substr(text, F.lit(1), F.length(text) - digits), F.lit("."), F.right(text, F.lit(digits))) if digits else F.concat(sign, parts.cast("string"))
