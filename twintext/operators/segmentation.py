"""Sentence boundaries by rules that are data: abbreviations, ordinals, marks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from twintext.functions import tokens as K
from twintext.sources.inline import cut

# What ends a sentence, what trails it, and words with a dot that doesn't end one.
TERMINATORS = ".!?…"
SEPARATORS = "|"
TRAILING = "\"'»«”“’‘)]}›"
SPACED_CLOSING = "»”’›"
OPENERS = "\"'«‘(["
INVERTED = "¿¡"
ABBREVIATIONS = {
    "en": "mr mrs ms dr prof st vs etc e.g i.e inc ltd co corp no fig vol dept approx jr sr gen col sgt capt rev hon jan feb mar apr aug sept oct nov dec",
    "de": "bzw z.b d.h u.a usw ca dr prof hr fr str nr bd abs art evtl ggf inkl vgl s.o s.u zzgl mio mrd",
    "fr": "m mm mme mlle dr pr etc p.ex c.-à-d art no vol fig av bd env éd",
    "es": "sr sra srta dr dra prof etc p.ej ej núm pág vol art av ud uds aprox",
    "it": "sig sig.ra dott prof ecc es pag art n vol",
    "pt": "sr sra dr dra prof etc p.ex pág art n vol av",
    "nl": "dhr mevr dr prof enz bijv d.w.z blz nr art",
    "ko": "", "vi": "",
}
#: Longest word that a dot is looked up with.
LOOK_BACK = 40
_GAP, _SPACES = re.compile("[ \\u00a0\\u202f]+"), re.compile(r"\s*")
NUMBER_LED = frozenset(("no", "nr", "fig", "vol", "art", "núm", "pág", "n", "blz", "abs", "bd"))
ORDINALS = frozenset(("de", "nl"))


@dataclass(frozen=True)
class Rules:
    """Rules of one language; ``breaks`` and ``keeps`` are user patterns (before, after) that decide first."""

    lang: str
    abbreviations: frozenset[str]
    ordinals: bool
    inverted: bool
    extra: str = ""
    breaks: tuple[tuple[str, str], ...] = ()
    keeps: tuple[tuple[str, str], ...] = ()


def rules_for(lang: str, **changes) -> Rules:
    primary = re.split("[-_]", lang.lower())[0]
    if primary not in ABBREVIATIONS:
        raise ValueError(f"no segmentation rules for {lang}")
    return Rules(primary, frozenset(ABBREVIATIONS[primary].split()), primary in ORDINALS, primary == "es", **changes)


def _opens(text: str, at: int, inverted: bool) -> bool:
    """Whether a sentence may start here: upper case, caseless letters, digits, camel case, or a quote before one."""
    c = text[at : at + 1]
    if not c:
        return False
    if (inverted and c in INVERTED) or c.isdigit() or (c.isalpha() and c == c.upper()):
        return True
    if c in OPENERS:
        return _opens(text, at + 1, inverted) and text[at + 1] not in OPENERS
    word = re.match(r"[^\W\d_]+", text[at : at + 40])
    return bool(word) and bool(re.match(r"^[a-zß-ÿ]+[A-ZÀ-Þ]", word[0]))


def _after_trailing(text: str, at: int) -> int:
    while True:
        while at < len(text) and text[at] in TRAILING:
            at += 1
        gap = _GAP.match(text, at)
        mark = gap.end() if gap else at
        if gap and text[mark : mark + 1] and text[mark] in SPACED_CLOSING and (mark + 1 == len(text) or text[mark + 1].isspace()):
            at = mark + 1
            continue
        return at


def _dot_is_inner(text: str, dot: int, after: int, start: int, rules: Rules) -> bool:
    """Whether a dot belongs to a number, an initial or an abbreviation."""
    before = text[dot - 1 : dot]
    if before.isdigit():
        if dot - start < 2 * LOOK_BACK and re.fullmatch(r"\s*[^\W\d_]+\s+\d+", text[start:dot]) and text[start:dot].strip()[:1].isupper():
            return True
        if rules.ordinals and text[after : after + 1].isalpha() and not text[after].isupper():
            return True
    if before.isupper() and not text[dot - 2 : dot - 1].isalpha():
        return True
    # No abbreviation is longer than that.
    word = re.search(r"[^\s(\[\"'«“„]*$", text[max(0, dot - LOOK_BACK) : dot])[0].lower()
    if word in rules.abbreviations:
        return word not in NUMBER_LED or text[after : after + 1].isdigit()
    return False


def boundaries(text: str, rules: Rules) -> list[int]:
    """Places at which a new segment starts; neither the start nor the end of the text is one."""
    decided: dict[int, bool] = {}
    for keep, patterns in ((True, rules.breaks), (False, rules.keeps)):
        for before, after in patterns:
            for m in re.finditer(f"(?:{before})(?={after})", text):
                decided[m.end()] = keep
    found, i, n = [], 0, len(text)
    first, last = n - len(text.lstrip()), len(text.rstrip()) - 1
    # Only marks are looked at, not every character.
    marks = re.compile("[" + re.escape(SEPARATORS + TERMINATORS + rules.extra) + "]")
    while (mark := marks.search(text, i)) is not None:
        i = mark.start()
        c = text[i]
        if c in SEPARATORS:
            if first < i < last:
                found.append(i + 1)
            i += 1
            continue
        end = i + 1
        while end < n and text[end] in TERMINATORS:
            end += 1
        run = text[i:end]
        at = _after_trailing(text, end)
        after = _SPACES.match(text, at).end()
        choice = decided.get(at)
        if choice is None:
            inner = run == ".." or (run == "." and _dot_is_inner(text, i, after, found[-1] if found else 0, rules))
            choice = after > at and not inner and _opens(text, after, rules.inverted)
        if choice and at < n:
            found.append(at)
        i = max(end, at if choice else end)
    found += [p for p, keep in decided.items() if keep and 0 < p < n]
    return sorted(set(found))


def sentences(text: str, rules: Rules) -> list[str]:
    cuts = [0, *boundaries(text, rules), len(text)]
    return [s for a, b in zip(cuts, cuts[1:], strict=False) if (s := text[a:b].strip())]


def segment_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every text's sentences in order (id, ``ord``, ``sentence``); texts of a language without rules stay whole.

    A line break always ends a sentence. Null texts have none.
    """
    known = {lang: rules_for(lang) for lang in ABBREVIATIONS}

    @F.pandas_udf(ArrayType(StringType()))
    def split(text: pd.Series, lang: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(text, lang, strict=True):
            rules = known.get(re.split("[-_]", (k or "").lower())[0])
            lines = [x for x in (t or "").split("\n") if x.strip()]
            out.append([s for x in lines for s in sentences(x, rules)] if rules else [x.strip() for x in lines])
        return pd.Series(out)

    return docs.select(id_col, F.posexplode(split(F.col(text_col), F.col(lang_col))).alias("ord", "sentence"))


def split_at(rows: DataFrame, file_col: str, at: Column) -> DataFrame:
    """Splits the segments for which ``at`` is a place inside (code points from 0) and numbers the file anew."""
    from pyspark.sql import Window

    inside = (at > 0) & (at < F.length("text"))
    parts = F.when(inside, F.array(F.substr("text", F.lit(1), at), F.substr("text", at + 1))).otherwise(F.array("text"))
    w = Window.partitionBy(file_col).orderBy("ord", "part")
    out = rows.select("*", F.posexplode(parts).alias("part", "piece"))
    return out.withColumn("new_ord", F.row_number().over(w) - 1).drop("text", "part").withColumnRenamed("piece", "text")


def segment_tokens(rows: DataFrame, key: list[str], tokens_col: str = "tokens", lang_col: str = "lang") -> DataFrame:
    """Token streams cut at their sentences: key, ``ord`` within the stream, ``start`` (place in its visible text) and tokens.

    Pairs that a cut goes through are closed and opened again; pieces without
    text are dropped, and tags are numbered anew in each. A language without
    rules isn't cut.
    """
    known = {lang: rules_for(lang) for lang in ABBREVIATIONS}

    @F.pandas_udf(f"array<struct<start:int,tokens:{K.TOKENS}>>")
    def split(streams: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for stream, lang in zip(streams, langs, strict=True):
            tokens = [(x["t"], x["v"], x["id"], x["k"]) for x in (stream if stream is not None else ())]
            text = "".join(v if t == "text" else "￼" for t, v, _, _ in tokens if t in ("text", "ph"))
            rules = known.get(re.split("[-_]", (lang or "").lower())[0])
            pieces = cut(tokens, boundaries(text, rules) if rules else [])
            out.append([{"start": start, "tokens": [dict(zip(("t", "v", "id", "k"), x, strict=True)) for x in piece]} for piece, start in pieces])
        return pd.Series(out)

    found = rows.select(*key, F.posexplode(split(F.col(tokens_col), F.col(lang_col))).alias("ord", "x"))
    return found.select(*key, "ord", "x.start", "x.tokens")


def merge_next(rows: DataFrame, file_col: str, chosen: Column) -> DataFrame:
    """Joins each chosen segment with the next one of its paragraph and numbers the file anew.

    ``rows`` has ord, para_key, tokens and status; a run of chosen segments
    becomes one. Tags of the later part get ids beyond the first's. A segment
    that is locked, or next to one that is, or the last of its paragraph,
    stays as it is. What is joined is new again: no status, no origin.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(file_col).orderBy("ord")
    same = F.lead("para_key").over(w).eqNullSafe(F.col("para_key")) & F.lead("ord").over(w).isNotNull()
    free = (F.col("status") != "locked") & (F.lead("status").over(w) != "locked")
    rows = rows.withColumn("__on", F.coalesce(chosen & same & free, F.lit(False)))
    begins = ~F.coalesce(F.lag("__on").over(w), F.lit(False))
    rows = rows.withColumn("__group", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shift = F.coalesce(F.array_max(F.transform("tokens", lambda x: F.coalesce(x["id"], F.lit(0)))), F.lit(0))
    part = F.struct("ord", "tokens", shift.alias("most"), "status", "para_key")
    groups = rows.groupBy(file_col, "__group").agg(F.array_sort(F.collect_list(part)).alias("p"))
    state = F.struct(F.array().cast(K.TOKENS).alias("tokens"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        moved = F.transform(x["tokens"], lambda y: F.struct(y["t"].alias("t"), y["v"].alias("v"), (y["id"] + acc["most"]).cast("int").alias("id"), y["k"].alias("k")))
        return F.struct(F.concat(acc["tokens"], moved).alias("tokens"), (acc["most"] + x["most"]).cast("int").alias("most"))

    tokens = K.joined(F.aggregate("p", state, step, lambda acc: acc["tokens"]))
    status = F.when(F.size("p") > 1, "new").otherwise(F.element_at("p", 1)["status"])
    out = groups.select(file_col, F.element_at("p", 1)["ord"].alias("__ord"), F.element_at("p", 1)["para_key"].alias("para_key"), tokens.alias("tokens"), status.alias("status"), F.size("p").alias("parts"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(file_col).orderBy("__ord")) - 1).drop("__ord")


_SRX = "{http://www.lisa.org/srx20}"


def read_srx(content: str, lang: str) -> Rules:
    """Rules of a language from an SRX file: the base rules with the file's patterns, which decide first.

    A language is mapped by the first pattern that fits its tag; all that fit,
    if the file cascades. A pattern that can't be compiled is refused.
    """
    root = ET.fromstring(content)
    header = root.find(f"{_SRX}header")
    cascade = header is not None and header.get("cascade") == "yes"
    maps = [m for m in root.iter(f"{_SRX}languagemap") if re.fullmatch(m.get("languagepattern", ""), lang)]
    names = [m.get("languagerulename") for m in (maps if cascade else maps[:1])]
    breaks, keeps = [], []
    for name in names:
        for group in (g for g in root.iter(f"{_SRX}languagerule") if g.get("languagerulename") == name):
            for rule in group.iter(f"{_SRX}rule"):
                pair = tuple((rule.findtext(f"{_SRX}{x}") or "") for x in ("beforebreak", "afterbreak"))
                for pattern in pair:
                    re.compile(pattern)
                (keeps if rule.get("break") == "no" else breaks).append(pair)
    return rules_for(lang, breaks=tuple(breaks), keeps=tuple(keeps))


def write_srx(rules: Rules) -> str:
    """The rules' own patterns and abbreviations as an SRX file of one language."""
    line = lambda how, before, after: f'<rule break="{how}"><beforebreak>{escape(before)}</beforebreak><afterbreak>{escape(after)}</afterbreak></rule>'
    words = [line("no", rf"\b(?i:{re.escape(w)})\.", r"\s") for w in sorted(rules.abbreviations)]
    body = [line("no", *x) for x in rules.keeps] + words + [line("yes", *x) for x in rules.breaks]
    return (
        '<?xml version="1.0" encoding="UTF-8"?><srx xmlns="http://www.lisa.org/srx20" version="2.0"><header segmentsubflows="yes" cascade="no"/><body><languagerules>'
        f'<languagerule languagerulename="{rules.lang}">{"".join(body)}</languagerule></languagerules><maprules><languagemap languagepattern="{rules.lang}.*" languagerulename="{rules.lang}"/></maprules></body></srx>'
    )


def word_list(text: str) -> frozenset[str]:
    """A list of words, one a line, as abbreviations; blank lines and comments (#) go."""
    return frozenset(w.strip().rstrip(".").lower() for w in text.splitlines() if w.strip() and not w.startswith("#"))
