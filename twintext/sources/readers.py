"""Readers of exchange formats: TMX and XLIFF, TBX and CSV glossaries, OOXML documents."""

from __future__ import annotations

import io
import posixpath
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.functions.text import tmx_to_iso
from twintext.sources.inline import Stream, aligned, paragraph_stream, tmx_stream, xliff_stream

LANG = "{http://www.w3.org/XML/1998/namespace}lang"
#: Most rows of a glossary file; more are refused.
MAX_TERM_ROWS = 20_000
_TOKEN_TYPE = "struct<tokens:" + K.TOKENS + ",problems:int>"


def read_tmx(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a TMX memory: uuid, changed (ISO 8601), usage_count, lang, primary_lang, plain, tokens, problems.

    Units are read row by row with the XML source, so one large file is split
    over tasks. Inline codes are tokens with their kinds; ``problems`` counts
    codes that don't pair or aren't known. A unit without an id has a null uuid.
    """
    schema = "_tuid string, _changedate string, _usagecount string, tuv array<struct<`_xml:lang`:string,_lang:string,seg:string>>"
    units = spark.read.format("xml").option("rowTag", "tu").option("ignoreNamespace", "true").schema(schema).load(path)
    rows = units.select(F.col("_tuid").alias("uuid"), F.col("_changedate").alias("changed"), F.col("_usagecount").cast("int").alias("usage_count"), F.explode("tuv").alias("v"))
    lang = F.coalesce("v.`_xml:lang`", "v._lang")

    @F.pandas_udf(_TOKEN_TYPE)
    def parse(segs: pd.Series) -> pd.DataFrame:
        found = [tmx_stream(s) for s in segs]
        return pd.DataFrame({"tokens": [_dicts(x) for x in found], "problems": [x.problems for x in found]})

    # Only segments with codes or entities go to Python.
    text = F.array(K.token("text", F.col("seg")))
    rows = rows.select("uuid", "changed", "usage_count", lang.alias("lang"), F.coalesce("v.seg", F.lit("")).alias("seg"))
    rows = rows.withColumn("x", parse(F.when(F.col("seg").rlike("[<&]"), F.col("seg")).otherwise("")))
    coded = F.col("seg").rlike("[<&]")
    rows = rows.withColumn("tokens", F.when(coded, F.col("x.tokens")).otherwise(text)).withColumn("problems", F.when(coded, F.col("x.problems")).otherwise(0))
    return rows.select("uuid", F.coalesce(tmx_to_iso(F.col("changed")), "changed").alias("changed"), "usage_count", "lang", F.split(F.lower("lang"), "[-_]")[0].alias("primary_lang"), K.plain_text(F.col("tokens")).alias("plain"), "tokens", "problems")


def new_units(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Units whose uuid the memory lacks: importing a file again, or resuming, adds nothing twice."""
    return units.join(memory.select("uuid").distinct(), "uuid", "left_anti")


def _dicts(stream: Stream) -> list[dict]:
    return [dict(zip(("t", "v", "id", "k"), x, strict=True)) for x in stream.tokens]


def _formats(stream: Stream) -> list[dict]:
    return [dict(zip(("id", "kind", "visible", "placement", "open", "close"), x, strict=True)) for x in stream.formats]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(node: ET.Element) -> str:
    """Text of a segment without the content of inline codes' data."""
    return (node.text or "") + "".join(_plain(x) + (x.tail or "") for x in node)


def _xliff_rows(content: bytes, langs: tuple[str, str] | None = None) -> Iterator[tuple]:
    root = ET.fromstring(content)
    if not root.get("version", "").startswith("2"):
        raise ValueError("only XLIFF 2 is read")
    src, tgt, ord_ = root.get("srcLang"), root.get("trgLang"), 0
    primary = lambda x: (x or "").lower().replace("_", "-").split("-")[0]
    if langs and (primary(src), primary(tgt)) != tuple(map(primary, langs)):
        raise ValueError(f"the file is {src} to {tgt}, not {langs[0]} to {langs[1]}")
    for unit in (x for x in root.iter() if _local(x.tag) == "unit"):
        for seg in (x for x in unit if _local(x.tag) in ("segment", "ignorable")):
            parts = {_local(x.tag): x for x in seg}
            source = _plain(parts["source"]) if "source" in parts else ""
            target = _plain(parts["target"]) if "target" in parts else None
            state = seg.get("state", "initial")
            locked = unit.get("translate") == "no" or not source.strip()
            status = "locked" if locked else "new" if not target else "draft" if state == "initial" else "translated"
            streams = [xliff_stream(parts[x]) if x in parts else Stream() for x in ("source", "target")]
            streams[1] = aligned(streams[1], streams[0])
            yield unit.get("id"), unit.get("name"), ord_, src, tgt, source, target, status, _dicts(streams[0]), _formats(streams[0]), _dicts(streams[1]) if "target" in parts else None
            ord_ += 1


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relations of a part: id and whole name of the part that each leads to."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    return {x.get("Id", ""): posixpath.normpath(posixpath.join(folder, x.get("Target", ""))) for x in ET.fromstring(z.read(rels))}


def _slide_order(z: zipfile.ZipFile) -> list[str]:
    """Slides in the order in which they are played, each followed by its notes; none for other documents."""
    if "ppt/presentation.xml" not in z.namelist():
        return []
    to, out = _targets(z, "ppt/presentation.xml"), []
    for x in ET.fromstring(z.read("ppt/presentation.xml")).iter():
        slide = to.get(next((v for k, v in x.attrib.items() if k.startswith("{") and _local(k) == "id"), "")) if _local(x.tag) == "sldId" else None
        if slide:
            out += [slide, *[n for n in _targets(z, slide).values() if "notesSlides/" in n]]
    return out


def _docx_rows(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml|ppt/(slides|notesSlides)/[^/]+\.xml", n)]
        played = {n: i for i, n in enumerate(_slide_order(z))}
        numbers = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        order = lambda n: (not n.endswith("document.xml"), played.get(n, len(played)), numbers(n))
        ord_ = 0
        for part in sorted(parts, key=order):
            for n, para in enumerate(x for x in ET.fromstring(z.read(part)).iter() if _local(x.tag) == "p"):
                text = "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x.tag), "") for x in para.iter())
                if text.strip():
                    stream = paragraph_stream(para)
                    yield part, ord_, str(n), text, _dicts(stream), _formats(stream)
                    ord_ += 1


def _per_file(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    """One task reads one file at a time; a file that can't be parsed gives one row with its error."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found, error = [(name, None, *r) for r in parse(bytes(content))], None
                except (ET.ParseError, ValueError, KeyError, zipfile.BadZipFile) as x:
                    found, error = [], str(x)
                yield pd.DataFrame(found or [(name, error, *[None] * len(columns))] * bool(error), columns=["path", "error", *columns], dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, f"path string, error string, {schema}")


def read_xliff(spark: SparkSession, path: str, langs: tuple[str, str] | None = None) -> DataFrame:
    """Segments of XLIFF 2 files: unit, ord, languages, source, target, status, and the tokens of both sides.

    With ``langs`` (source, target) a file of other languages is refused.
    """
    schema = f"unit string, name string, ord int, src_lang string, tgt_lang string, source string, target string, status string, source_tokens {K.TOKENS}, formats {K.FORMATS}, target_tokens {K.TOKENS}"
    return _per_file(spark, path, schema, lambda content: _xliff_rows(content, langs))


def read_ooxml(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of text documents and slides (in playing order): part, ord, para_key, text, tokens and formats."""
    return _per_file(spark, path, f"part string, ord int, para_key string, text string, tokens {K.TOKENS}, formats {K.FORMATS}", _docx_rows)


def _native_rows(content: bytes) -> Iterator[tuple]:
    """Units of a desktop memory: a SQLite file with translation_memories and translation_units."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        memory = db.execute("SELECT id, source_language, target_language FROM translation_memories ORDER BY id").fetchone()
        if not memory or not all(memory[1:]):
            raise ValueError("no memory with a language pair")

        def plain(xml: str | None) -> str | None:
            try:
                return "".join(t.text or "" for e in ET.fromstring(xml or "") if e.tag == "Elements" for x in e if x.tag == "Text" for t in x if t.tag == "Value")
            except ET.ParseError:
                return None

        for guid, source, target in db.execute("SELECT guid, source_segment, target_segment FROM translation_units ORDER BY id"):
            sides = plain(source), plain(target)
            problem = ", ".join(name for name, x in zip(("source", "target"), sides, strict=True) if x is None)
            yield str(guid), memory[1], memory[2], *sides, f"unreadable {problem}" if problem else None
    except sqlite3.Error as x:
        raise ValueError(str(x)) from x
    finally:
        db.close()


def read_native_memory(spark: SparkSession, path: str) -> DataFrame:
    """Units of native desktop memories; a segment that can't be parsed is null, and ``problem`` says so."""
    return _per_file(spark, path, "uuid string, src_lang string, tgt_lang string, source string, target string, problem string", _native_rows)


def read_tbx(spark: SparkSession, path: str, src_lang: str) -> DataFrame:
    """Terms of a TBX glossary with their renderings: concept, lang, term, status."""

    def rows(content: bytes) -> Iterator[tuple]:
        for entry in (x for x in ET.fromstring(content).iter() if _local(x.tag) in ("termEntry", "conceptEntry")):
            for group in (x for x in entry.iter() if _local(x.tag) in ("langSet", "langSec")):
                for t in (x for x in group.iter() if _local(x.tag) in ("tig", "ntig", "termSec")):
                    note = next((x.text or "" for x in t.iter() if x.get("type") == "administrativeStatus"), "")
                    term = next((x.text or "" for x in t.iter() if _local(x.tag) == "term"), "")
                    status = "forbidden" if note.startswith(("deprecated", "superseded")) else "preferred" if note.startswith("preferred") else "allowed"
                    yield entry.get("id"), group.get(LANG), group.get(LANG, "").split("-")[0].lower() == src_lang, term, status

    return _per_file(spark, path, "concept string, lang string, is_source boolean, term string, status string", rows)


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a glossary (term, lang, rendering, status) with what is wrong with each, or null."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if rows.limit(MAX_TERM_ROWS + 1).count() > MAX_TERM_ROWS:
        raise ValueError(f"a glossary file has at most {MAX_TERM_ROWS} rows")
    for c in ("term", "lang", "rendering", "status"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    status = F.coalesce(F.lower(F.trim("status")), F.lit("preferred"))
    problem = (
        F.when(F.trim(F.coalesce("term", F.lit(""))) == "", "no term").when(~F.coalesce(F.col("lang").rlike("^[A-Za-z]{2,3}([-_][A-Za-z0-9]+)*$"), F.lit(False)), "bad language")
        .when(F.trim(F.coalesce("rendering", F.lit(""))) == "", "no rendering").when(~status.isin("preferred", "allowed", "forbidden", "avoid", "keep"), "bad status")
    )
    return rows.select("term", "lang", "rendering", status.alias("status"), problem.alias("problem"))


def sniff(files: DataFrame) -> DataFrame:
    """Media types of binary files by their first bytes."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("504B0304"), "application/zip").when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
    return files.select("path", "length", F.coalesce(kind, F.lit("application/octet-stream")).alias("media_type"))
