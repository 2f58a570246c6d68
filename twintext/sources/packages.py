"""Packages (zip documents) as rows of their parts, and back, byte for byte.

A package is read into a row per part, its paragraphs into a row per region.
Writing is the way back: segments are folded into paragraphs, paragraphs are
spliced into their parts, parts are put back in their packages. What nothing
was changed in is copied as it was stored, compressed, so a package without
edits comes back byte for byte, and of an edited one only the changed parts
differ. No task holds more than one package.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.sources import ooxml

#: Parts that hold text, by format: the paragraph element, and the prefix of runs.
TEXT_PARTS = r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml|ppt/(slides|notesSlides)/[^/]+\.xml"
PARTS = "path string, entry int, part string, content binary, stored binary, central binary, tail binary, error string"
REGIONS = f"path string, part string, ord int, key string, parent string, xml string, text string, tokens {K.TOKENS}, formats {K.FORMATS}, error string"
EDITS = "path string, part string, key string, xml string, error string"
_FIELDS = {"tokens": ("t", "v", "id", "k"), "formats": ("id", "kind", "visible", "placement", "open", "close")}


def _schema(ddl: str, **nested: pa.DataType) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    tokens = pa.list_(pa.struct([("t", pa.string()), ("v", pa.string()), ("id", pa.int32()), ("k", pa.string())]))
    formats = pa.list_(pa.struct([("id", pa.int32()), ("kind", pa.string()), ("visible", pa.bool_()), ("placement", pa.string()), ("open", pa.string()), ("close", pa.string())]))
    kinds |= {K.TOKENS: tokens, K.FORMATS: formats}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ", 1) for f in re.split(r", (?![^<]*>)", ddl))])


def _entries(path: str, content: bytes) -> Iterator[dict]:
    """The parts of a package in the order of its directory: as stored, with their directory records, and unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos, start = z.infolist(), z.start_dir
        order = sorted(infos, key=lambda x: x.header_offset)
        ends = {x.header_offset: y.header_offset for x, y in zip(order, order[1:], strict=False)}
        at = start
        for i, info in enumerate(infos):
            sizes = struct.unpack("<3H", content[at + 28 : at + 34])
            central = content[at : at + 46 + sum(sizes)]
            at += len(central)
            if max(info.file_size, info.compress_size, info.header_offset) >= 0xFFFFFFFF:
                raise ValueError("packages of 4 GiB and more are not read")
            unpacked = z.read(info) if re.fullmatch(r".*\.(xml|rels)", info.filename) else None
            yield {
                "path": path, "entry": i, "part": info.filename, "content": unpacked, "central": central, "error": None,
                "stored": content[info.header_offset : ends.get(info.header_offset, start)], "tail": content[at:] if i == len(infos) - 1 else None,
            }


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The parts of zip documents: ``path``, ``entry`` (place in the directory), ``part`` (name), ``content`` (of XML
    parts), and ``stored``, ``central`` and ``tail``, the bytes that ``write_packages`` puts back.

    A file that is no package gives one row with its ``error`` and its bytes as ``stored``.
    """
    schema = _schema(PARTS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    found = list(_entries(name, content))
                except (zipfile.BadZipFile, ValueError, NotImplementedError, RuntimeError, struct.error, zlib.error) as x:
                    found = [dict.fromkeys(schema.names) | {"path": name, "stored": content, "error": str(x) or type(x).__name__}]
                yield pa.RecordBatch.from_pylist(found, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, PARTS)


def _paragraph(part: str) -> tuple[str, str]:
    return ("a:p", "a") if part.startswith("ppt/") else ("w:p", "w")


def _decoded(content: bytes) -> str:
    return content.decode("utf-8")


def read_regions(parts: DataFrame) -> DataFrame:
    """The paragraphs of text parts in document order: ``ord``, ``key`` (unique in the part), ``parent`` (the paragraph
    that a text box's lies in), ``xml``, and its ``text``, ``tokens`` and ``formats``.

    Regions without a letter are returned too. A part that can't be followed
    gives one row with its ``error``.
    """
    schema = _schema(REGIONS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                path, part, content = (batch.column(k)[i].as_py() for k in range(3))
                base = dict.fromkeys(schema.names) | {"path": path, "part": part}
                try:
                    xml = _decoded(content)
                    found = []
                    for n, r in enumerate(ooxml.regions(xml, _paragraph(part)[0])):
                        own = ooxml.region_xml(xml, r)
                        stream = ooxml.region_stream(own)
                        listed = {name: [dict(zip(fields, x, strict=True)) for x in getattr(stream, name)] for name, fields in _FIELDS.items()}
                        found.append(base | listed | {"ord": n, "key": r.key, "parent": r.parent.key if r.parent else None, "xml": own, "text": ooxml.readable(stream)})
                except (ooxml.MarkupError, UnicodeDecodeError) as x:
                    found = [base | {"error": str(x)}]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    text = parts.where(F.col("part").rlike(f"^(?:{TEXT_PARTS})$") & F.col("content").isNotNull())
    return text.select("path", "part", "content").mapInArrow(rows, REGIONS)


def fold_paragraphs(segments: DataFrame) -> DataFrame:
    """Edits (path, part, key, xml) of the paragraphs of which a segment has a target.

    ``segments`` has path, part, key, para_ord, source_tokens, target_tokens
    (null: none) and formats. A paragraph's segments are joined in order, each
    with its target or else its source, and a space where neither side brings
    one. A paragraph without any target is no edit: its markup stays. One that
    can't be rendered gives an ``error`` and no xml.
    """
    schema = _schema(EDITS)
    piece = F.struct("para_ord", F.coalesce("target_tokens", "source_tokens").alias("tokens"), "formats")
    grouped = segments.groupBy("path", "part", "key").agg(F.array_sort(F.collect_list(F.struct("para_ord", F.struct(piece.alias("x")).alias("x")))).alias("pieces"), F.max(F.col("target_tokens").isNotNull()).alias("some"))
    grouped = grouped.where("some").select("path", "part", "key", F.transform("pieces", lambda p: p["x"]["x"]).alias("pieces"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pieces = [([tuple(t[f] for f in _FIELDS["tokens"]) for t in p["tokens"] or []], [tuple(f[k] for k in _FIELDS["formats"]) for f in p["formats"] or []]) for p in row["pieces"]]
                base = {k: row[k] for k in ("path", "part", "key")}
                try:
                    out.append(base | {"xml": ooxml.render(*ooxml.fold(pieces), _paragraph(row["part"])[1]), "error": None})
                except ooxml.MarkupError as x:
                    out.append(base | {"xml": None, "error": str(x)})
            yield pa.RecordBatch.from_pylist(out, schema)

    return grouped.mapInArrow(rows, EDITS)


def splice_parts(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """The parts with ``changed``: the new content of those that edits (path, part, key, xml) are for, null in the others.

    Of several edits of one region the ASCII-least stands. An edit without xml
    is none. A region that a part doesn't have is an ``error`` of that part,
    which then stays as it is.
    """
    once = edits.where("xml is not null").groupBy("path", "part", "key").agg(F.min("xml").alias("xml"))
    per_part = once.groupBy("path", "part").agg(F.collect_list(F.struct("key", "xml")).alias("edits"))
    rows = parts.join(per_part, ["path", "part"], "left")
    same = rows.where("edits is null or content is null").select(*parts.columns, F.lit(None).cast("binary").alias("changed"))
    out = f"{PARTS}, changed binary"
    schema = _schema(out)

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                (row,) = batch.slice(i, 1).to_pylist()
                todo = {e["key"]: e["xml"] for e in row.pop("edits")}
                try:
                    row["changed"] = ooxml.splice(_decoded(row["content"]), _paragraph(row["part"])[0], todo).encode("utf-8")
                except (ooxml.MarkupError, UnicodeDecodeError) as x:
                    row |= {"changed": None, "error": str(x)}
                yield pa.RecordBatch.from_pylist([row], schema)

    order = [f.name for f in schema][:-1]
    return same.select(*order, "changed").unionByName(rows.where("edits is not null and content is not null").select(*order, "edits").mapInArrow(splice, out))


def _repacked(rows: list[dict]) -> bytes:
    """A package from its parts: unchanged ones as stored, changed ones deflated, and a directory with the new places."""
    out, directory = [], []
    placed, at = {}, 0
    for row in sorted(rows, key=lambda r: _offset(r["central"])):
        stored, central = row["stored"], bytearray(row["central"])
        if row["changed"] is not None:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = packer.compress(row["changed"]) + packer.flush()
            sizes = struct.pack("<3I", zlib.crc32(row["changed"]), len(data), len(row["changed"]))
            local = bytearray(stored[: 30 + sum(struct.unpack("<2H", stored[26:30]))])
            for head, flags, method, sums in ((local, 6, 8, 14), (central, 8, 10, 16)):
                # The sizes stand in the header, so none follow the data.
                head[flags : flags + 2] = struct.pack("<H", struct.unpack("<H", head[flags : flags + 2])[0] & ~8)
                head[method : method + 2] = struct.pack("<H", zipfile.ZIP_DEFLATED)
                head[sums : sums + 12] = sizes
            stored = bytes(local) + data
        central[42:46] = struct.pack("<I", at)
        placed[row["entry"]] = bytes(central)
        out.append(stored)
        at += len(stored)
    directory = b"".join(placed[k] for k in sorted(placed))
    tail = bytearray(next(r["tail"] for r in rows if r["tail"] is not None))
    end = tail.index(b"PK\x05\x06")
    tail[end + 12 : end + 20] = struct.pack("<2I", len(directory), at)
    return b"".join([*out, directory, bytes(tail)])


def _offset(central: bytes) -> int:
    return struct.unpack("<I", central[42:46])[0]


def write_packages(parts: DataFrame) -> DataFrame:
    """Packages (path, content) from the rows of ``splice_parts`` or ``read_packages``; files that were none come back as they were."""
    parts = parts if "changed" in parts.columns else parts.withColumn("changed", F.lit(None).cast("binary"))

    def whole(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        content = rows[0]["stored"] if rows[0]["part"] is None else _repacked(rows)
        return pa.table({"path": pa.array([rows[0]["path"]], pa.string()), "content": pa.array([content], pa.binary())})

    needed = parts.select("path", "entry", "part", "stored", "central", "tail", "changed")
    return needed.groupBy("path").applyInArrow(whole, "path string, content binary")


def export_packages(parts: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages with the targets of their segments written in, and what each file took of them: path, paragraphs,
    paragraphs_rendered, segments and segments_with_target."""
    edits = fold_paragraphs(segments)
    target = F.col("target_tokens").isNotNull()
    per_paragraph = segments.groupBy("path", "part", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(target.cast("long")).alias("t"))
    summary = per_paragraph.groupBy("path").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum((F.col("t") > 0).cast("long")).alias("paragraphs_rendered"), F.sum("n").alias("segments"), F.sum("t").alias("segments_with_target"),
    )
    return write_packages(splice_parts(parts, edits)), summary
