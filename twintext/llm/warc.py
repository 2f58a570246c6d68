"""WARC archives: a writer, and a reader that splits them.

Archives are WARC 1.1 files, each record a gzip member of its own. Records with
equal payloads are stored once: one is a ``response``, the others ``revisit``
it. A block of more than ``SEGMENT`` bytes is cut into a record and its
``continuation`` records, so a member is small however long a page is.

Both ways go through Spark's text source, which reaches any store that Spark
does. Its line separator can be any bytes. On writing it is the zero byte that
ends every member of less than 16 MiB (the highest byte of its size). On
reading it is the gzip magic: tasks scan byte ranges for it, and a task owns
the records that start in its range. Compressed data can hold the magic by
chance, so what follows one is only a candidate: it starts a record if its
first bytes decode to a WARC header, and goes on until its member ends. What is
left at a range's ends (the rest of a member behind a chance magic) is joined
afterwards, a member at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from twintext.llm.storage import BROADCAST_BYTES, materialise, new_path, per_shard

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Most bytes of a block in one record; a member ends in a zero byte below 16 MiB.
SEGMENT = 4 << 20
#: Least payload that is stored once.
MIN_BYTES = 0
#: Shards of the rows of one payload, where the payloads are too many to broadcast.
SHARDS = 64
#: Where a file begins that is read in one piece.
WHOLE = -1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("9d2f2c1e-5a0b-4c53-8f0e-2a4f7e1b6c55")

_FIELDS = "record_type string, record_id string, target_uri string, source_id string, refers_to string, payload_bytes bigint, payload_digest string"
RECORD = f"{_FIELDS}, payload binary"
#: What a task found: records, cut records, and the ends of ranges with their place.
_FOUND = f"kind string, {RECORD}, file string, begin bigint, seq int, segment int, segments_of string, raw binary"
_NULLS = {f.split()[0]: None for f in _FOUND.split(", ")}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(digest: str, page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{digest}:{page}')}>"


def _member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    # Without a time or a name in its header, a member depends on its record alone.
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _uri(url: str | None) -> str | None:
    """Control characters would end a header line."""
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def members(page: str | None, url: str | None, payload: bytes, response: bool, refers_to: str | None, place: str) -> Iterator[bytes]:
    """The gzip members of one capture: a revisit, or a response and its continuations."""
    digest = base32_sha1(payload)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Source-Id", page), ("X-Payload-Length", str(len(payload)))]
    if not response:
        named = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, place)}>"), *common]
        yield _member([*named, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(digest, refers_to)), ("X-Refers-To-Id", refers_to)], b"")
        return
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    size, origin = len(head) + len(payload), _name(digest, page)
    named = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("Content-Type", "application/http; msgtype=response")]
    if size <= SEGMENT:
        yield _member(named, head + payload)
        return
    first = SEGMENT - len(head)
    yield _member([*named, ("WARC-Segment-Number", "1"), ("X-Segments", place)], head + payload[:first])
    cuts = range(first, len(payload), SEGMENT)
    for n, cut in enumerate(cuts, 2):
        last = [("WARC-Segment-Total-Length", str(size))] if n == len(cuts) + 1 else []
        segment = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'{place}:{n}')}>"), ("WARC-Date", DATE)]
        yield _member([*segment, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n)), ("X-Segments", place), *last], payload[cut : cut + SEGMENT])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members without their last byte, which the line separator supplies."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'info:{part}')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    out, size, n = [info[:-1]], 0, 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page", "url", "html", "response", "refers_to")]
        for i in range(len(batch)):
            page, url, html, response, refers_to = (c[i].as_py() for c in columns)
            n += 1
            for member in members(page, url, (html or "").encode(), response, refers_to, f"{part}:{n}"):
                if member[-1]:
                    raise ValueError("a member of 16 MiB or more")
                out.append(member[:-1])
                size += len(member)
                if size >= SEGMENT:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a capture of every page to archives in the folder ``path``, one for each partition with rows.

    The payload is the text in UTF-8 (null: empty). Of pages with equal
    payloads of at least ``MIN_BYTES`` the one with the largest id (nulls are
    least) is a response and the others revisit it; a repeated row of that id
    is a response as well, so no row is lost. Other columns are ignored.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    groups = rows.where(F.octet_length("html") >= MIN_BYTES).groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    # Of most payloads there is one; only the others need their response.
    groups = materialise(groups.where("n > 1").select("digest", "keep"), "payloads")
    if groups.count() * 128 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        rows = rows.withColumn("__shard", F.pmod(F.xxhash64("id", "url"), F.lit(SHARDS)))
        dealt = per_shard(rows.select("digest", "__shard").distinct(), groups, ["digest"])
        rows = rows.join(dealt, ["digest", "__shard"], "left")
    response = F.col("keep").isNull() | F.col("id").eqNullSafe(F.col("keep"))
    packed = rows.select(F.col("id").cast("string").alias("page"), "url", "html", response.alias("response"), F.when(~response, F.col("keep").cast("string")).alias("refers_to"))
    packed = packed.mapInArrow(_pack, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode().strip().lower()] = v.decode().strip()
    return out


def _record(data: bytes) -> dict:
    """A decoded member as a row of ``_FOUND``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    row = _NULLS | {
        "kind": "record", "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "source_id": fields.get("x-source-id"), "refers_to": fields.get("x-refers-to-id"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    if "warc-segment-number" in fields:
        return row | {"kind": "segment", "segment": int(fields["warc-segment-number"]), "segments_of": fields.get("x-segments") or fields.get("warc-segment-origin-id", row["record_id"]), "raw": block}
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(fields.get("x-payload-length", 0))}
    http = fields.get("content-type", "").startswith("application/http")
    return _with_payload(row, block.partition(b"\r\n\r\n")[2] if http else block)


def _with_payload(row: dict, payload: bytes) -> dict:
    """Checks the payload against the digest that its record states."""
    digest = base32_sha1(payload)
    if row["payload_digest"] not in (None, digest):
        raise ValueError(f"record {row['record_id']} is damaged: its payload is not what its digest says")
    return row | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


class _Walk:
    """Pieces of a byte range, in order: each begins behind a magic."""

    def __init__(self, file: str, begin: int):
        self.file, self.begin, self.seq = file, begin, 0
        self.open = None  # the decoder of a member that has not ended
        self.data: list[bytes] = []
        self.raw: list[bytes] = []
        self.started = self.named = False  # a member has ended in this range; the open one's header is read

    def _rest(self, kind: str, raws: list[bytes]) -> list[dict]:
        self.seq += 1
        return [_NULLS | {"kind": kind, "file": self.file, "begin": self.begin, "seq": self.seq, "raw": b"".join(raws)}] if raws else []

    def _refuse(self) -> list[dict]:
        """What does not decode is the rest of a member that began in an earlier range."""
        if self.started:
            raise ValueError(f"{self.file} is damaged in the range from {self.begin}")
        (first, *later), self.open, self.data, self.raw = self.raw, None, [], []
        out = self._rest("rest", [first])
        for piece in later:  # too short to tell at first
            out += self.add(piece.removeprefix(MAGIC))
        return out

    def add(self, piece: bytes) -> list[dict]:
        if self.open is None:
            self.open, self.named = zlib.decompressobj(31), False
        self.raw.append(MAGIC + piece)
        try:
            self.data.append(self.open.decompress(MAGIC + piece))
        except zlib.error:
            return self._refuse()
        got = self.data[0] if len(self.data[0]) >= len(VERSION) else b"".join(self.data)[: len(VERSION)]
        if not (got.startswith(VERSION) or VERSION.startswith(got)):
            return self._refuse()
        self.named = got.startswith(VERSION)
        if not self.open.eof:
            return []
        if not got or self.open.unused_data.strip(b"\0"):
            return self._refuse()
        row, self.started = _record(b"".join(self.data)), True
        self.open, self.data, self.raw = None, [], []
        return [row]

    def end(self) -> list[dict]:
        raws, self.open = self.raw, None
        # What comes behind a whole member begins one, however little of it is here.
        return self._rest("begun" if self.started or self.named else "rest", raws)


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _scan(payloads: bool):
    schema = _arrow(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, out, size = None, [], 0
        for batch in batches:
            for i in range(len(batch)):
                piece, file, begin = (batch.column(k)[i].as_py() for k in range(3))
                if walk is None or (walk.file, walk.begin) != (file, begin):
                    out += walk.end() if walk else []
                    walk = _Walk(file, begin)
                    # Before the first magic of a file there is nothing.
                    pieces = piece.split(MAGIC) if begin == WHOLE else [piece]
                    if begin <= 0 and pieces.pop(0).strip(b"\0"):
                        raise ValueError(f"{file} does not begin with a gzip member")
                else:
                    pieces = [piece]
                for row in (row for p in pieces for row in walk.add(p)):
                    size += len(row["payload"] or row["raw"] or b"")
                    out.append(row if payloads else row | {"payload": None})
                if size >= SEGMENT:
                    yield _rows(out, schema)
                    out, size = [], 0
        out += walk.end() if walk else []
        if out:
            yield _rows(out, schema)

    return run


def _glue(payloads: bool):
    """Members whose parts lie in several ranges."""
    schema = _arrow(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by([("begin", "ascending"), ("seq", "ascending")])
        raw, out = b"".join(parts["raw"].to_pylist()), []
        while raw:
            decoder = zlib.decompressobj(31)
            data = decoder.decompress(raw)
            if not decoder.eof:
                raise ValueError(f"{parts['file'][0]} is damaged in the range from {parts['begin'][0]}")
            row = _record(data)
            out.append(row if payloads else row | {"payload": None})
            raw = decoder.unused_data.lstrip(b"\0")
        return pa.Table.from_pylist(out, schema)

    return run


def _unite(payloads: bool):
    """A record and its continuations."""
    schema = _arrow(RECORD)

    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by("segment")
        row = {f: parts[f][0].as_py() for f in schema.names}
        row = _with_payload(row, b"".join(parts["raw"].to_pylist()).partition(b"\r\n\r\n")[2])
        return pa.Table.from_pylist([row if payloads else row | {"payload": None}], schema)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``path``: a row for each, in no order.

    Columns: ``record_type``, ``record_id``, ``target_uri``, ``source_id`` (the
    id that ``write_warc`` was given), ``refers_to`` (that of the response that
    a revisit repeats), ``payload_bytes``, ``payload_digest`` (base32 SHA-1, of
    the full payload) and ``payload`` (null in revisits, and with
    ``payloads=False``). Payloads are checked against their digests; damaged
    archives are an error.

    Spark's text source would unpack files whose name ends in ``.gz``; these
    are read whole, in one task each (at most 2 GiB). Payloads that hold whole archives
    uncompressed could pass for records at the start of a range, and are found
    as damage.
    """
    options = {"lineSep": MAGIC.decode("latin-1"), "encoding": "ISO-8859-1"}
    text = spark.read.options(**options, pathGlobFilter="{*[!z],*[!g]z,*[!.]gz}").text(path)
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    pieces = text.select(F.col("value").cast("binary").alias("piece"), F.input_file_name().alias("file"), F.input_file_block_start().alias("begin"))
    pieces = pieces.unionByName(whole.select(F.col("content").alias("piece"), F.col("path").alias("file"), F.lit(WHOLE).cast("bigint").alias("begin")))
    found = materialise(pieces.mapInArrow(_scan(payloads), _FOUND), "records")
    # The few ends of ranges: each begun member goes on in the rests behind it.
    ends = found.where("kind in ('begun', 'rest')").select("file", "begin", "seq", "kind", "raw")
    places = F.sum(F.when(F.col("kind") == "begun", 1).otherwise(0)).over(_by_place()).alias("nth")
    names = [f.split()[0] for f in _FOUND.split(", ")]
    glued = ends.select("*", places).groupBy("file", "nth").applyInArrow(_glue(payloads), _FOUND).select(*names)
    every = found.where("kind in ('record', 'segment')").unionByName(glued)
    segments = every.where("kind = 'segment'").groupBy("segments_of").applyInArrow(_unite(payloads), RECORD)
    return every.where("kind = 'record'").select(*[f.split()[0] for f in RECORD.split(", ")]).unionByName(segments)


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("begin", "seq")


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages to archives in the shared folder, and gives the captures that are read back from them, without payloads.

    Returns a row per page: the id, ``payload_bytes``, ``payload_digest``,
    ``record_type`` (response or revisit) and ``refers_to``.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col)
    kind = pages.schema[id_col].dataType
    back = (lambda c: F.col(c)) if isinstance(kind, StringType) else (lambda c: F.col(c).cast(kind))
    records = read_warc(spark, path, payloads=False).where("record_type in ('response', 'revisit')")
    return records.select(back("source_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
