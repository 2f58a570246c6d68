"""Archives: round trips through the splittable reader, and the format itself."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from twintext.llm import warc
from twintext.llm.warc import MAGIC, archived_pages, read_warc, write_warc
from twintext.stages import new_path

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (7, None, "<p>one</p>"), (3, "http://c.example/\r\nX-Source-Id: 9", "é日本"),
    (4, "http://d.example/", None), (5, "http://e.example/", ""), (6, "", "a\r\n\r\nb\r\n\r\n"), (8, "http://h.example/", "<p>x</p>" * 30000), (None, "http://n.example/", "<p>two</p>"),
]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    best = {}
    for page, _, html in rows:
        best.setdefault(html or "", []).append(page)
    keep = {h: max((p for p in ps if p is not None), default=None) for h, ps in best.items()}
    out = []
    for page, _, html in rows:
        first = page == keep[html or ""]
        out.append((page, len((html or "").encode()), sha1(html), "response" if first else "revisit", None if first else keep[html or ""]))
    return sorted(out, key=repr)


def archived(df):
    return sorted((tuple(r) for r in archived_pages(df).collect()), key=repr)


@pytest.mark.parametrize("split", [None, 700])
def test_pages_come_back(spark, monkeypatch, split):
    monkeypatch.setattr(warc, "SEGMENT", 5000)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = spark.createDataFrame(PAGES, SCHEMA).withColumn("digest", F.lit(1)).withColumn("response", F.lit("x"))
        assert archived(df) == expected(PAGES)
        path = new_path(spark, "warc")
        write_warc(df, path)
        got = {r.source_id: r for r in read_warc(spark, path).collect() if r.record_type != "warcinfo"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert bytes(got["8"].payload).decode() == "<p>x</p>" * 30000 and got["8"].record_type == "response"
    assert got["1"].payload is None and got["1"].refers_to == "7"
    assert got["3"].target_uri == "http://c.example/%0D%0AX-Source-Id: 9" and got["3"].source_id == "3"


def test_repeated_pages_and_empty_table(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (0, "u", "same")]
    assert [r[3] for r in archived(spark.createDataFrame(rows, SCHEMA))] == ["revisit", "response", "response"]
    assert archived(spark.createDataFrame([], SCHEMA)) == []


def test_payloads_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = [(i, None, f"page {i % 7}") for i in range(60)]
    assert archived(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_files_are_gzip_members_of_one_record(spark):
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), path)
    (file,) = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    assert gzip.decompress(file).count(b"WARC/1.1\r\n") == len(PAGES) + 1
    n = 0
    while file:
        member = zlib.decompressobj(31)
        assert member.decompress(file).startswith(b"WARC/1.1\r\nWARC-Type: ")
        file, n = member.unused_data, n + 1
    assert n == len(PAGES) + 1


def stored(record, level=0):
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


@pytest.mark.parametrize("size", [64, 200, 1000, 10**6])
@pytest.mark.parametrize("suffix", [".warc", ".warc.gz"])
def test_chance_magic_inside_members(spark, tmp_path, size, suffix):
    """Members that are stored uncompressed and full of the magic are read whole, wherever the ranges end."""
    rng = random.Random(size)
    payloads = [b"".join(rng.choice([MAGIC, MAGIC[:2], b"abcdefgh", bytes(rng.randrange(256) for _ in range(9))]) for _ in range(rng.randint(0, 120))) for _ in range(25)]
    records = [
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nX-Source-Id: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, i, len(p), p) for i, p in enumerate(payloads)
    ]
    (tmp_path / f"stored{suffix}").write_bytes(b"".join(stored(r, rng.choice([0, 6])) for r in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {int(r.source_id): bytes(r.payload) for r in read_warc(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(payloads))


def test_damage_is_an_error(spark, tmp_path):
    good = stored(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 6)
    (tmp_path / "cut.warc").write_bytes(good + good[:-9])
    with pytest.raises(Exception, match="damaged"):
        read_warc(spark, f"file://{tmp_path}").collect()
