"""Readers, writers and streams on files of their own."""

import sqlite3
import zipfile

from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.sources import readers, writers, xliff_export
from twintext.streaming import incoming

TMX = """<?xml version="1.0"?><tmx version="1.4"><header/><body>
<tu tuid="u1" usagecount="2" changedate="20240101T000000Z"><tuv xml:lang="en-US"><seg>Press <bpt i="1">&lt;b></bpt>OK<ept i="1">&lt;/b></ept></seg></tuv><tuv xml:lang="de"><seg>OK drücken</seg></tuv></tu>
<tu tuid="u2"><tuv xml:lang="en"><seg>Two</seg></tuv></tu></body></tmx>"""
XLIFF = """<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0" version="2.0" srcLang="en" trgLang="de"><file id="f"><unit id="1"><segment state="translated"><source>A <pc id="1">b</pc></source><target>C</target></segment>
<segment><source>D</source></segment></unit><unit id="2" translate="no"><segment><source>E</source><target>E</target></segment></unit></file></xliff>"""


def test_tmx(spark, tmp_path):
    (tmp_path / "a.tmx").write_text(TMX)
    rows = readers.read_tmx(spark, str(tmp_path / "a.tmx"))
    assert sorted((r.uuid, r.primary_lang, r.usage_count) for r in rows.collect()) == [("u1", "de", 2), ("u1", "en", 2), ("u2", "en", None)]
    left = readers.new_units(rows, rows.where("uuid = 'u1'"))
    assert [r.uuid for r in left.collect()] == ["u2"]


def test_tmx_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(1, "a", False, "en", 'x < "y"'), (1, "a", False, "de", "z"), (2, "b", True, "en", "gone")], "tu_id long, uuid string, deleted boolean, lang string, plain string")
    writers.write_tmx(v, str(tmp_path / "out"))
    back = readers.read_tmx(spark, str(tmp_path / "out"))
    assert sorted((r.uuid, r.lang, r.plain) for r in back.collect()) == [("a", "de", "z"), ("a", "en", 'x < "y"')]


def test_xliff(spark, tmp_path):
    (tmp_path / "a.xlf").write_text(XLIFF)
    (tmp_path / "b.xlf").write_text("<xliff version='1.2'/>")
    rows = readers.read_xliff(spark, str(tmp_path / "*.xlf")).orderBy("path", "ord").collect()
    assert [(r.unit, r.source, r.target, r.status) for r in rows[:3]] == [("1", "A b", "C", "translated"), ("1", "D", None, "new"), ("2", "E", "E", "locked")]
    assert rows[3].error


def test_xliff_export(spark, tmp_path):
    (tmp_path / "a.xlf").write_text(XLIFF)
    (tmp_path / "b.xlf").write_text(XLIFF)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.xlf"))
    targets = files.where("path like '%a.xlf'").select("path", F.posexplode(F.array(F.lit(None).cast("string"), F.lit("Neu"), F.lit("X"))).alias("ord", "target")).where("target is not null")
    out = {r.path[-5:]: bytes(r.content) for r in xliff_export.export_xliff(files, targets).collect()}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.xlf").write_bytes(out["a.xlf"])
    rows = readers.read_xliff(spark, str(tmp_path / "c/a.xlf")).orderBy("ord").collect()
    assert [(r.source, r.target, r.status) for r in rows] == [("A b", "C", "translated"), ("D", "Neu", "translated"), ("E", "E", "locked")] and out["b.xlf"] == XLIFF.encode()


def test_native_memory(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "m.db")
    db.execute("CREATE TABLE translation_memories (id INTEGER, source_language TEXT, target_language TEXT)")
    db.execute("CREATE TABLE translation_units (id INTEGER, guid TEXT, source_segment TEXT, target_segment TEXT)")
    db.execute("INSERT INTO translation_memories VALUES (1, 'en-US', 'de-DE')")
    db.execute("INSERT INTO translation_units VALUES (1, 'g', '<Segment><Elements><Tag><Type>Start</Type></Tag><Text><Value>Page </Value></Text><Text><Value>1</Value></Text></Elements></Segment>', '<broken')")
    db.commit()
    db.close()
    (tmp_path / "n.db").write_bytes(b"no database")
    rows = readers.read_native_memory(spark, str(tmp_path / "*.db")).orderBy("path").collect()
    assert (rows[0].uuid, rows[0].src_lang, rows[0].source, rows[0].target) == ("g", "en-US", "Page 1", None) and rows[1].error


def test_ooxml(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = readers.read_ooxml(spark, str(tmp_path / "*.docx")).orderBy("path", "ord").collect()
    assert [(r.part, r.ord, r.text) for r in rows[:2]] == [("word/document.xml", 0, "One\ttwo"), ("word/header1.xml", 1, "Head")] and rows[2].error


def test_glossaries(spark, tmp_path):
    (tmp_path / "g.csv").write_text('term,lang,rendering,status\n"in,voice",de,Rechnung,\n,de,x,allowed\na,??,x,\nb,de,y,odd\n')
    assert [(r.term, r.status, r.problem) for r in readers.read_glossary_csv(spark, str(tmp_path / "g.csv")).collect()] == [("in,voice", "preferred", None), (None, "allowed", "no term"), ("a", "preferred", "bad language"), ("b", "odd", "bad status")]
    (tmp_path / "g.tbx").write_text('<martif><termEntry id="c1"><langSet xml:lang="en"><tig><term>bill</term></tig></langSet><langSet xml:lang="de"><tig><term>Nota</term><termNote type="administrativeStatus">deprecatedTerm-admn-sts</termNote></tig></langSet></termEntry></martif>')
    assert sorted((r.term, r.is_source, r.status) for r in readers.read_tbx(spark, str(tmp_path / "g.tbx"), "en").collect()) == [("Nota", False, "forbidden"), ("bill", True, "allowed")]


def test_csv_lines(spark):
    rows = spark.createDataFrame([("=a", 1, None)], "x string, y int, z string")
    assert writers.csv_lines(rows, ["x", "y", "z"]).first().value == "'=a,1,"


def test_stream(spark, tmp_path):
    for i, texts in enumerate((["a  b", "c"], ["a b", "d"])):
        spark.createDataFrame([(t, f"2024-01-01 00:0{k}:00") for k, t in enumerate(texts)], "text string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    incoming.per_batch(incoming.arriving(stream), lambda b: b.select("text", "hash"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and out.select("hash").distinct().count() == 3


CODED = """<?xml version="1.0"?>
<x:xliff xmlns:x="urn:oasis:names:tc:xliff:document:2.0" version="2.0" srcLang="en" trgLang="de"><x:file id="f"><!-- <x:segment> --><x:unit id="1"><x:segment state='initial'><x:source>See <x:pc id="1" type="fmt">this</x:pc><x:ph id="2" disp="a&gt;b"/> &amp; that</x:source></x:segment>
<x:segment><x:source><x:sc id="3"/>Open</x:source><x:target/></x:segment><x:segment state="translated"><x:source>A<x:ph id="4"/>B<x:ph id="5"/></x:source><x:target>b<x:ph id="5"/>a<x:ph id="4"/></x:target></x:segment></x:unit><x:unit id="2" translate="no"><x:segment><x:source>No</x:source></x:segment></x:unit></x:file></x:xliff>
"""


def test_xliff_export_keeps_codes(spark, tmp_path):
    (tmp_path / "a.xlf").write_text(CODED)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.xlf"))
    rows = readers.read_xliff(spark, str(tmp_path / "*.xlf")).orderBy("ord").collect()
    assert [[(t.t, t.v, t.id) for t in r.target_tokens or []] for r in rows][2] == [("text", "b", None), ("ph", None, 2), ("text", "a", None), ("ph", None, 1)]
    text = lambda v: ("text", v, None, None)
    made = lambda *targets: spark.createDataFrame([(f"file:{tmp_path}/a.xlf", *t) for t in targets], f"path string, ord int, target_tokens {K.TOKENS}, status string")
    same = made((2, [tuple(x) for x in rows[2].target_tokens], "translated"))
    assert bytes(xliff_export.export_xliff(files, same).collect()[0].content) == CODED.encode()
    new = made((0, [("ph", None, 2, None), text("Siehe < "), ("open", None, 1, None), text("dies\x01"), ("close", None, 1, None)], "translated"), (1, [text("Auf")], "draft"), (2, [text("neu"), ("ph", None, 2, None)], "confirmed"), (3, [text("Nein")], "translated"))
    (out,) = xliff_export.export_xliff(files, new, reviewed=True).collect()
    want = CODED.replace("<x:segment state='initial'>", "<x:segment state='translated'>").replace("that</x:source>", 'that</x:source><x:target><x:ph id="2" disp="a&gt;b"/>Siehe &lt; <x:pc id="1" type="fmt">dies<cp hex="0001"/></x:pc></x:target>')
    want = want.replace("<x:target/>", "<x:target>Auf</x:target>").replace('<x:segment state="translated">', '<x:segment state="final">').replace('b<x:ph id="5"/>a<x:ph id="4"/>', 'neu<x:ph id="5"/>')
    assert out.error is None and bytes(out.content).decode() == want
    (bad,) = xliff_export.export_xliff(files, made((1, [("ph", None, 9, None)], "draft"))).collect()
    assert bad.error and bytes(bad.content) == CODED.encode()
