"""Inline codes, slides, rules, glossaries and frames of exchange formats."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from twintext.functions import tokens as K
from twintext.operators import segmentation, units
from twintext.sources import readers, writers
from twintext.sources.inline import cut, tmx_stream

XLIFF = """<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0" version="2.0" srcLang="en" trgLang="de-AT"><file id="f"><unit id="1"><segment><source>A <pc id="1" type="fmt" subType="xlf:b">b<ph id="2"/></pc><mrk id="m">c</mrk><sc id="3"/>d<ec startRef="3"/><cp hex="001B"/></source>
<target>x<sc id="4"/></target></segment></unit></file></xliff>"""


def marks(tokens):
    return [(t["t"], t["v"] if t["t"] == "text" else t["id"]) for t in tokens]


def test_xliff_codes(spark, tmp_path):
    (tmp_path / "a.xlf").write_text(XLIFF)
    row = readers.read_xliff(spark, str(tmp_path / "a.xlf"), ("en-GB", "de")).first()
    assert marks(row.source_tokens) == [("text", "A "), ("open", 1), ("text", "b"), ("ph", 2), ("close", 1), ("open", 3), ("text", "c"), ("close", 3), ("open", 4), ("text", "d"), ("close", 4), ("text", "\x1b")]
    assert [(f["kind"], f["visible"]) for f in row.formats] == [("b", True), ("other", True), ("other", False), ("other", True)]
    assert marks(row.target_tokens) == [("text", "x"), ("ph", 1)]
    assert "not en to fr" in readers.read_xliff(spark, str(tmp_path / "a.xlf"), ("en", "fr")).first().error


def test_tmx_codes():
    x = tmx_stream('a <bpt i="1" type="bold">&lt;b></bpt>b<ept i="1">&lt;/b></ept><ph>&lt;br></ph><hi>c</hi><bpt i="2">q</bpt>')
    assert [(t, v if t == "text" else n, k) for t, v, n, k in x.tokens] == [("text", "a ", None), ("open", 1, "b"), ("text", "b", None), ("close", 1, None), ("ph", 2, "other"), ("open", 3, "other"), ("text", "c", None), ("close", 3, None), ("ph", 4, "other")]
    assert x.problems == 1 and tmx_stream("<broken").problems == 1


def test_cut_closes_and_opens():
    tokens = [("text", "One. ", None, None), ("open", None, 7, "b"), ("text", "Two. Three", None, None), ("close", None, 7, None), ("ph", None, 9, "br")]
    got = list(cut(tokens, [4, 9]))
    assert [(p, s) for p, s in got] == [
        ([("text", "One.", None, None)], 0),
        ([("text", " ", None, None), ("open", None, 1, "b"), ("text", "Two.", None, None), ("close", None, 1, None)], 4),
        ([("open", None, 1, "b"), ("text", " Three", None, None), ("close", None, 1, None), ("ph", None, 2, "br")], 9),
    ]


def deck():
    out, ns = io.BytesIO(), 'xmlns:a="a" xmlns:p="p" xmlns:r="r"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>')
        for n in (1, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld {ns}><a:p><a:r><a:rPr b="1"/><a:t>Slide {n}</a:t></a:r><a:br/></a:p></p:sld>')
        z.writestr("ppt/slides/_rels/slide2.xml.rels", '<Relationships><Relationship Id="r9" Target="../notesSlides/notesSlide1.xml"/></Relationships>')
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {ns}><a:p><a:r><a:t>Note</a:t></a:r></a:p></p:notes>")
    return out.getvalue()


def test_slides_in_playing_order(spark, tmp_path):
    (tmp_path / "d.pptx").write_bytes(deck())
    rows = readers.read_ooxml(spark, str(tmp_path / "d.pptx")).orderBy("ord").collect()
    assert [r.text for r in rows] == ["Slide 2\n", "Note", "Slide 1\n"] and marks(rows[0].tokens) == [("open", 1), ("text", "Slide 2"), ("close", 1), ("ph", 2)]
    assert [f["kind"] for f in rows[0].formats] == ["b", "br"]


def test_segments_of_tokens(spark):
    t = [("text", "One. ", None, None), ("open", None, 7, "b"), ("text", "Two.", None, None), ("close", None, 7, None), ("text", " Three", None, None)]
    rows = spark.createDataFrame([(1, t, "en", "p", "new"), (2, t[:1], "xx", "p", "new"), (3, None, "en", "p", "new")], f"k long, tokens {K.TOKENS}, lang string, para_key string, status string")
    got = segmentation.segment_tokens(rows, ["k"]).orderBy("k", "ord").collect()
    assert [(r.k, r.ord, r.start, marks(r.tokens)) for r in got] == [(1, 0, 0, [("text", "One.")]), (1, 1, 4, [("text", " "), ("open", 1), ("text", "Two."), ("close", 1)]), (1, 2, 9, [("text", " Three")]), (2, 0, 0, [("text", "One. ")])]
    file = spark.createDataFrame([("f", 0, t, "p", "new"), ("f", 1, t, "p", "draft"), ("f", 2, t[:1], "q", "draft"), ("f", 3, t[:1], "q", "locked")], f"file string, ord int, tokens {K.TOKENS}, para_key string, status string")
    out = segmentation.merge_next(file, "file", F.lit(True)).orderBy("ord").collect()
    assert [(r.ord, r.parts, r.status) for r in out] == [(0, 2, "new"), (1, 1, "draft"), (2, 1, "locked")]
    assert marks(out[0].tokens) == [("text", "One. "), ("open", 7), ("text", "Two."), ("close", 7), ("text", " ThreeOne. "), ("open", 14), ("text", "Two."), ("close", 14), ("text", " Three")]


def test_srx_round_trip():
    rules = segmentation.rules_for("en", breaks=((";", " then"),), keeps=((r"etc\.", " Yes"),))
    back = segmentation.read_srx(segmentation.write_srx(rules), "en-GB")
    assert (";", " then") in back.breaks and (r"etc\.", " Yes") in back.keeps
    assert segmentation.sentences("a; then b. Cc.", back) == ["a;", "then b.", "Cc."]
    assert segmentation.word_list("# x\nFoo.\n\nbar") == {"foo", "bar"}
    with pytest.raises(Exception):
        segmentation.read_srx(segmentation.write_srx(segmentation.rules_for("en", breaks=(("(", ""),))), "en")


def test_glossary_and_client_files(spark, tmp_path):
    entries = spark.createDataFrame([(k, f"t{k}", "de", f"r{k}", k % 3 == 0, k % 3 == 1) for k in (40, 7, 9, 12)], "term_id long, term string, lang string, rendering string, forbidden boolean, preferred boolean")
    rows = writers.glossary_rows(entries).orderBy("concept")
    assert [(r.concept, r.term, r.status) for r in rows.collect()] == [(1, "t7", "preferred"), (2, "t9", "forbidden"), (3, "t12", "forbidden"), (4, "t40", "preferred")]
    body = "".join(r.value for r in writers.tbx_entries(rows, "en").orderBy("concept").collect())
    (tmp_path / "g.tbx").write_text(f"<tbx>{body}</tbx>")
    back = readers.read_tbx(spark, str(tmp_path / "g.tbx"), "en").where("not is_source").orderBy("concept", "term").collect()
    assert sorted((r.term, r.status) for r in back) == sorted((f"r{k}", s) for k, s in ((7, "preferred"), (9, "forbidden"), (12, "forbidden"), (40, "preferred")))
    v = spark.createDataFrame([(1, "a", False, "en", "x", {"domain": "d", "secret": "s"})], "tu_id long, uuid string, deleted boolean, lang string, plain string, attrs map<string,string>")
    assert "secret" in writers.tmx_units(v, attrs=True).first().value
    value = writers.client_units(v).first().value
    assert "secret" not in value and '<prop type="domain">d</prop>' in value
    with pytest.raises(ValueError):
        writers.client_units(v, 0)
    writers.write_tmx(v, str(tmp_path / "out"))
    text = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part") and p.stat().st_size).read_text()
    assert text.startswith("<?xml") and text.rstrip().endswith("</tmx>")


def test_edits_and_confirming(spark):
    text = lambda x: [("text", x, None, None)]
    v = spark.createDataFrame([("a", "en", 1, "t0", text("old"), "old", "h", None, None, 1, 0, "t0", "t0"), ("b", "en", 1, "t0", [("ph", None, 1, "br")], "", "h", None, None, 1, 0, "t0", "t0")], f"uuid string, lang string, rev int, updated_at string, tokens {K.TOKENS}, plain string, hash string, prev_hash string, next_hash string, quality int, usage_count int, last_used_at string, created_at string")
    u = spark.createDataFrame([("a", 1, "t0", False), ("b", 1, "t0", False)], "uuid string, rev int, updated_at string, deleted boolean")
    h = v.select("uuid", "lang", "rev", "tokens", "quality").limit(0)
    m = units.Memory(u, v, h, v.select("uuid", "lang"), spark.createDataFrame([], "lang string, delta string"))
    edits = spark.createDataFrame([("a", "en", 1, " new "), ("b", "en", 1, "x"), ("c", "en", 1, "x"), ("a", "en", 0, "late")], "uuid string, lang string, base_rev int, text string")
    assert {(r.uuid, r.text): r.reason for r in units.edit_reasons(edits.where("base_rev = 1"), v, u).collect()} == {("a", "new"): None, ("b", "x"): "tagged", ("c", "x"): "not_found"}
    out = units.apply_edits(m, edits.where("base_rev = 1"), "t1")
    got = {r.uuid: r for r in out.variants.collect()}
    assert (got["a"].plain, got["a"].rev, got["a"].quality, got["a"].updated_at) == ("new", 2, 3, "t1") and got["b"].rev == 1
    assert [(r.uuid, r.rev) for r in out.history.collect()] == [("a", 1)] and [r.uuid for r in out.vectors.collect()] == ["b"]
    gone = units.retire(u, spark.createDataFrame([("a", 1), ("b", 9)], "uuid string, base_rev int"), "t2")
    assert {r.uuid: (r.deleted, r.rev) for r in gone.collect()} == {"a": (True, 2), "b": (False, 1)}
    new, history, stale = units.write_back(v, spark.createDataFrame([("a", "en", [("ph", None, 1, "b")], "x", 0, "t3"), ("n", "en", text("y"), "y", 2, "t3")], f"uuid string, lang string, tokens {K.TOKENS}, plain string, quality int, updated_at string"))
    assert {r.uuid: (r.rev, r.plain, r.quality) for r in new.collect()} == {"a": (2, "x", 1), "b": (1, "", 1), "n": (1, "y", 2)}
    assert [r.uuid for r in history.collect()] == ["a"] and [r.uuid for r in stale.collect()] == ["a"]
    seg = spark.createDataFrame([(1, text("s"), text("t"), "draft", "1", "1"), (2, text("s"), text(" "), "draft", "1", "1"), (3, text("s"), [("open", None, 1, None), *text("t")], "draft", "1", "1"), (4, text("s"), text("t"), "locked", "1", "1"), (5, text("s"), text("t"), "draft", "0", "1"), (6, text("s"), None, "draft", "1", "1")], f"id int, tokens {K.TOKENS}, target {K.TOKENS}, status string, base_updated_at string, updated_at string")
    seg = seg.withColumn("formats", F.array().cast(K.FORMATS))
    assert {r.id: r.reason for r in units.confirm_reasons(seg).collect()} == {1: None, 2: "blank", 3: "unbalanced", 4: "locked", 5: "stale", 6: "blank"}
    both = units.confirmed_variants(seg.where("id = 1").withColumn("hash", F.lit("h")), "en", "de").collect()
    assert [(r.lang, r.plain, r.quality) for r in both] == [("en", "s", 3), ("de", "t", 3)]
