"""Documents through their rows and back: byte for byte where nothing changed, only the edited paragraphs where something did."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from twintext.sources import ooxml
from twintext.sources.packages import export_packages, read_packages, read_regions, splice_parts, write_packages

BODY = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="urn:w" mc:Ignorable="w14"><!-- <w:p> --><w:body>'
    '<w:p w:rsidR="1"><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>First &amp; best</w:t></w:r></w:p>'
    '<w:p><w:r w:rsidR="2"><w:rPr><w:b/></w:rPr><w:t>Bold</w:t></w:r><w:r><w:t xml:space="preserve"> plain</w:t><w:br/></w:r><w:proofErr w:type="x"/>'
    '<w:hyperlink r:id="a>b"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:p/>'
    "<w:p><w:r><w:drawing><wps:txbx><w:txbxContent><w:p><w:r><w:t>Inside box</w:t></w:r></w:p></w:txbxContent></wps:txbx></w:drawing></w:r><w:r><w:t>Around box</w:t></w:r></w:p>"
    '<w:sdt><w:sdtContent><w:p><w:r><w:rPr><w:lang w:val="de"/></w:rPr><w:t>Quiet run</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:sdtContent></w:sdt>'
    "</w:body></w:document>"
)
SLIDE = '<p:sld><a:p><a:r><a:rPr lang="en" b="1"/><a:t>Slide text</a:t></a:r><a:br/><a:fld id="f"><a:t>7</a:t></a:fld></a:p></p:sld>'


def package(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = b"kept"
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), content, compress_type=method)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.docx").write_bytes(package({"[Content_Types].xml": "<x/>", "word/document.xml": BODY, "word/media/i.png": bytes(range(256)), "word/footer2.xml": "<w:ftr><w:p><w:r><w:t>Foot</w:t></w:r></w:p></w:ftr>"}))
    (tmp_path / "b.pptx").write_bytes(package({"ppt/slides/slide1.xml": SLIDE, "docProps/app.xml": "<y/>"}, zipfile.ZIP_STORED))
    (tmp_path / "c.docx").write_bytes(b"no package")
    (tmp_path / "d.docx").write_bytes(package({"word/document.xml": "<w:p><w:r></w:p>"}))
    return tmp_path


def files(df):
    return {r.path.rpartition("/")[2]: bytes(r.content) for r in df.collect()}


def test_unchanged_packages_are_byte_equal(spark, folder):
    parts = read_packages(spark, f"file://{folder}")
    got = files(write_packages(parts))
    assert got == {p.name: p.read_bytes() for p in folder.iterdir()}
    assert files(write_packages(splice_parts(parts, spark.createDataFrame([], "path string, part string, key string, xml string")))) == got


def test_regions_and_their_errors(spark, folder):
    rows = read_regions(read_packages(spark, f"file://{folder}")).orderBy("path", "part", "ord").collect()
    texts = [(r.key, r.parent, r.text) for r in rows if r.part == "word/document.xml" and r.error is None]
    assert texts == [("p1", None, "First & best"), ("p2", None, "Bold plain￼link"), ("p3", None, ""), ("p4", None, "￼Around box"), ("p5", "p4", "Inside box"), ("p6", None, "Quiet run")]
    (bad,) = [r for r in rows if r.error]
    assert bad.path.endswith("d.docx") and "closes <w:r>" in bad.error
    (slide,) = [r for r in rows if r.part.startswith("ppt/")]
    assert slide.text == "Slide text￼￼" and [f.kind for f in slide.formats] == ["b", "br", "field"]


def segments(spark, regions, target):
    """A segment for each region; ``target`` gives its tokens or none."""
    return regions.where("error is null").select("path", "part", "key", F.lit(0).alias("para_ord"), F.col("tokens").alias("source_tokens"), target.alias("target_tokens"), "formats")


def test_only_edited_paragraphs_change(spark, folder):
    parts = read_packages(spark, f"file://{folder}").cache()
    regions = read_regions(parts)
    upper = F.transform("tokens", lambda t: F.struct(t["t"].alias("t"), F.upper(t["v"]).alias("v"), t["id"].alias("id"), t["k"].alias("k")))
    made = segments(spark, regions, F.when(F.col("key").isin("p2", "p4", "p5"), upper))
    content, summary = export_packages(parts, made)
    got = files(content)
    assert {r.path.rpartition("/")[2]: r.asDict() | {"path": 0} for r in summary.collect()}["a.docx"] == {"path": 0, "paragraphs": 7, "paragraphs_rendered": 3, "segments": 7, "segments_with_target": 3}
    for name in ("b.pptx", "c.docx", "d.docx"):
        assert got[name] == (folder / name).read_bytes()
    with zipfile.ZipFile(io.BytesIO(got["a.docx"])) as z:
        assert z.testzip() is None and z.comment == b"kept"
        new = z.read("word/document.xml").decode()
        assert z.read("word/media/i.png") == bytes(range(256)) and z.namelist()[0] == "[Content_Types].xml"
    head, tail = BODY.index('<w:r w:rsidR="2">'), BODY.index("</w:p><w:p/>")
    assert new.startswith(BODY[:head])
    assert '<w:r w:rsidR="2"><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">BOLD</w:t></w:r><w:r><w:t xml:space="preserve"> PLAIN</w:t></w:r><w:r><w:br/></w:r><w:proofErr w:type="x"/><w:hyperlink r:id="a>b"><w:r><w:t xml:space="preserve">LINK</w:t></w:r></w:hyperlink></w:p><w:p/>' in new
    assert "INSIDE BOX" in new and "AROUND BOX" in new and "Quiet run" in new and new.endswith(BODY[tail:][BODY[tail:].index("<w:sdt>") :])
    assert [n.name for n in ooxml.elements(new)] == ["w:document"]


def test_two_segments_fold_with_a_space_between(spark):
    tokens = lambda *x: [("text", v, None, None) if isinstance(v, str) else v for v in x]
    bold = [(1, "b", True, "run", "<w:r><w:rPr><w:b/></w:rPr>", "</w:r>")]
    a, b = tokens(("open", None, 1, "b"), "Eins.", ("close", None, 1, None)), tokens("Zwei.", ("open", None, 1, "b"), "drei", ("close", None, 1, None))
    xml = ooxml.render(*ooxml.fold([(a, bold), (b, bold)]))
    assert xml.count("<w:b/>") == 2 and re.sub("<[^>]*>", "", xml) == "Eins. Zwei.drei"
    assert re.sub("<[^>]*>", "", ooxml.render(*ooxml.fold([(tokens("One. "), []), (tokens("Two"), [])]))) == "One. Two"


def test_what_cannot_be_rendered_is_refused():
    pair = (1, "b", True, "run", "<w:r>", "</w:r>")
    for tokens in ([("open", None, 1, None)], [("close", None, 1, None)], [("ph", None, 1, None)], [("ph", None, 2, None)], [("text", "\x01", None, None)]):
        with pytest.raises(ooxml.MarkupError):
            ooxml.render(tokens, [pair])


def test_rendering_is_a_fixed_point():
    """What is rendered reads back as the same tokens, and renders to the same markup."""
    rng = random.Random(2)
    runs = ["<w:r><w:t>a &lt; b</w:t></w:r>", "<w:r><w:rPr><w:i/></w:rPr><w:t>it</w:t><w:tab/><w:t>x</w:t></w:r>", '<w:r><w:rPr><w:sz w:val="2"/></w:rPr><w:t> s </w:t></w:r>', "<w:r><w:rPr/></w:r>", '<w:bookmarkStart w:id="1"/>', "<w:r><w:t></w:t></w:r>"]
    for _ in range(200):
        inner = "".join(rng.choices(runs, k=rng.randint(0, 6)))
        xml = inner + f'<w:ins w:id="3">{"".join(rng.choices(runs, k=2))}</w:ins>' + "".join(rng.choices(runs, k=2))
        stream = ooxml.region_stream(xml)
        once = ooxml.render(stream.tokens, stream.formats)
        again = ooxml.region_stream(once)
        assert ooxml.readable(again) == ooxml.readable(stream)
        assert ooxml.render(again.tokens, again.formats) == once


def test_splices_against_plain_replacement():
    """Random nested paragraphs: edits of some, markers where edited ones hold others."""
    rng = random.Random(4)

    def paragraph(depth):
        inside = "".join(paragraph(depth + 1) if rng.random() < 0.3 and depth < 3 else f"<t>{rng.randrange(99)}</t>" for _ in range(rng.randint(0, 4)))
        return f"<p>{inside}</p>"

    for _ in range(100):
        xml = "<d>" + "".join(paragraph(0) + "<x/>" for _ in range(3)) + "</d>"
        found = ooxml.regions(xml, "p")
        own = {r.key: ooxml.region_xml(xml, r) for r in found}
        assert ooxml.splice(xml, "p", own) == xml == ooxml.splice(xml, "p", {})
        edits = {k: v.replace("<t>", "<u>").replace("</t>", "</u>") for k, v in own.items() if rng.random() < 0.5}
        new = ooxml.splice(xml, "p", edits)
        again = {r.key: ooxml.region_xml(new, r) for r in ooxml.regions(new, "p")}
        assert again == {k: edits.get(k, v) for k, v in own.items()}
    with pytest.raises(ooxml.MarkupError):
        ooxml.splice("<p>a</p>", "p", {"p2": ""})
