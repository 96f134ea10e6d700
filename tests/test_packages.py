"""Blocks written as packages and scanned back, against what the blocks say."""

import base64
import io
import json
import random
import zipfile
import xml.etree.ElementTree as ET

import pytest

from stratadoc.operators import cascade, ordered, validate
from stratadoc.sources import blocks as B
from stratadoc.sources import docx
from stratadoc.sources import package as P

NS = f'xmlns:w="{P.W}"'
STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi" w:ascii="Times"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="360" w:after="120"/></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="0"/><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr><w:rPr><w:b/><w:i w:val="0"/></w:rPr></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:multiLevelType w:val="multilevel"/><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:isLgl/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum>
<w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>"""
THEME = f'<a:theme xmlns:a="{P.A}"><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1></a:clrScheme><a:fontScheme name="x"><a:minorFont><a:latin typeface="Calibri"/><a:ea typeface=""/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
PNG = base64.b64encode(b"not really an image").decode()
CAPTIONS = {"Figure": {"prefix": "Figure ", "styleId": "Caption", "chapterPrefix": ["heading 1"]}}
BLOCKS = [
    {"type": "paragraph", "styleId": "H1", "content": "Top", "anchor": "top"},
    {"type": "paragraph", "styleId": "_hidden", "content": "out of the index"},
    {"type": "paragraph", "content": [{"text": "see\t"}, {"link": "https://example.com", "text": "there"}, {"text": " "}, {"refTo": {"type": "anchor", "name": "fig1"}, "display": "number"}, {"field": "page"}, {"break": "line"}]},
    {"type": "table", "rows": [[{"content": "a", "rowspan": 2}, "b", "c"], [{"content": "d", "colspan": 2}], ["e", "f", "g"]], "headerRows": 1, "borders": "three-line", "cols": [{"width": "2cm"}]},
    {"type": "table", "rows": [["alone"]]},
    {"type": "image", "src": "x.png", "data": PNG, "width": "72pt", "height": "1in"},
    {"type": "image", "src": "y.png", "data": PNG, "width": 10, "height": 10},
    {"type": "caption", "captionId": "Figure", "text": "A picture", "anchor": "fig1"},
    {"type": "caption-counter-reset", "captionId": "Figure", "newValue": 7},
    {"type": "caption", "captionId": "Figure", "text": ""},
    {"type": "paragraph", "content": "gone", "revision": "del"},
    {"type": "paragraph", "content": [{"text": "again"}, {"link": "https://example.com", "text": "there"}], "revision": "ins"},
    {"type": "page-break"},
    {"type": "horizontal-rule"},
    {"type": "equation", "mathml": "<math><mi>x</mi></math>"},
    {"type": "paragraph", "content": "", "paraFormat": {"lineSpacing": 1.5, "firstLineIndent": "2char", "indentLeft": "1cm", "alignment": "both", "spaceAfter": 0}},
]


@pytest.fixture(scope="module")
def package(spark):
    rows = [("d", i, json.dumps(b)) for i, b in enumerate(BLOCKS)] + [("e", 1, json.dumps({"type": "nothing"})), ("f", 1, json.dumps({"type": "paragraph", "content": "x"}))]
    got = B.write(spark.createDataFrame(rows, "doc_id string, ord int, block string"), CAPTIONS, {"styles": STYLES, "numbering": NUMBERING, "theme": THEME}).persist()
    assert [(r.doc_id, r.error) for r in got.where("error is not null").collect()] == [("e", "BlockError: no such block: nothing")]
    return docx.parts(got.where("content is not null")).persist()


def test_paragraphs_and_index(package):
    got = {r.para_seq: r for r in P.indexed(P.blocks(package)).where("doc_id = 'd'").collect()}
    texts = [got[k].text for k in sorted(got)]
    assert texts[:3] == ["Top", "out of the index", "see\t 1\n"]
    assert got[3].full_text == "see\tthere 1\n"
    cells = [(r.table_idx, r.t_row, r.t_col, r.t_para, r.text, r.para_index) for k, r in sorted(got.items()) if r.table_idx]
    assert cells == [(1, 1, 1, 1, "a", None), (1, 1, 2, 1, "b", None), (1, 1, 3, 1, "c", None), (1, 2, 1, 1, "", None), (1, 2, 2, 1, "d", None), (1, 3, 1, 1, "e", None), (1, 3, 2, 1, "f", None), (1, 3, 3, 1, "g", None), (2, 1, 1, 1, "alone", 4)]
    assert [r.para_index for k, r in sorted(got.items()) if k in (1, 2, 3)] == [1, None, 2]
    last = got[max(got)]
    assert (last.line_spacing, last.line_rule, last.first_line_indent_chars, last.indent_left, last.alignment, last.space_after) == (360, "auto", 200, 567, "both", 0)
    assert [r.has_break for k, r in sorted(got.items())].count(True) == 1
    assert [r.has_drawing for r in got.values()].count(True) == 2 and [r.has_math for r in got.values()].count(True) == 1


def test_fields_bookmarks_and_blockers(package):
    fields = [(r.field_type, r.target, r.linked, r.number_only, r.reset_to, r.seq_format) for r in P.field_details(P.fields(package)).where("doc_id = 'd'").orderBy("para_seq", "ord").collect()]
    assert fields == [
        ("REF", "fig1", True, True, None, None), ("OTHER", None, False, False, None, None),
        ("STYLEREF", "heading 1", False, True, None, None), ("SEQ", "Figure", False, False, None, "ARABIC"),
        ("SEQ", "Figure", True, True, 6, None),
        ("STYLEREF", "heading 1", False, True, None, None), ("SEQ", "Figure", False, False, None, "ARABIC"),
    ]
    assert [r.result for r in P.fields(package).where("instr like 'SEQ%'").orderBy("para_seq").collect()] == ["1", "", "7"]
    assert [(r.name, r.bookmark_id) for r in P.bookmarks(package).orderBy("para_seq").collect()] == [("top", 1), ("fig1", 2)]
    reasons = {(r.doc_id, r.reason) for r in ordered.blockers(P.events(package)).collect()}
    assert reasons == {("d", "field"), ("d", "tracked-change")}


def test_segments_lie_in_the_text(package):
    text = {(r.doc_id, r.para_seq): r.full_text for r in P.blocks(package).collect()}
    for s in P.segments(package).collect():
        assert text[s.doc_id, s.para_seq][s.start : s.stop] == s.text
    assert {r.region for r in P.segments(package).collect()} == {"body", "hyperlink", "ins"}


def test_styles_theme_and_numbering(package):
    s = P.with_theme(P.styles(package), P.theme(package)).where("doc_id = 'd'")
    base = s.where("id is null").first()
    assert (base.font_ascii, base.size, base.bold) == ("Calibri", 22, None)
    got = {r.id: r for r in cascade.resolve(s, P.LOOK[:3] + ["bold", "italic", "line_spacing", "num_id", "outline_level"], by=["doc_id"]).collect()}
    assert (got["H1"].bold, got["H1"].italic, got["H1"].line_spacing, got["H1"].num_id, got["H1"].outline_level) == (True, False, 360, "2", 0)
    levels = {r.level: r for r in P.numbering_levels(package).where("doc_id = 'd'").collect()}
    assert (levels[0].start, levels[0].num_fmt, levels[1].is_lgl, levels[1].num_fmt, levels[1].start) == (3, "upperRoman", True, "decimal", None)
    assert P.numbering_ids(package).where("doc_id = 'd'").first().overrides == {1: 5}
    assert P.sections(package).where("doc_id = 'd'").first()[2:5] == (11906, 16838, "portrait")


def test_packages_pass_their_checks(package):
    rels, uses = P.relationships(package), P.relationship_uses(package)
    assert validate.dangling(uses, rels).count() == 0 and validate.duplicate_ids(rels).count() == 0
    types = P.content_types(package)
    kind = lambda k, name: types.where(f"kind = '{k}'").select("doc_id", types["key"].alias(name))
    names = package.select("doc_id", "path").where("path <> '[Content_Types].xml'")
    assert validate.content_gaps(names, kind("override", "path"), kind("default", "ext")).count() == 0
    assert P.broken(package).count() == 0
    d = rels.where("doc_id = 'd' and part = 'word/document.xml'")
    assert d.where("external").count() == 1 and d.where("type = 'image'").count() == 1
    inside = d.where("not external").select("doc_id", d["target"].alias("path"))
    assert inside.join(names, ["doc_id", "path"], "left_anti").count() == 0


def test_same_blocks_same_bytes():
    once, again = (B.Document(CAPTIONS).package(BLOCKS) for _ in range(2))
    assert once == again


def test_grid_against_occupancy():
    rng = random.Random(3)
    for _ in range(200):
        rows = [[{"content": "", "rowspan": rng.choice([1, 1, 2]), "colspan": rng.choice([1, 1, 2])} for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        try:
            placed, width = B.grid(rows)
        except B.BlockError:
            continue
        for line in placed:
            spans = [(c, c + s) for _, _, c, s in line]
            assert spans[0][0] == 0 and spans[-1][1] == width and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert [sum(k == "cell" for k, *_ in line) for line in placed] == [len(r) for r in rows]
        for i, line in enumerate(placed):
            for kind, cell, col, span in line:
                if kind == "cell":
                    below = [x for later in placed[i + 1 : i + cell["rowspan"]] for x in later if x[2] == col]
                    assert all(x[0] == "carry" and x[3] == span for x in below) and len(below) == cell["rowspan"] - 1


@pytest.mark.parametrize("block", [{"type": "table", "rows": [[{"content": "x", "rowspan": 2}]]}, {"type": "caption", "captionId": "No", "text": ""}, {"type": "image", "src": "x.tiff", "data": "", "width": 1, "height": 1}, {"type": "equation"}, {"type": "paragraph", "content": "", "paraFormat": {"spaceAfter": "wide"}}])
def test_blocks_that_cannot_be_written(block):
    with pytest.raises(B.BlockError):
        B.Document().block(block)


def test_broken_and_empty_parts(spark):
    bad = spark.createDataFrame([("a", "word/document.xml", b"<w:document"), ("b", "word/document.xml", None), ("c", "word/document.xml", f"<w:document {NS}/>".encode())], "doc_id string, path string, content binary")
    for f in (P.blocks, P.segments, P.events, P.fields, P.bookmarks, P.sections, P.styles):
        assert f(bad).count() == 0
    assert [r.doc_id for r in P.broken(bad).orderBy("doc_id").collect()] == ["a", "b"]


def test_long_and_odd_style_chains(spark):
    rows = [(f"s{i}", f"s{i + 1}" if i < 40 else None, i if i == 40 else None) for i in range(41)] + [("x", "nowhere", 7), ("y", "y", 8), (None, "s1", 9)]
    d = spark.createDataFrame(rows, "id string, based_on string, size int")
    got = {r.id: r.size for r in cascade.resolve(d, ["size"]).collect()}
    assert got["s0"] == 40 and got["x"] == 7 and got["y"] == 8 and len(got) == 43
    assert cascade.closure(d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    from stratadoc.plans.tools import Packages

    heads = [("H1", "One"), (None, "body text"), ("H1", "Two"), (None, "图 3 说明"), (None, "")]
    d = [("d", i, json.dumps({"type": "paragraph", "content": t, **({"styleId": s} if s else {})})) for i, (s, t) in enumerate(heads)]
    d += [("d", 10, json.dumps({"type": "paragraph", "content": [{"text": "see needle"}, {"text": "s", "format": {"bold": True}}, {"refTo": {"type": "anchor", "name": "f"}}], "numbering": {"numId": 2, "level": 1}}))]
    d += [("d", 11, json.dumps({"type": "caption", "captionId": "Figure", "text": "x", "anchor": "f"})), ("d", 12, json.dumps({"type": "paragraph", "content": "lost", "numbering": {"numId": 9, "level": 0}}))]
    out = B.write(spark.createDataFrame(d, "doc_id string, ord int, block string"), CAPTIONS, {"styles": STYLES, "numbering": NUMBERING, "theme": THEME})
    return Packages(docx.parts(out).persist())


def test_labels_of_packages(corpus):
    assert [(r.para_seq, r.label) for r in corpus.labels().orderBy("para_seq").collect()] == [(1, "III."), (3, "IV."), (6, "4.5")]


def test_views_of_packages(corpus):
    o = corpus.overview().first()
    assert (o.paragraphs, o.indexed, o.sections, o.captions, o.numbered, o.empty, o.looks) == (8, 8, 1, 1, 3, 1, 3)
    assert [(r.para_seq, r.ch, r.first_run, r.last_run, r.cross_run) for r in corpus.find_text("needles").collect()] == [(6, 4, 0, 1, True)]
    assert [(r.identifier, r.number, r.cited) for r in corpus.captions().collect()] == [("Figure", "1", 1)]
    assert [r.para_seq for r in corpus.migrate_captions().collect()] == [4]
    assert [r.para_seq for r in corpus.around(1, 2).orderBy("para_seq").collect()] == [1, 2, 3]
    assert [r.para_seq for r in corpus.find_paragraphs("^(One|Two)$").orderBy("para_seq").collect()] == [1, 3]
    assert {(r.id, r.numbered_by, r.line_spacing, r.font_ascii) for r in corpus.style_definitions().collect()} == {("Normal", None, 360, "Calibri"), ("H1", "2", 360, "Calibri")}
    assert corpus.sections().first().paper == "A4" and corpus.heading_skips().count() == 0 and corpus.unused_styles().count() == 0
    looks = {r.label: (r.n, r.dominant_style, r.raw_fp) for r in corpus.fingerprints().collect()}
    assert looks["A"][0] > looks["B"][0] and looks["B"][2] == "Calibri|22|B||||L" and looks["B"][1] == "H1"
    assert [(r.part, r.message) for r in corpus.validate().collect()] == [("word/document.xml", "no numbering 9")]


def test_character_styles_come_between_the_run_and_the_paragraph(spark):
    from stratadoc.plans.tools import Packages

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    style = lambda kind, name, on, look: f'<w:style w:type="{kind}" w:styleId="{name}"><w:name w:val="{name}"/>{on}<w:rPr>{look}</w:rPr></w:style>'
    styles = f'<w:styles {ns}><w:docDefaults><w:rPrDefault><w:rPr><w:color w:val="111111"/></w:rPr></w:rPrDefault></w:docDefaults>' + style("paragraph", "P", "", '<w:sz w:val="20"/><w:b/><w:color w:val="222222"/>') + style("character", "Base", "", '<w:sz w:val="30"/>') + style("character", "Strong", '<w:basedOn w:val="Base"/>', '<w:i/>') + "</w:styles>"
    p = lambda run: f'<w:p><w:pPr><w:pStyle w:val="P"/></w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>text</w:t></w:r></w:p>'
    body = f'<w:document {ns}><w:body>{p("")}{p("<w:rStyle w:val=\'Strong\'/>")}{p("<w:rStyle w:val=\'Strong\'/><w:sz w:val=\'40\'/>")}{p("<w:rStyle w:val=\'Lost\'/>")}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    looks = Packages(docx.parts(spark.createDataFrame([("a", bytearray(out.getvalue()))], "doc_id string, content binary"))).looks()
    got = [(r.size, r.bold, r.italic, r.color) for r in looks.orderBy("para_seq").collect()]
    assert got == [(20, True, None, "222222"), (30, True, True, "222222"), (40, True, True, "222222"), (20, True, None, "222222")]
