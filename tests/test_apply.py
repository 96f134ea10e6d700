"""Configurations applied to packages, read back."""

import json

import pytest

from stratadoc.plans import apply as P
from stratadoc.plans import config as C
from stratadoc.plans.tools import Packages
from stratadoc.sources import blocks as B
from stratadoc.sources import docx
from tests.test_packages import CAPTIONS, NUMBERING, STYLES, THEME

TEXTS = ["One", "two", "three", "1. four", "five"]


@pytest.fixture(scope="module")
def files(spark):
    rows = []
    for doc in ("a", "b"):
        texts = TEXTS if doc == "a" else TEXTS[:2]
        rows += [(doc, i, json.dumps({"type": "paragraph", "content": t, **({"styleId": "H1"} if i == 0 else {})})) for i, t in enumerate(texts)]
        rows += [(doc, 8, json.dumps({"type": "caption", "captionId": "Figure", "text": "old", "anchor": "f"})), (doc, 9, json.dumps({"type": "table", "rows": [["x", "y"], ["z", "w"]]}))]
    return B.write(spark.createDataFrame(rows, "doc_id string, ord int, block string"), CAPTIONS, {"styles": STYLES, "numbering": NUMBERING, "theme": THEME}).select("doc_id", "content").persist()


def read(out, doc="a"):
    p = Packages(docx.parts(out.where(f"doc_id = '{doc}' and error is null")))
    return p, [(r.style_id, r.full_text) for r in p.paragraphs.orderBy("para_seq").collect()]


def para(t):
    return [{"type": "paragraph", "content": t}]


def test_edits_and_rules(files):
    config = {
        "output": "x", "captions": CAPTIONS,
        "edits": [
            {"op": "insert-after", "at": {"type": "paragraph", "index": 2}, "content": para("A")},
            {"op": "insert-after", "at": {"type": "paragraph", "index": 2}, "content": para("B")},
            {"op": "replace", "at": {"type": "heading", "text": "One", "level": 0}, "with": [{"type": "paragraph", "content": [{"link": "https://x.org", "text": "Uno"}], "styleId": "H1"}]},
            {"op": "delete", "at": {"type": "cell", "table": 1, "row": 1, "col": 1}},
            {"op": "edit-caption", "target": {"captionId": "Figure", "index": 1}, "text": "new"},
            {"op": "merge", "at": {"type": "range", "from": 3, "to": 4}},
        ],
        "styles": [{"id": "Body"}, {"id": "Cut"}], "pattern_rules": [{"regex": "five", "style": "Body", "stripMatch": False}, {"regex": "thr", "style": "Cut", "stripMatch": True}], "exclude": [3],
        "pageSetup": {"paperSize": "Letter", "sections": {"1": {"orientation": "landscape", "margins": {"left": "1cm"}}}},
    }
    out = P.apply(files, config).persist()
    p, got = read(out)
    assert got == [("H1", "Uno"), (None, "two"), (None, "B"), (None, "A"), ("Cut", "ee1. four"), ("Body", "five"), ("Caption", "Figure 0-1 new"), (None, ""), (None, "y"), (None, "z"), (None, "w"), (None, "")]
    s = p.sections().first()
    assert (s.width, s.height, s.orientation, s.margin_left, s.margin_right, s.paper) == (15840, 12240, "landscape", 567, 1440, "Custom")
    assert [tuple(r) for r in p.validate().collect()] == []
    # The other document's third paragraph is its caption, which a merge may not touch.
    assert [(r.doc_id, "blocked (field)" in r.error) for r in out.where("error is not null").collect()] == [("b", True)]


def test_missing_and_blocked_targets(files):
    far = {"output": "x", "edits": [{"op": "delete", "at": {"type": "paragraph", "index": 5}}, {"op": "format", "at": {"type": "paragraph", "index": 5}, "styleId": "S"}]}
    errors = {r.doc_id: r.error for r in P.apply(files, far).collect()}
    assert "gone by an earlier edit" in errors["a"] and "nothing is at" in errors["b"]
    onto = {"output": "x", "edits": [{"op": "delete", "at": {"type": "paragraph", "index": 3}}]}
    errors = {r.doc_id: r.error for r in P.apply(files, onto).collect()}
    assert errors["a"] is None and "blocked (field)" in errors["b"]


def test_tracked_changes(files):
    config = {"output": "x", "trackChanges": True, "author": "me", "edits": [{"op": "delete", "at": {"type": "paragraph", "index": 2}}, {"op": "insert-before", "at": {"type": "paragraph", "index": 1}, "content": para("new")}]}
    p, got = read(P.apply(files, config))
    assert got[:3] == [(None, "new"), ("H1", "One"), (None, "")]
    assert {r.para_seq: r.reason for r in p.blockers().collect()} | {7: "field"} == {1: "tracked-change", 3: "tracked-change", 7: "field"}


def test_looks_by_label_and_runs(files):
    out = P.apply(files, {"output": "x", "styles": [{"id": "Text"}], "bulk_rules": [{"fingerprint": "A", "style": "Text"}], "assignments": [{"para": 2, "action": "keep"}]})
    assert [s for s, _ in read(out)[1]][:5] == ["H1", None, "Text", "Text", "Text"]
    out = P.apply(files, {"output": "x", "edits": [{"op": "set-run", "at": {"type": "run", "paragraph": 2, "runIndex": 1}, "with": "t\tw", "format": {"bold": True}}, {"op": "format", "at": {"type": "paragraph", "index": 3}, "runFormat": {"size": 9}, "paraFormat": {"alignment": "right"}}]})
    p, got = read(out)
    assert got[1] == (None, "t\tw")
    assert [(r.para_seq, r.bold, r.size) for r in p.runs.where("para_seq in (2, 3)").orderBy("para_seq").collect()] == [(2, True, None), (3, None, 18)]


def test_a_configuration_with_problems(files):
    with pytest.raises(C.ConfigError, match="output"):
        P.apply(files, {})


def test_what_a_configuration_installs(spark, files):
    config = {
        "output": "x",
        "styles": [
            {"id": "H1", "name": "heading 1", "size": 16, "bold": False, "spaceBefore": 6, "firstLineIndent": "2char"},
            {"id": "Sub", "basedOn": "heading 1", "outlineLevel": 1, "color": "FF0000", "overrides": {"color": "00FF00"}},
            {"id": "Lost", "basedOn": "nobody", "italic": True},
        ],
        "numbering": {"levels": [{"level": 0, "numFmt": "decimal", "lvlText": "%1. ", "styleId": "Sub", "start": 4}, {"level": 1, "numFmt": "lowerLetter", "lvlText": "%1.%2", "styleId": "Lost"}]},
        "theme": {"fonts": {"minorLatin": "Inter", "majorEastAsia": "Songti"}}, "requirements": {"H1": "large"},
        "pattern_rules": [{"regex": ".*four", "style": "Sub"}], "pageSetup": {"columns": {"widths": ["5cm", "6cm"], "spaces": ["1cm"]}, "pgNumType": {"fmt": "upperRoman", "start": 3}},
    }
    bad = spark.createDataFrame([("junk", bytearray(b"not a zip")), ("empty", bytearray(b""))], "doc_id string, content binary")
    out = P.apply(files.unionByName(bad), config).persist()
    errors = {r.doc_id: r.error for r in out.collect()}
    assert errors["a"] is None and errors["b"] is None and "BadZipFile" in errors["junk"] and "BadZipFile" in errors["empty"]
    p, got = read(out)
    assert got[3] == ("Sub", "four")  # its typed number is gone
    style = {r.id: r for r in p.styles.collect()}
    assert (style["H1"].size, style["H1"].bold, style["H1"].space_before, style["H1"].first_line_indent_chars, style["H1"].outline_level, style["H1"].based_on) == (32, False, 120, 200, 0, "Normal")
    assert (style["Sub"].color, style["Sub"].outline_level, style["Sub"].based_on, style["Sub"].num_id, style["Sub"].num_level) == ("00FF00", 1, "H1", "3", 0)
    assert (style["Lost"].italic, style["Lost"].based_on, style["Lost"].num_level) == (True, None, 1)
    level = {r.level: r for r in p.numbering.where("num_id = '3'").collect()}
    assert [(level[i].num_fmt, level[i].lvl_text, level[i].start, level[i].suff, level[i].p_style) for i in (0, 1)] == [("decimal", "%1.", 4, "space", "Sub"), ("lowerLetter", "%1.%2", 1, "nothing", "Lost")]
    assert [tuple(r) for r in p.validate().collect()] == []
    parts = {r.path: bytes(r.content).decode() for r in docx.parts(out.where("doc_id = 'a'")).collect()}
    assert 'typeface="Inter"' in parts["word/theme/theme1.xml"] and 'typeface="Songti"' in parts["word/theme/theme1.xml"]
    assert 'w:num="2"' in parts["word/document.xml"] and 'w:fmt="upperRoman"' in parts["word/document.xml"]


def test_a_dry_run_changes_no_byte(files):
    config = {"output": "x", "dryRun": True, "styles": [{"id": "S"}], "exclude": [4], "edits": [{"op": "delete", "at": {"type": "paragraph", "index": 2}}], "pattern_rules": [{"regex": "f", "style": "Misspelt"}]}
    before = {r.doc_id: bytes(r.content) for r in files.collect()}
    got = P.apply(files, config).collect()
    assert {r.doc_id: bytes(r.content) for r in got} == before
    assert {r.doc_id: r.error for r in got} == {"a": "EditError: style Misspelt is not there", "b": "EditError: paragraph 4 is not there; style Misspelt is not there"}


@pytest.mark.parametrize(
    "more, says",
    [
        ({"template": {"source": "t", "styles": ["a"]}, "source": "s"}, "template"),
        ({"styles": [{"id": "a", "fromParagraph": 1}]}, "fromParagraph"),
        ({"styles": [{"id": "a"}], "requirements": {"b": "x"}}, 'style "b"'),
        ({}, "nothing to do"),
        ({"trackChanges": True, "edits": [{"op": "format", "at": {"type": "paragraph", "index": 1}, "styleId": "S"}]}, "can't be tracked"),
    ],
)
def test_what_is_not_done_is_said(files, more, says):
    with pytest.raises(C.ConfigError, match=says):
        P.apply(files, {"output": "x", **more})


def test_headers_and_footers(files):
    blocks = [{"type": "paragraph", "content": ["Page ", {"field": "page"}][1:]}]
    config = {"output": "x", "captions": CAPTIONS, "headerFooter": {"header": {"default": para("top"), "first": para("front"), "underline": True}, "footer": {"default": blocks, "even": para("even"), "overline": {"style": "double", "size": 1}}, "sections": {"1": {"header": {"default": [{"type": "paragraph", "content": [{"link": "https://x.org", "text": "one"}]}]}}}}}
    out = P.apply(files, config).persist()
    p = Packages(docx.parts(out.where("doc_id = 'a' and error is null")))
    parts = {r.path: bytes(r.content).decode() for r in p.parts.collect()}
    body = parts["word/document.xml"]
    assert sorted(k for k in parts if "header" in k or "footer" in k) == ["word/_rels/header1.xml.rels", "word/footer1.xml", "word/footer2.xml", "word/header1.xml"]
    assert body.count("headerReference") == 1 and body.count("footerReference") == 2 and "titlePg" not in body
    assert "https://x.org" in parts["word/_rels/header1.xml.rels"] and "PAGE" in parts["word/footer1.xml"] + parts["word/footer2.xml"]
    assert 'w:val="double"' in parts["word/footer1.xml"] and "evenAndOddHeaders" in parts["word/settings.xml"] and "updateFields" in parts["word/settings.xml"]
    assert {r.id for r in p.styles.where("id in ('Header', 'Footer')").collect()} == {"Header", "Footer"}
    assert [tuple(r) for r in p.validate().collect()] == []
