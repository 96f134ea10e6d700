"""Configurations that hold and that don't."""

import pytest

from stratadoc.plans import config

FINE = {
    "source": "a.docx", "output": "b.docx", "trackChanges": True, "author": "x",
    "styles": [{"id": "Body", "size": "10.5pt", "firstLineIndent": "2char", "lineSpacing": {"atLeast": 12}}],
    "numbering": {"levels": [{"level": 0, "numFmt": "decimal", "lvlText": "%1", "styleId": "Heading1", "stripPrefixPatterns": ["%1.%2", "%1."], "restart": {"atStyleChange": "x"}}]},
    "captions": {"Figure": {"styleId": "Caption", "chapterPrefix": ["Heading1", {"styleId": "Heading2", "format": "chinese"}]}},
    "pageSetup": {"paperSize": "A4", "columns": 2, "sections": {"1-2": {"orientation": "landscape"}}},
    "headerFooter": {"header": {"default": [{"type": "paragraph", "content": [{"field": "page"}]}], "underline": True}},
    "assignments": [{"para": 3, "action": "flag", "reason": "odd"}], "exclude": [1], "bulk_rules": [{"fingerprint": "A", "style": "Body"}], "pattern_rules": [{"regex": "^x", "style": "Body", "stripMatch": True}],
    "edits": [
        {"op": "replace", "at": {"type": "range", "from": 1, "to": 2}, "with": [{"type": "table", "rows": [["a", {"content": [{"type": "paragraph", "content": "x"}], "colspan": 2}]], "borders": {"top": "none"}}]},
        {"op": "set-run", "at": {"type": "run", "paragraph": 4, "blank": 1}, "with": "y"}, {"op": "delete", "at": {"type": "heading", "text": "End"}},
        {"op": "edit-caption", "target": {"captionId": "Figure", "index": 1}, "text": "z"},
    ],
}


def test_a_fine_configuration(spark):
    assert config.problems(FINE) == []
    assert [(r.ord, r.kind, r.style) for r in config.rules(spark, FINE).orderBy("ord").collect()] == [(1, "exclude", None), (2, "assignment", None), (3, "pattern", "Body"), (4, "bulk", "Body")]
    assert [r.op for r in config.edits(spark, FINE).orderBy("ord").collect()] == ["replace", "set-run", "delete", "edit-caption"]
    assert config.edits(spark, {}).count() == 0 and config.rules(spark, {}).count() == 0


@pytest.mark.parametrize(
    "change, says",
    [
        ({"colour": 1}, 'unknown key "colour"'),
        ({"output": ""}, "output: must be a string"),
        ({"source": None}, "source"),
        ({"trackChanges": False}, "author needs trackChanges"),
        ({"styles": [{"id": "a", "size": "wide"}]}, "styles[0].size: 'wide' is not a length"),
        ({"styles": [{"id": "a", "bold": 1}]}, "styles[0].bold: must be true or false"),
        ({"captions": {"Figure": {"styleId": "Heading1"}}}, "both in numbering and in captions"),
        ({"captions": {"_chap_1": {"styleId": "C"}}}, "invalid"),
        ({"pageSetup": {"columns": {"count": 1, "widths": [1]}}}, "either count or widths"),
        ({"pageSetup": {"sections": {"last": {}}}}, 'key "last" is invalid'),
        ({"headerFooter": {}}, "is needed"),
        ({"headerFooter": {"header": {"default": [{"type": "table", "rows": [[[{"type": "equation", "omml": "x"}]]]}]}}}, "can't hold a equation"),
        ({"assignments": [{"para": 1, "action": "flag"}]}, "a flag needs a reason"),
        ({"edits": [{"op": "shuffle"}]}, '"op" must be one of'),
        ({"edits": [{"op": "delete", "at": {"type": "range", "from": 3, "to": 2}}]}, "from is above to"),
        ({"edits": [{"op": "delete", "at": {"type": "cell", "table": 1, "row": 1, "col": 1, "to": 2}}]}, "to needs paragraph"),
        ({"edits": [{"op": "format", "at": {"type": "whole-body"}}]}, "format needs at least one"),
        ({"edits": [{"op": "set-run", "at": {"type": "run", "paragraph": 1, "blank": 1, "runIndex": 1}, "with": ""}]}, "not both"),
        ({"edits": [{"op": "insert-after", "at": {"type": "paragraph", "index": 0}, "content": []}]}, "outside 1"),
        ({"edits": [{"op": "insert-after", "at": {"type": "paragraph", "index": 1}, "content": [{"type": "equation"}]}]}, "exactly one source"),
        ({"numbering": {"levels": [{"level": 9, "numFmt": "x", "lvlText": "x", "styleId": "x"}]}}, "outside 0 to 8"),
        ({"numbering": {"levels": [{"level": 0, "numFmt": "x", "lvlText": "x", "styleId": "x", "stripPrefixPatterns": ["%1", "%1.%2"]}]}}, "most placeholders first"),
    ],
)
def test_what_does_not_hold(change, says):
    assert any(says in m for m in config.problems({**FINE, **change})), config.problems({**FINE, **change})


def test_text_that_is_no_configuration():
    with pytest.raises(config.ConfigError, match="not JSON"):
        config.read("{")
    with pytest.raises(config.ConfigError, match="must be an object"):
        config.read("[]")
    assert config.read('{"output": "x"}') == {"output": "x"}
