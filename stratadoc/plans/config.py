"""The configuration of an apply: what it may hold, and its rules, edits and styles as tables.

A configuration is one JSON object that the driver reads; checks that need the documents
(does the style exist, is the paragraph there) are joins on the tables made here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import counters

#: A check of a value at a path gives messages, none when it is fine.
Check = Callable[[object, str], list[str]]


class ConfigError(ValueError):
    """All that is wrong with a configuration, a message a line."""


def _says(path: str, what: str) -> list[str]:
    return [f"{path or 'config'}: {what}"]


def _is_number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")


def text(least: int = 0, pattern: str | None = None) -> Check:
    def check(v, path):
        if not isinstance(v, str) or len(v) < least:
            return _says(path, "must be a string" + (" that is not empty" if least else ""))
        return [] if pattern is None or re.fullmatch(pattern, v) else _says(path, f"{v!r} does not have the form {pattern}")

    return check


def number(least: float | None = None, most: float | None = None) -> Check:
    def check(v, path):
        if not _is_number(v):
            return _says(path, "must be a number")
        return [] if (least is None or v >= least) and (most is None or v <= most) else _says(path, f"{v} is outside {least} to {most}")

    return check


def flag(v: object, path: str) -> list[str]:
    return [] if isinstance(v, bool) else _says(path, "must be true or false")


def one_of(*values: object) -> Check:
    return lambda v, path: [] if any(v == x and type(v) is type(x) for x in values) else _says(path, f"must be one of {', '.join(map(str, values))}")


def length(v: object, path: str) -> list[str]:
    """A number (points) or one with a unit."""
    return [] if (_is_number(v) or isinstance(v, str)) and counters.to_points(v) is not None else _says(path, f"{v!r} is not a length (a number, or one with pt, cm, mm or in)")


def indent(v: object, path: str) -> list[str]:
    return [] if v is None or isinstance(v, str) and re.fullmatch(r"\s*-?\d+(\.\d+)?\s*chars?\s*", v, re.I) else length(v, path)


def line_spacing(v: object, path: str) -> list[str]:
    if isinstance(v, dict):
        return obj({"atLeast!": length})(v, path)
    return _says(path, "a multiple must be above 0") if _is_number(v) and v <= 0 else length(v, path)


def padding(v: object, path: str) -> list[str]:
    if isinstance(v, list):
        return many(length, 1, 4)(v, path)
    return length(v, path)


def many(each: Check, least: int = 0, most: int | None = None) -> Check:
    def check(v, path):
        if not isinstance(v, list):
            return _says(path, "must be a list")
        if len(v) < least or most is not None and len(v) > most:
            return _says(path, f"must have {least} to {most or 'any number of'} entries")
        return [m for i, x in enumerate(v) for m in each(x, f"{path}[{i}]")]

    return check


def keyed(each: Check, pattern: str | None = None, says: str = "") -> Check:
    """An object with free keys."""

    def check(v, path):
        if not isinstance(v, dict):
            return _says(path, "must be an object")
        bad = [m for k in v if pattern and not re.fullmatch(pattern, k) for m in _says(path, f'key "{k}" is invalid. {says}')]
        return bad + [m for k, x in v.items() for m in each(x, f"{path}.{k}")]

    return check


def obj(fields: dict[str, Check], *rules: tuple[Callable[[dict], bool], str]) -> Check:
    """An object of these keys and no others; "!" marks those that must be there. The rules run on objects that are fine so far."""
    known = {k.rstrip("!"): c for k, c in fields.items()}
    needed = [k[:-1] for k in fields if k.endswith("!")]

    def check(v, path):
        if not isinstance(v, dict):
            return _says(path, "must be an object")
        at = f"{path}." if path else ""
        out = [m for k in v if k not in known for m in _says(path, f'unknown key "{k}"')]
        out += [m for k in needed if k not in v for m in _says(at + k, "is missing")]
        out += [m for k, x in v.items() if k in known for m in known[k](x, at + k)]
        return out or [m for holds, says in rules if not holds(v) for m in _says(path, says)]

    return check


def any_of(*checks: Check, says: str = "has none of its possible forms") -> Check:
    """The first form that fits; when none does, the messages of the one that comes closest: of the right type first, then with fewest messages."""

    def check(v, path):
        found = [c(v, path) for c in checks]
        best = min(found, key=lambda ms: (any(m.startswith(f"{path}: must be") for m in ms), len(ms)))
        return best if not best or len(best) == 1 else _says(path, says) + best

    return check


def tagged(key: str, forms: dict[str, Check]) -> Check:
    """Objects whose form a key names."""

    def check(v, path):
        if not isinstance(v, dict) or not isinstance(v.get(key), str) or v[key] not in forms:
            return _says(path, f'"{key}" must be one of {", ".join(forms)}')
        return forms[v[key]](v, path)

    return check


NAME = text(1)
HEX = text(pattern="[0-9a-fA-F]{6}")
ANCHOR = text(pattern=r"[A-Za-z_][A-Za-z0-9_-]{0,39}")
INDEX = number(1)

RUN_FORMAT = obj({"bold": flag, "italic": flag, "underline": flag, "strike": flag, "color": HEX, "fontLatin": text(), "fontCJK": text(), "size": length, "vertAlign": one_of("superscript", "subscript", "baseline")})
PARA_FORMAT = obj({"alignment": one_of("left", "center", "right", "both"), "spaceBefore": length, "spaceAfter": length, "lineSpacing": line_spacing, "firstLineIndent": indent, "hangingIndent": indent, "indentLeft": indent, "indentRight": indent, "outlineLevel": number(0, 9)})

INLINE = any_of(
    obj({"text!": text(), "format": RUN_FORMAT}),
    obj({"refTo!": tagged("type", {"paragraph": obj({"type!": text(), "index!": INDEX}), "anchor": obj({"type!": text(), "name!": ANCHOR})}), "display": one_of("full", "label", "number"), "format": RUN_FORMAT}),
    obj({"math!": NAME}),
    obj({"link!": text(1, r"[^#].*|#[A-Za-z_][A-Za-z0-9_-]{0,39}"), "text!": NAME, "format": RUN_FORMAT}),
    obj({"field!": one_of("page", "numPages", "date"), "format": RUN_FORMAT}),
    obj({"styleRef!": NAME, "numberOnly": flag, "format": RUN_FORMAT}),
    obj({"break!": one_of("line", "page", "column")}),
)
RICH_TEXT = any_of(text(), many(INLINE))
EDGE = any_of(one_of("none", "single", "thick", "double", "dotted", "dashed"), obj({"style": one_of("single", "thick", "double", "dotted", "dashed"), "size": length, "color": any_of(HEX, one_of("auto"))}))
SIDES = obj(dict.fromkeys(("top", "bottom", "left", "right", "insideH", "insideV"), EDGE))

_KIND = {"type!": text()}
_TEXT_BLOCK = {"styleId": NAME, "paraFormat": PARA_FORMAT}
_CAPTION_KEY = {"captionId": NAME, "identifier": NAME}
PARAGRAPH = obj({**_KIND, **_TEXT_BLOCK, "content": RICH_TEXT, "text": RICH_TEXT, "runFormat": RUN_FORMAT, "numbering": obj({"numId!": any_of(INDEX, NAME), "level!": number(0, 8), "restart": flag}), "anchor": ANCHOR})
IMAGE = obj({**_KIND, **_TEXT_BLOCK, "src!": NAME, "data": text(), "width!": length, "height!": length, "alt": text()})
EQUATION = obj(
    {**_KIND, **_TEXT_BLOCK, "latex": NAME, "omml": NAME, "mathml": NAME, "captionId": NAME, "subGroup": one_of("start", "continue"), "anchor": ANCHOR},
    (lambda b: sum(k in b for k in ("latex", "omml", "mathml")) == 1, "an equation needs exactly one source"),
    (lambda b: "captionId" in b or "subGroup" not in b and "anchor" not in b, "subGroup and anchor need a captionId"),
)
CAPTION = obj({**_KIND, **_CAPTION_KEY, "text!": text(), "subGroup": one_of("start", "continue"), "anchor": ANCHOR})
RESET = obj({**_KIND, **_CAPTION_KEY, "newValue": number(0)})
PLAIN = obj(_KIND)
CELL_BLOCKS: dict[str, Check] = {"paragraph": PARAGRAPH, "image": IMAGE, "page-break": PLAIN, "horizontal-rule": PLAIN, "equation": EQUATION, "caption": CAPTION, "caption-counter-reset": RESET}
_CELL_CONTENT = any_of(RICH_TEXT, many(tagged("type", CELL_BLOCKS)))
CELL = any_of(_CELL_CONTENT, obj({"content!": _CELL_CONTENT, "colspan": INDEX, "rowspan": INDEX, "vAlign": one_of("top", "center", "bottom"), "borders": SIDES, "shading": HEX, "padding": padding}))
TABLE = obj(
    {**_KIND, "rows!": many(many(CELL, 1), 1), "headerRows": number(0), "headerStyle": NAME, "cols": many(obj({"width": any_of(one_of("auto"), length)})), "borders": any_of(one_of("all", "none", "outer", "three-line"), SIDES), "alignment": one_of("left", "center", "right"), "vAlign": one_of("top", "center", "bottom"), "layout": one_of("fixed", "autofit"), "padding": padding},
    (lambda b: b.get("headerRows", 0) <= len(b["rows"]), "more header rows than rows"),
)
FRAGMENT = many(tagged("type", {**CELL_BLOCKS, "table": TABLE}))

_CELL_PLACE = {"table!": INDEX, "row!": INDEX, "col!": INDEX}
LOCATOR = tagged("type", {
    "paragraph": obj({**_KIND, "index!": INDEX}),
    "range": obj({**_KIND, "from!": INDEX, "to!": INDEX}, (lambda x: x["from"] <= x["to"], "from is above to")),
    "cell": obj({**_KIND, **_CELL_PLACE, "paragraph": INDEX, "to": INDEX}, (lambda x: "to" not in x or "paragraph" in x, "to needs paragraph"), (lambda x: "paragraph" not in x or x.get("to", x["paragraph"]) >= x["paragraph"], "to is below paragraph")),
    "heading": obj({**_KIND, "text!": NAME, "level": number(0, 9)}),
    "whole-body": PLAIN,
})
_ONE_RUN = (lambda x: not ("blank" in x and "runIndex" in x), "either blank or runIndex, not both")
RUN_LOCATOR = any_of(obj({"type!": one_of("run"), "paragraph!": INDEX, "blank": INDEX, "runIndex": INDEX}, _ONE_RUN), obj({"type!": one_of("run"), **_CELL_PLACE, "paragraph!": INDEX, "blank": INDEX, "runIndex": INDEX}, _ONE_RUN))

_AT = {"op!": text(), "at!": LOCATOR}
EDIT = tagged("op", {
    "replace": obj({**_AT, "with!": FRAGMENT, "overwriteFields": flag}),
    "insert-before": obj({**_AT, "content!": FRAGMENT}),
    "insert-after": obj({**_AT, "content!": FRAGMENT}),
    "delete": obj(_AT),
    "format": obj({**_AT, "styleId": NAME, "runFormat": RUN_FORMAT, "paraFormat": PARA_FORMAT, "clearDirect": any_of(one_of("all"), many(one_of("pPr", "rPr")))}, (lambda x: any(x.get(k) for k in ("styleId", "runFormat", "paraFormat", "clearDirect")), "format needs at least one of styleId, runFormat, paraFormat, clearDirect")),
    "set-run": obj({"op!": text(), "at!": RUN_LOCATOR, "with!": text(), "format": RUN_FORMAT}),
    "edit-caption": obj({"op!": text(), "target!": any_of(obj({"anchor!": ANCHOR}), obj({"captionId!": NAME, "index!": INDEX})), "text!": text()}),
    "merge": obj({**_AT, "keepPPr": one_of("first", "last")}),
})

_STYLE = {"basedOn": text(), "fontLatin": text(), "fontCJK": text(), "size": length, "bold": flag, "italic": flag, "color": text(), "alignment": one_of("left", "center", "right", "both"), "lineSpacing": line_spacing, "spaceBefore": length, "spaceAfter": length, "firstLineIndent": indent, "hangingIndent": indent, "outlineLevel": number(0, 9), "vertAlign": one_of("superscript", "subscript", "baseline")}
STYLE = obj({"id!": NAME, "name": NAME, "fromParagraph": number(), **_STYLE, "overrides": obj(_STYLE)})


def _falling(level: dict) -> bool:
    marks = [len(re.findall(r"%\d", p)) for p in level.get("stripPrefixPatterns") or []]
    return marks == sorted(marks, reverse=True)


LEVEL = obj(
    {"level!": number(0, 8), "numFmt!": NAME, "lvlText!": NAME, "styleId!": NAME, "start": number(), "stripPrefixPatterns": many(text()), "suff": one_of("tab", "space", "nothing"), "numRPr": obj({"fontLatin": text(), "fontCJK": text(), "size": length, "bold": flag, "italic": flag, "color": text()}), "isLgl": flag, "restart": any_of(one_of("continuous", "perInstance", "byHeading"), obj({"atStyleChange!": NAME}))},
    (_falling, "stripPrefixPatterns must come with the most placeholders first, or a shorter pattern strips what a longer one wants"),
)
NUMBERING = obj({"numId": INDEX, "levels!": many(LEVEL, 1)})
FORMAT = one_of("arabic", "alphabetic", "ALPHABETIC", "roman", "ROMAN", "chinese", "chinese-formal")
CAPTION_ENTRY = obj({"prefix": text(), "suffix": text(), "format": FORMAT, "chapterPrefix": many(any_of(NAME, obj({"styleId!": NAME, "format": FORMAT}))), "chapterSeparator": text(), "bodySeparator": text(), "styleId!": NAME, "subCounter": obj({"format": FORMAT, "prefix": text(), "suffix": text()})})

SELECTOR = {"pattern": r"\d+(-\d+)?", "says": 'Use "N" (a section from 1) or "N-M".'}
COLUMNS = any_of(INDEX, obj(
    {"count": INDEX, "space": length, "separator": flag, "widths": many(length, 1), "spaces": many(length)},
    (lambda c: ("count" in c) != ("widths" in c), "columns need either count or widths"),
    (lambda c: "spaces" not in c or len(c.get("widths", [])) >= 2 and len(c["spaces"]) == len(c["widths"]) - 1, "spaces need widths, one less than them"),
))
_PAGE = {"paperSize": any_of(one_of("A4", "A3", "A5", "Letter", "Legal", "B5", "16K"), obj({"width!": length, "height!": length})), "orientation": one_of("portrait", "landscape"), "margins": obj(dict.fromkeys(("top", "bottom", "left", "right", "header", "footer", "gutter"), length)), "columns": COLUMNS, "pgNumType": obj({"fmt": one_of("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter"), "start": INDEX})}
PAGE_SETUP = obj({**_PAGE, "sections": keyed(obj(_PAGE), **SELECTOR)})


def _inside(x: object):
    """Objects at any depth."""
    if isinstance(x, dict):
        yield x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _inside(y)


_MARGINAL = many(tagged("type", {"paragraph": PARAGRAPH, "image": IMAGE, "horizontal-rule": PLAIN, "table": TABLE}))


def margin_blocks(v: object, path: str) -> list[str]:
    """Blocks of a header or footer: nothing that counts in the body, no heading styles, at any depth."""
    out = _MARGINAL(v, path)
    for b in _inside(v):
        if b.get("type") in ("caption", "caption-counter-reset", "equation", "page-break"):
            out += _says(path, f"a header or footer can't hold a {b['type']}")
        if b.get("type") == "paragraph" and re.fullmatch("Heading[1-9]|Title|Subtitle|BodyText", str(b.get("styleId"))):
            out += _says(path, f"a header or footer can't use the style {b['styleId']}")
    return list(dict.fromkeys(out))


def _variants(line: str) -> Check:
    return obj({"default": margin_blocks, "first": margin_blocks, "even": margin_blocks, line: any_of(one_of(True), EDGE)}, (lambda v: any(k in v for k in ("default", "first", "even")), "at least one of default, first, even is needed"))


_SURFACES = {"header": _variants("underline"), "footer": _variants("overline")}
HEADER_FOOTER = obj({**_SURFACES, "sections": keyed(obj(_SURFACES, (bool, "header or footer is needed")), **SELECTOR)}, (lambda v: any(v.get(k) for k in ("header", "footer", "sections")), "header, footer or sections is needed"))

CONFIG = obj(
    {
        "source": NAME, "output!": NAME, "dryRun": flag, "allowValidationWarnings": flag, "template": obj({"source!": NAME, "styles!": many(NAME, 1), "importNumbering": flag}),
        "theme": obj({"fonts": obj(dict.fromkeys(("majorLatin", "majorEastAsia", "minorLatin", "minorEastAsia"), text()))}), "pageSetup": PAGE_SETUP, "headerFooter": HEADER_FOOTER,
        "styles": many(STYLE), "numbering": any_of(NUMBERING, many(NUMBERING)), "captions": keyed(CAPTION_ENTRY, r"(?!_chap_).+", "Captions are not empty and do not start with _chap_."),
        "assignments": many(obj({"para!": number(), "action!": one_of("keep", "restyle", "flag"), "style": text(), "reason": text()}, (lambda a: a["action"] != "flag" or bool(a.get("reason")), "a flag needs a reason"), (lambda a: a["action"] != "restyle" or bool(a.get("style")), "restyle needs a style"))),
        "bulk_rules": many(obj({"fingerprint!": NAME, "style!": NAME})), "pattern_rules": many(obj({"regex!": NAME, "flags": text(), "style!": NAME, "stripMatch": flag})),
        "requirements": keyed(text()), "exclude": many(number()), "edits": many(EDIT), "trackChanges": flag, "author": NAME,
    },
    (lambda c: "template" not in c or "source" in c, "template needs a source"),
    (lambda c: "author" not in c or c["author"].strip() != "", "author must not be blank"),
    (lambda c: "author" not in c or c.get("trackChanges") is True, "author needs trackChanges"),
    (lambda c: not _shared_styles(c), "a style can't be both in numbering and in captions"),
)


def schemes(config: dict) -> list[dict]:
    n = config.get("numbering", [])
    return [n] if isinstance(n, dict) else n


def _shared_styles(config: dict) -> set[str]:
    return {v["styleId"] for s in schemes(config) for v in s["levels"]} & {c["styleId"] for c in config.get("captions", {}).values()}


def problems(config: object) -> list[str]:
    """Every message, in the order of the configuration; none when it is fine."""
    return CONFIG(config, "")


def read(source: str) -> dict:
    """A configuration from JSON text; raises ConfigError with all messages."""
    try:
        config = json.loads(source)
    except json.JSONDecodeError as e:
        raise ConfigError(f"config: not JSON, {e}") from e
    if found := problems(config):
        raise ConfigError("\n".join(found))
    return config


def rules(spark: SparkSession, config: dict) -> DataFrame:
    """(ord, kind, para, regex, flags, fingerprint, style, action, reason, strip_match): the rules in the order in which they win."""
    rows = [("exclude", int(p), None, None, None, None, None, None, False) for p in config.get("exclude", [])]
    rows += [("assignment", int(a["para"]), None, None, None, a.get("style"), a["action"], a.get("reason"), False) for a in config.get("assignments", [])]
    rows += [("pattern", None, p["regex"], p.get("flags"), None, p["style"], None, None, p.get("stripMatch", False)) for p in config.get("pattern_rules", [])]
    rows += [("bulk", None, None, None, b["fingerprint"], b["style"], None, None, False) for b in config.get("bulk_rules", [])]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "ord int, kind string, para int, regex string, flags string, fingerprint string, style string, action string, reason string, strip_match boolean")


def edits(spark: SparkSession, config: dict) -> DataFrame:
    """(ord, op, at, payload): the edits in order; where and what as JSON."""
    where = lambda e: json.dumps(e.get("at", e.get("target")), ensure_ascii=False)
    rest = lambda e: json.dumps({k: v for k, v in e.items() if k not in ("op", "at", "target")}, ensure_ascii=False)
    return spark.createDataFrame([(i, e["op"], where(e), rest(e)) for i, e in enumerate(config.get("edits", []), 1)], "ord int, op string, at string, payload string")
