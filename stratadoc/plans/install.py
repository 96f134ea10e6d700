"""What a configuration puts into a package beside its paragraphs: styles, list numbering, theme fonts.

Each function changes the parts (path to bytes) of one package in memory. Only what is
declared changes: an existing style keeps the properties that its entry does not name.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET

from ..sources import blocks as B
from ..sources import package
from ..sources.package import w

MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml"
RELS = "word/_rels/document.xml.rels"

# The order of children that the format prescribes.
PPR = [
    "pStyle", "keepNext", "keepLines", "pageBreakBefore", "framePr", "widowControl", "numPr", "suppressLineNumbers", "pBdr", "shd", "tabs", "suppressAutoHyphens",
    "kinsoku", "wordWrap", "overflowPunct", "topLinePunct", "autoSpaceDE", "autoSpaceDN", "bidi", "adjustRightInd", "snapToGrid", "spacing", "ind", "contextualSpacing",
    "mirrorIndents", "suppressOverlap", "jc", "textDirection", "textAlignment", "textboxTightWrap", "outlineLvl", "divId", "cnfStyle", "rPr", "sectPr", "pPrChange",
]
RPR = [
    "rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish",
    "webHidden", "color", "spacing", "w", "kern", "position", "sz", "szCs", "highlight", "u", "effect", "bdr", "shd", "fitText", "vertAlign", "rtl", "cs", "em", "lang",
    "eastAsianLayout", "specVanish", "oMath", "rPrChange",
]
STYLE = ["name", "aliases", "basedOn", "next", "link", "autoRedefine", "hidden", "uiPriority", "semiHidden", "unhideWhenUsed", "qFormat", "locked", "personal", "personalCompose", "personalReply", "rsid", "pPr", "rPr", "tblPr", "trPr", "tcPr", "tblStylePr"]
SECTION = ["headerReference", "footerReference", "footnotePr", "endnotePr", "type", "pgSz", "pgMar", "paperSrc", "pgBorders", "lnNumType", "pgNumType", "cols", "formProt", "vAlign", "noEndnote", "titlePg", "textDirection", "bidi", "rtlGutter", "docGrid", "printerSettings", "sectPrChange"]


# Settings in the order of the format, up to those that are set here.
SETTINGS = [
    "writeProtection", "view", "zoom", "removePersonalInformation", "removeDateAndTime", "doNotDisplayPageBoundaries", "displayBackgroundShape", "printPostScriptOverText",
    "printFractionalCharacterWidth", "printFormsData", "embedTrueTypeFonts", "embedSystemFonts", "saveSubsetFonts", "saveFormsData", "mirrorMargins", "alignBordersAndEdges",
    "bordersDoNotSurroundHeader", "bordersDoNotSurroundFooter", "gutterAtTop", "hideSpellingErrors", "hideGrammaticalErrors", "activeWritingStyle", "proofState", "formsDesign",
    "attachedTemplate", "linkStyles", "stylePaneFormatFilter", "stylePaneSortMethod", "documentType", "mailMerge", "revisionView", "trackRevisions", "doNotTrackMoves",
    "doNotTrackFormatting", "documentProtection", "autoFormatOverride", "styleLockTheme", "styleLockQFSet", "defaultTabStop", "autoHyphenation", "consecutiveHyphenLimit",
    "hyphenationZone", "doNotHyphenateCaps", "showEnvelope", "summaryLength", "clickAndTypeStyle", "defaultTableStyle", "evenAndOddHeaders", "bookFoldRevPrinting",
    "bookFoldPrinting", "bookFoldPrintingSheets", "drawingGridHorizontalSpacing", "drawingGridVerticalSpacing", "displayHorizontalDrawingGridEvery",
    "displayVerticalDrawingGridEvery", "doNotUseMarginsForDrawingGridOrigin", "drawingGridHorizontalOrigin", "drawingGridVerticalOrigin", "doNotShadeFormData",
    "noPunctuationKerning", "characterSpacingControl", "printTwoOnOne", "strictFirstAndLastChars", "noLineBreaksAfter", "noLineBreaksBefore", "savePreviewPicture",
    "doNotValidateAgainstSchema", "saveInvalidXml", "ignoreMixedContent", "alwaysShowPlaceholderText", "doNotDemarcateInvalidXml", "saveXmlDataOnly", "useXSLTWhenSaving",
    "saveThroughXslt", "showXMLTags", "alwaysMergeEmptyNamespace", "updateFields",
]


class InstallError(ValueError):
    """Something that can't be installed in a package."""


def open_part(source: bytes) -> ET.Element:
    """The root of a part, its prefixes kept; those that the parser drops as unused must not be named any more."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(source), events=["start-ns"]):
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(source)
    root.attrib.pop(f"{{{MC}}}Ignorable", None)
    return root


def written(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def in_order(box: ET.Element, order: list[str]) -> None:
    """Children in the prescribed order, those unknown before the last of it."""
    rank = {w(n): i for i, n in enumerate(order)}
    box[:] = sorted(box, key=lambda c: rank.get(c.tag, len(rank) - 2))


def merge(owner: ET.Element, name: str, order: list[str], new: list[ET.Element], first: bool = True) -> None:
    """Properties put into the owner's: measures attribute by attribute, all else as a whole."""
    box = owner.find(w(name))
    if box is None:
        box = ET.Element(w(name))
        owner.insert(0 if first else len(owner), box)
    for e in [c for x in new for c in x]:
        old = box.find(e.tag)
        if old is not None and e.tag in (w("spacing"), w("ind"), w("rFonts")):
            old.attrib.update(e.attrib)
        else:
            if old is not None:
                box.remove(old)
            box.append(e)
    in_order(box, order)


def merge_one(box: ET.Element, e: ET.Element) -> None:
    """A child in place of the one of its name."""
    old = box.find(e.tag)
    if old is not None:
        box.remove(old)
    box.append(e)


def part(parts: dict[str, bytes], path: str, root: str, kind: str) -> ET.Element:
    """A part's root; where there is no such part, an empty one with its relationship and content type."""
    if path in parts:
        return open_part(parts[path])
    rels = ET.fromstring(parts[RELS]) if RELS in parts else ET.Element(f"{{{package.REL}}}Relationships")
    used = [int(m[1]) for e in rels if (m := re.fullmatch(r"rIdPart(\d+)", e.get("Id") or ""))]  # apart from the ids that a writer gives out
    rels.append(ET.Element(f"{{{package.REL}}}Relationship", {"Id": f"rIdPart{max([0, *used]) + 1}", "Type": f"{OFFICE}/{kind}", "Target": path.removeprefix("word/")}))
    parts[RELS] = written(rels)
    types = ET.fromstring(parts["[Content_Types].xml"])
    if not any(e.get("PartName") == f"/{path}" for e in types):
        types.append(ET.Element(f"{{{package.TYPES}}}Override", {"PartName": f"/{path}", "ContentType": f"{MIME}.{kind}+xml"}))
    parts["[Content_Types].xml"] = written(types)
    return ET.Element(w(root))


def styles(parts: dict[str, bytes], entries: list[dict]) -> None:
    """Paragraph styles created or changed. basedOn takes an id or a name; one that is neither is left out."""
    root = part(parts, "word/styles.xml", "styles", "styles")
    for entry in entries:
        e = {**entry, **entry.get("overrides", {})}
        style = next((s for s in root.iterfind(w("style")) if s.get(w("styleId")) == e["id"]), None)
        new = style is None
        if new:
            style = B.element("style", type="paragraph", styleId=e["id"])
            root.append(style)
        if new or "name" in e:
            name = style.find(w("name"))
            if name is None:
                style.append(name := B.element("name"))
            name.set(w("val"), e.get("name", e["id"]))
        if e.get("basedOn"):
            others = [s for s in root.iterfind(w("style")) if s is not style]
            ids = {s.get(w("styleId")) for s in others}
            named = {n.get(w("val")): s.get(w("styleId")) for s in others if (n := s.find(w("name"))) is not None}
            to, old = e["basedOn"] if e["basedOn"] in ids else named.get(e["basedOn"]), style.find(w("basedOn"))
            if old is not None:
                style.remove(old)
            if to:
                style.append(B.element("basedOn", val=to))
        if made := B.para_format(e):
            ind = style.find(f"{w('pPr')}/{w('ind')}")
            if ind is not None and (e.get("firstLineIndent") is not None or e.get("hangingIndent") is not None):
                for k in ("firstLine", "firstLineChars", "hanging", "hangingChars"):
                    ind.attrib.pop(w(k), None)
            merge(style, "pPr", PPR, made, False)
        if made := B.run_format(e):
            for c, twin in (("b", "bCs"), ("i", "iCs")):
                for t in [t for x in made for t in x if t.tag == w(c)]:
                    made[0].append(ET.Element(w(twin), t.attrib))
            merge(style, "rPr", RPR, made, False)
        in_order(style, STYLE)
    parts["word/styles.xml"] = written(root)


#: The children of a level in their order.
_LEVEL = ["start", "numFmt", "lvlRestart", "pStyle", "isLgl", "suff", "lvlText", "lvlPicBulletId", "legacy", "lvlJc", "pPr", "rPr"]


def numbering(parts: dict[str, bytes], schemes: list[dict]) -> None:
    """Each scheme as an abstract definition of its own with a numbering id, the one given or the next free; its levels' styles are bound to it.

    A pattern that ends in blanks gives them up to what follows the number: one blank is a
    space, more a tab. An id that is there already is pointed to the new definition.
    """
    root = part(parts, "word/numbering.xml", "numbering", "numbering")
    styles_root = part(parts, "word/styles.xml", "styles", "styles")
    known = {s.get(w("styleId")): s for s in styles_root.iterfind(w("style"))}
    numbers = lambda tag, key: [int(e.get(w(key))) for e in root.iterfind(w(tag)) if (e.get(w(key)) or "").isdigit()]
    for s in schemes:
        abstract = max([-1, *numbers("abstractNum", "abstractNumId")]) + 1
        num_id = s.get("numId") or max([0, *numbers("num", "numId")]) + 1
        box = B.element("abstractNum", B.element("multiLevelType", val="multilevel" if len(s["levels"]) > 1 else "singleLevel"), abstractNumId=abstract)
        for v in sorted(s["levels"], key=lambda v: v["level"]):
            if v["styleId"] not in known:
                raise InstallError(f"numbering: no style {v['styleId']}")
            text = v["lvlText"] if v.get("suff") else v["lvlText"].rstrip(" ")
            blanks = len(v["lvlText"]) - len(v["lvlText"].rstrip(" "))
            level = B.element(
                "lvl", B.element("start", val=v.get("start", 1)), B.element("numFmt", val=v["numFmt"]), B.element("pStyle", val=v["styleId"]), *([B.element("isLgl")] if v.get("isLgl") else []),
                B.element("suff", val=v.get("suff") or ("nothing", "space", "tab")[min(blanks, 2)]), B.element("lvlText", val=text), B.element("lvlJc", val="left"), *B.run_format(v.get("numRPr")), ilvl=v["level"],
            )
            in_order(level, _LEVEL)
            box.append(level)
            merge(known[v["styleId"]], "pPr", PPR, B.para_format(None, None, {"numId": num_id, "level": v["level"]}), False)
            in_order(known[v["styleId"]], STYLE)
        first = next((i for i, e in enumerate(root) if e.tag == w("num")), len(root))
        root.insert(first, box)
        old = next((e for e in root.iterfind(w("num")) if e.get(w("numId")) == str(num_id)), None)
        if old is None:
            root.append(B.element("num", B.element("abstractNumId", val=abstract), numId=num_id))
        else:
            old[:] = [B.element("abstractNumId", val=abstract)]
    parts["word/numbering.xml"], parts["word/styles.xml"] = written(root), written(styles_root)


def theme(parts: dict[str, bytes], fonts: dict[str, str]) -> None:
    """Theme fonts by slot: majorLatin, majorEastAsia, minorLatin, minorEastAsia."""
    path = next((n for n in sorted(parts) if re.fullmatch(r"word/theme/theme\d*\.xml", n)), None)
    if path is None:
        raise InstallError("theme: the package has none")
    root, a = open_part(parts[path]), f"{{{package.A}}}"
    scheme = root.find(f".//{a}fontScheme")
    if scheme is None:
        raise InstallError("theme: no font scheme")
    for slot, font in fonts.items():
        group, kind = (slot[:5], slot[5:])
        box = scheme.find(f"{a}{group}Font")
        if box is None:
            scheme.append(box := ET.Element(f"{a}{group}Font"))
        name = f"{a}{'latin' if kind == 'Latin' else 'ea'}"
        face = box.find(name)
        if face is None:
            box.append(face := ET.Element(name))
        face.set("typeface", font)
    parts[path] = written(root)


def settings(parts: dict[str, bytes], *flags: str) -> None:
    """Flags of the settings part switched on, each at its place."""
    root = part(parts, "word/settings.xml", "settings", "settings")
    for f in flags:
        merge_one(root, B.element(f))
        before = {w(n) for n in SETTINGS[: SETTINGS.index(f)]}
        own = root[-1]
        root.remove(own)
        root.insert(max([i + 1 for i, e in enumerate(root) if e.tag in before], default=0), own)
    parts["word/settings.xml"] = written(root)


def ensure_style(parts: dict[str, bytes], kind: str, name: str, *children: ET.Element) -> None:
    """A style that something refers to, where the package has none of its id."""
    root = part(parts, "word/styles.xml", "styles", "styles")
    if all(s.get(w("styleId")) != name for s in root.iterfind(w("style"))):
        root.append(style := B.element("style", B.element("name", val=name.lower() if kind == "paragraph" else name), *children, type=kind, styleId=name))
        in_order(style, STYLE)
        parts["word/styles.xml"] = written(root)


def edge(side: str, how: object) -> ET.Element:
    """A paragraph border on one side: true is a thin line."""
    e = {"style": how} if isinstance(how, str) else how if isinstance(how, dict) else {}
    kind = {"thick": "thick", "double": "double", "dotted": "dotted", "dashed": "dashed", "none": "none"}.get(e.get("style"), "single")
    return B.element(side, val=kind, sz=round(B.twips(e["size"]) / 2.5) if e.get("size") is not None else 6, space=1, color=e.get("color", "auto"))


def layered(config: dict, section: int) -> dict:
    """A section's header and footer: those for all, then those of ranges that hold it, then its own."""
    out = {k: config[k] for k in ("header", "footer") if k in config}
    spans = [([int(x) for x in k.split("-")], v) for k, v in (config.get("sections") or {}).items()]
    for v in [v for k, v in spans if len(k) == 2 and k[0] <= section <= k[1]] + [v for k, v in spans if k == [section]]:
        out |= v
    return out


def install(parts: dict[str, bytes], config: dict) -> None:
    if config.get("styles"):
        styles(parts, config["styles"])
    schemes = config.get("numbering") or []
    if schemes:
        numbering(parts, [schemes] if isinstance(schemes, dict) else schemes)
    if fonts := (config.get("theme") or {}).get("fonts"):
        theme(parts, fonts)


def strip_patterns(config: dict) -> dict[str, list[str]]:
    """By style, the patterns of typed numbers that list numbering takes the place of: those given, else one from the level's own text."""
    schemes = config.get("numbering") or []
    out = {}
    for s in [schemes] if isinstance(schemes, dict) else schemes:
        for v in s["levels"]:
            out[v["styleId"]] = [prefix_pattern(p) for p in v.get("stripPrefixPatterns") or [v["lvlText"]]]
    return out


def prefix_pattern(lvl_text: str) -> str:
    """A level's text as a pattern: each %N stands for digits or Chinese numerals, blanks around it go along."""
    return r"^\s*" + re.sub(r"%\d", r"(?:\\d+|[一二三四五六七八九十百千]+)", re.escape(lvl_text)) + r"\s*"
