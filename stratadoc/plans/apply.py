"""Configurations applied to packages: edits first, then rules on what the edits made, then page setup.

What is touched is decided by joins and filters over the scanned tables; one task per
document then rewrites its package from that plan (a cogroup by document). A document
whose edits can't be done keeps its content and says why in `error`.
"""

from __future__ import annotations

import copy
import io
import json
import re
import tempfile
import zipfile
import zlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..sources import blocks as B
from ..sources import docx, package
from ..sources.package import w
from . import config as C
from . import install as I
from .tools import Packages

# Paper sizes in twips, portrait.
PAPERS = {"A4": (11906, 16838), "A3": (16838, 23811), "A5": (8392, 11906), "Letter": (12240, 15840), "Legal": (12240, 20160), "B5": (9979, 14175), "16K": (10433, 14742)}

#: Edits that change a paragraph's text, which fields, revisions and controls forbid.
GUARDED = ("replace", "delete", "merge", "set-run")


class EditError(ValueError):
    """An edit that can't be done in a document."""


def _where(at: dict) -> Column:
    """Whether a paragraph of the scanned table is named by a locator; a heading's first match is left to the caller."""
    kind, col = at["type"], F.col
    if kind == "whole-body":
        return col("para_index").isNotNull()
    if kind == "paragraph":
        return col("para_index") == int(at["index"])
    if kind == "range":
        return col("para_index").between(int(at["from"]), int(at["to"]))
    if kind == "heading":
        level = F.coalesce("outline_level", "style_level")
        named = col("para_index").isNotNull() & (F.trim(col("text")) == at["text"].strip()) & (level < 9)
        return named & (level == int(at["level"])) if "level" in at else named
    if "table" in at:
        place = (col("table_idx") == int(at["table"])) & (col("t_row") == int(at["row"])) & (col("t_col") == int(at["col"]))
        return place & col("t_para").between(int(at["paragraph"]), int(at.get("to", at["paragraph"]))) if "paragraph" in at else place
    return col("para_index") == int(at["paragraph"])


def targets(p: Packages, edits: list[dict]) -> DataFrame:
    """(doc_id, ord, para_seq): the paragraphs that each edit names, in one pass over them; of a heading the first alone."""
    style = p.resolved_styles.select("doc_id", F.col("id").alias("style_id"), F.col("outline_level").alias("style_level"))
    r = p.paragraphs.join(style, ["doc_id", "style_id"], "left")
    named = [(i, e["at"]) for i, e in enumerate(edits, 1) if "at" in e]
    hits = F.array_compact(F.array(*[F.when(_where(at), F.lit(i)) for i, at in named])) if named else F.array().cast("array<int>")
    r = r.select("doc_id", "para_seq", F.explode(hits).alias("ord"))
    first = [i for i, at in named if at["type"] == "heading"]
    if not first:
        return r.select("doc_id", "ord", "para_seq")
    heads = r.where(F.col("ord").isin(first)).groupBy("doc_id", "ord").agg(F.min("para_seq").alias("para_seq"))
    return r.where(~F.col("ord").isin(first)).select("doc_id", "ord", "para_seq").unionByName(heads)


def refused(p: Packages, edits: list[dict], named: DataFrame) -> DataFrame:
    """(doc_id, ord, para_seq, reason): targets that a field, a revision or a control blocks; overwriteFields lifts fields alone."""
    guarded = [i for i, e in enumerate(edits, 1) if e["op"] in GUARDED]
    lifted = [i for i, e in enumerate(edits, 1) if e.get("overwriteFields")]
    r = named.where(F.col("ord").isin(guarded)).join(p.blockers(), ["doc_id", "para_seq"])
    return r.where(~(F.col("ord").isin(lifted) & (F.col("reason") == "field"))).select("doc_id", "ord", "para_seq", "reason")


class Writer:
    """One package in memory, its paragraphs by their place before any edit."""

    def __init__(self, content: bytes, config: dict):
        self.config = config
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
        self.root = I.open_part(self.parts[package.DOCUMENT])
        self.body = self.root.find(w("body"))
        self.paragraphs = {i: e for i, (e, _) in enumerate(package._blocks(self.body), 1)}
        self.parent = {c: p for p in self.root.iter() for c in p}
        self.doc = B.Document(config.get("captions"), config.get("author"))
        ids = lambda pattern, text: max([0, *map(int, re.findall(pattern, text))])
        rels = self.parts.get("word/_rels/document.xml.rels", b"").decode("utf-8", "replace")
        self.doc.first_rid = ids(r'Id="rId(\d+)"', rels)
        self.doc.first_media = ids(r"media/image(\d+)\.", " ".join(self.parts))
        used = [int(v) for e in self.root.iter() for k, v in e.attrib.items() if k == w("id") and v.isdigit()]
        self.doc.marks = self.doc.revisions = max([0, *used])
        self.doc.drawings = sum(1 for _ in self.root.iter(f"{{{B.WP}}}docPr"))
        self.gone: set[ET.Element] = set()
        self.more_media: list[str] = []  # of headers and footers

    def made(self, fragment: list[dict]) -> list[ET.Element]:
        if not self.config.get("trackChanges"):
            return [e for b in fragment for e in self.doc.block(b)]
        bad = [b["type"] for b in fragment if b["type"] in ("table", "equation")]
        if bad:
            raise EditError(f"a {bad[0]} can't be inserted as a tracked change")
        return [e for b in fragment for e in self.doc.block({**b, "revision": "ins"} if b["type"] == "paragraph" else b)]

    def insert(self, elements: list[ET.Element], by: ET.Element, after: bool) -> None:
        home = self.parent[by]
        at = list(home).index(by) + after
        for k, e in enumerate(elements):
            home.insert(at + k, e)
            self.parent[e] = home

    def drop(self, p: ET.Element) -> None:
        """A paragraph goes, or its text where it ends a section or is tracked; a cell is left with an empty one."""
        home = self.parent[p]
        if self.config.get("trackChanges"):
            runs = p.findall(w("r"))
            for r in runs:
                at = list(p).index(r)
                p.remove(r)
                for t in r.iter(w("t")):
                    t.tag = w("delText")
                p.insert(at, self.doc.revised("del", [r]))
        elif p.find(f"{w('pPr')}/{w('sectPr')}") is not None:
            for c in [c for c in p if c.tag != w("pPr")]:
                p.remove(c)
        else:
            home.remove(p)
            if home.tag == w("tc") and home.find(w("p")) is None:
                home.append(B.element("p"))
        self.gone.add(p)

    def restyle(self, p: ET.Element, style: str) -> None:
        I.merge(p, "pPr", I.PPR, B.para_format(None, style))

    def format(self, p: ET.Element, e: dict) -> None:
        clear = e.get("clearDirect") or []
        clear = ["pPr", "rPr"] if clear == "all" else clear
        box = p.find(w("pPr"))
        if "pPr" in clear and box is not None:
            for c in [c for c in box if c.tag in (w("jc"), w("spacing"), w("ind"), w("outlineLvl"))]:
                box.remove(c)
        if "rPr" in clear:
            for r in [*p.findall(w("r")), *p.findall(w("pPr"))]:
                for c in r.findall(w("rPr")):
                    r.remove(c)
        if e.get("styleId") or e.get("paraFormat"):
            I.merge(p, "pPr", I.PPR, B.para_format(e.get("paraFormat"), e.get("styleId")))
        if e.get("runFormat"):
            for r in p.findall(w("r")):
                I.merge(r, "rPr", I.RPR, B.run_format(e["runFormat"]))

    def set_run(self, p: ET.Element, e: dict) -> None:
        """The text of one run: the one counted, else the k-th blank one (underlined white space)."""
        runs, at = p.findall(w("r")), e["at"]
        if "runIndex" not in at:
            text = lambda r: "".join(t.text or "" for t in r.iter(w("t")))
            runs = [r for r in runs if r.find(f"{w('rPr')}/{w('u')}") is not None and not text(r).strip()]
        k = int(at.get("runIndex", at.get("blank", 1)))
        if k > len(runs):
            raise EditError(f"no run {k}")
        run = runs[k - 1]
        for c in [c for c in run if c.tag != w("rPr")]:
            run.remove(c)
        run.extend(B.text_run(e["with"]))
        if e.get("format"):
            I.merge(run, "rPr", I.RPR, B.run_format(e["format"]))

    def merge(self, ps: list[ET.Element], keep: str) -> None:
        if len(ps) < 2 or len({self.parent[p] for p in ps}) > 1:
            raise EditError("a merge needs two paragraphs or more of one container")
        if self.config.get("trackChanges"):
            raise EditError("a merge can't be tracked")
        first, rest = ps[0], ps[1:]
        for p in rest:
            first.extend([c for c in p if c.tag != w("pPr")])
        if keep == "last":
            old, new = first.find(w("pPr")), rest[-1].find(w("pPr"))
            if old is not None:
                first.remove(old)
            if new is not None:
                first.insert(0, copy.deepcopy(new))
        for p in rest:
            self.parent[p].remove(p)
            self.gone.add(p)

    def edit_caption(self, e: dict) -> None:
        """The text behind a caption's bookmark, else behind its last field."""
        to = e["target"]
        if "anchor" in to:
            found = [p for p in self.paragraphs.values() if any(b.get(w("name")) == to["anchor"] for b in p.iter(w("bookmarkStart")))]
        else:
            seq = re.compile(rf"^\s*SEQ\s+{re.escape(to['captionId'])}\s(?!.*\\r\s)")
            found = [p for p in self.paragraphs.values() if any(seq.match(i.text or "") for i in p.iter(w("instrText")))][int(to["index"]) - 1 :]
        if not found:
            raise EditError(f"no such caption: {to}")
        p = found[0]
        kids = list(p)
        ends = [i for i, c in enumerate(kids) if c.tag == w("bookmarkEnd")] or [i for i, c in enumerate(kids) if any(f.get(w("fldCharType")) == "end" for f in c.iter(w("fldChar")))]
        if not ends:
            raise EditError("a caption without a field")
        for c in kids[ends[-1] + 1 :]:
            p.remove(c)
        if e["text"]:
            kind = to.get("captionId")
            gap = (self.config.get("captions") or {}).get(kind, {}).get("bodySeparator", " ")
            p.append(B.text_run(gap + e["text"]))

    def edit(self, named: dict[int, list[int]]) -> None:
        """All edits in order; each names paragraphs as they were before the first."""
        for i, e in enumerate(self.config.get("edits", []), 1):
            op = e["op"]
            if op == "edit-caption":
                self.edit_caption(e)
                continue
            ps = [self.paragraphs[k] for k in sorted(named.get(i, []))]
            if not ps:
                raise EditError(f"edit {i}: nothing is at {json.dumps(e['at'])}")
            if lost := [p for p in ps if p in self.gone]:
                raise EditError(f"edit {i}: {len(lost)} of its paragraphs are gone by an earlier edit")
            if op == "insert-before":
                self.insert(self.made(e["content"]), ps[0], False)
            elif op == "insert-after":
                self.insert(self.made(e["content"]), ps[-1], True)
            elif op == "replace":
                self.insert(self.made(e["with"]), ps[0], False)
                for p in ps:
                    self.drop(p)
            elif op == "delete":
                for p in ps:
                    self.drop(p)
            elif op == "merge":
                self.merge(ps, e.get("keepPPr", "first"))
            else:
                for p in ps:
                    self.format(p, e) if op == "format" else self.set_run(p, e)
        if not any(c.tag == w("p") for c in self.body):
            self.body.insert(len(self.body) - (self.body.find(w("sectPr")) is not None), B.element("p"))

    def strip(self, p: ET.Element, n: int) -> None:
        """The first n characters of a paragraph's own runs go, across runs."""
        for t in (t for r in p.findall(w("r")) for t in r if t.tag in (w("t"), w("tab"), w("br"), w("cr"))):
            if not n:
                return
            if t.tag == w("t"):
                cut = min(n, len(t.text or ""))
                t.text, n = (t.text or "")[cut:], n - cut
            else:
                next(r for r in p.findall(w("r")) if t in list(r)).remove(t)
                n -= 1

    def strip_number(self, p: ET.Element, patterns: list[str]) -> None:
        """The typed number at the start of a paragraph's own text goes: the first pattern that fits decides."""
        text = "".join((t.text or "") if t.tag == w("t") else "\t" for r in p.findall(w("r")) for t in r if t.tag in (w("t"), w("tab"), w("br"), w("cr")))
        for pattern in patterns:
            if m := re.match(pattern, text):
                self.strip(p, m.end())
                return

    def page_setup(self) -> None:
        """Sizes, orientation, margins, columns and page numbers of each section; a section's own setting beats the one for all, single numbers beat ranges."""
        setup = self.config.get("pageSetup") or {}
        sections = [e for p in self.body for e in ([p] if p.tag == w("sectPr") else p.iterfind(f"{w('pPr')}/{w('sectPr')}") if p.tag == w("p") else [])]
        for i, s in enumerate(sections, 1):
            layers = [{k: v for k, v in setup.items() if k != "sections"}]
            spans = [(k.split("-"), v) for k, v in (setup.get("sections") or {}).items()]
            layers += [v for k, v in spans if len(k) == 2 and int(k[0]) <= i <= int(k[1])] + [v for k, v in spans if k == [str(i)]]
            both: dict = {}
            for x in layers:
                both |= {**x, "margins": {**both.get("margins", {}), **x.get("margins", {})}}
            if both.get("paperSize") or both.get("orientation"):
                size = s.find(w("pgSz"))
                if size is None:
                    size = B.element("pgSz", w=11906, h=16838)
                    s.insert(0, size)
                paper = both.get("paperSize")
                wide, high = (int(size.get(w(k)) or 0) for k in "wh")
                if paper:
                    wide, high = PAPERS[paper] if isinstance(paper, str) else (B.twips(paper["width"]), B.twips(paper["height"]))
                turned = both.get("orientation") or size.get(w("orient")) or "portrait"
                wide, high = sorted((wide, high), reverse=turned == "landscape")
                size.set(w("w"), str(wide))
                size.set(w("h"), str(high))
                size.set(w("orient"), turned)
            if both.get("margins"):
                margins = s.find(w("pgMar"))
                if margins is None:
                    margins = B.element("pgMar", top=1440, right=1440, bottom=1440, left=1440, header=720, footer=720, gutter=0)
                    s.append(margins)
                for k, v in both["margins"].items():
                    margins.set(w(k), str(B.twips(v)))
            if "columns" in both:
                c = both["columns"] if isinstance(both["columns"], dict) else {"count": both["columns"]}
                widths, spaces = c.get("widths"), c.get("spaces") or []
                space = None if c.get("space") is None else B.twips(c["space"])
                cols = B.element("cols", num=len(widths) if widths else int(c["count"]), space=space, sep="1" if c.get("separator") else None, equalWidth="0" if widths else None)
                for k, v in enumerate(widths or []):
                    cols.append(B.element("col", w=B.twips(v), space=B.twips(spaces[k]) if k < len(spaces) else space if k < len(widths) - 1 else None))
                I.merge_one(s, cols)
            if both.get("pgNumType"):
                I.merge_one(s, B.element("pgNumType", fmt=both["pgNumType"].get("fmt"), start=both["pgNumType"].get("start")))
            I.in_order(s, I.SECTION)

    def header_footer(self) -> None:
        """Header and footer parts for each section; sections with the same ones share the parts."""
        config = self.config.get("headerFooter")
        if not config:
            return
        made: dict[str, list[tuple[str, str, str]]] = {}
        sections = [e for p in self.body for e in ([p] if p.tag == w("sectPr") else p.iterfind(f"{w('pPr')}/{w('sectPr')}") if p.tag == w("p") else [])]
        if not sections:
            self.body.append(B.element("sectPr"))
            sections = [self.body[-1]]
        for i, s in enumerate(sections, 1):
            own = I.layered(config, i)
            key = json.dumps(own, sort_keys=True)
            if key not in made:
                made[key] = [(surface, kind, self.margin_part(surface, blocks, variants.get("underline" if surface == "header" else "overline"))) for surface, variants in own.items() for kind, blocks in variants.items() if kind in ("default", "first", "even")]
            for surface in own:
                for e in s.findall(w(f"{surface}Reference")):
                    s.remove(e)
            for surface, kind, rid in made[key]:
                e = B.element(f"{surface}Reference", type=kind)
                e.set(f"{{{B.R}}}id", rid)
                s.append(e)
            if any(kind == "first" for _, kind, _ in made[key]):
                I.merge_one(s, B.element("titlePg"))
            I.in_order(s, I.SECTION)
        if any(kind == "even" for x in made.values() for _, kind, _ in x):
            I.settings(self.parts, "evenAndOddHeaders")

    def margin_part(self, surface: str, blocks: list[dict], line: object) -> str:
        """One header or footer part with its own relationships; returns its id in the document's."""
        n = 1
        while f"word/{surface}{n}.xml" in self.parts:
            n += 1
        own = B.Document()
        own.first_media = self.doc.first_media + len(self.doc.media) + len(self.more_media)
        style = surface.capitalize()
        I.ensure_style(self.parts, "paragraph", style)
        elements = [e for b in blocks for e in own.block({"styleId": style, **b} if b["type"] == "paragraph" else b)] or [B.element("p")]
        if line:
            ps = [e for e in elements if e.tag == w("p")]
            if ps:
                I.merge(ps[-1] if surface == "header" else ps[0], "pPr", I.PPR, [B.element("pPr", B.element("pBdr", I.edge("bottom" if surface == "header" else "top", line)))])
        path = f"word/{surface}{n}.xml"
        self.parts[path] = I.written(B.element("hdr" if surface == "header" else "ftr", *elements))
        if own.rels:
            rels = ET.Element(f"{{{package.REL}}}Relationships")
            rels.extend(ET.Element(f"{{{package.REL}}}Relationship", e.attrib) for e in B._rels(own.rels))
            self.parts[f"word/_rels/{surface}{n}.xml.rels"] = I.written(rels)
        for data, (media, _) in own.media.items():
            self.parts[f"word/{media}"] = data
            self.more_media.append(media)
        types = ET.fromstring(self.parts["[Content_Types].xml"])
        types.append(ET.Element(f"{{{package.TYPES}}}Override", {"PartName": f"/{path}", "ContentType": f"{I.MIME}.{surface}+xml"}))
        self.parts["[Content_Types].xml"] = I.written(types)
        return self.doc._rel(surface, f"{surface}{n}.xml", False)

    def bytes(self) -> bytes:
        """The package with what was changed; all other parts as they were. A style that links name is there, fields are marked to be brought up to date."""
        if any(e.get(w("val")) == "Hyperlink" for e in self.root.iter(w("rStyle"))):
            I.ensure_style(self.parts, "character", "Hyperlink", *B.run_format({"color": "0563C1", "underline": True}))
        if self.config.get("captions") and self.root.find(f".//{w('fldChar')}") is not None:
            I.settings(self.parts, "updateFields")
        self.parts[package.DOCUMENT] = ET.tostring(self.root, encoding="UTF-8", xml_declaration=True)
        if self.doc.rels:
            path = "word/_rels/document.xml.rels"
            old = ET.fromstring(self.parts[path]) if path in self.parts else ET.Element(f"{{{package.REL}}}Relationships")
            for e in B._rels(self.doc.rels):
                old.append(ET.Element(f"{{{package.REL}}}Relationship", e.attrib))
            self.parts[path] = ET.tostring(old, encoding="UTF-8", xml_declaration=True)
        media = [p for p, _ in self.doc.media.values()] + self.more_media
        if media:
            types = ET.fromstring(self.parts["[Content_Types].xml"])
            have = {(e.get("Extension") or "").lower() for e in types}
            for ext in sorted({p.rpartition(".")[2] for p in media} - have):
                types.insert(0, ET.Element(f"{{{package.TYPES}}}Default", {"Extension": ext, "ContentType": B.MEDIA[ext]}))
            self.parts["[Content_Types].xml"] = ET.tostring(types, encoding="UTF-8", xml_declaration=True)
            self.parts |= {f"word/{p}": data for data, (p, _) in self.doc.media.items()}
        return zipped(self.parts)


def zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
        for n, data in parts.items():
            z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def held(d: DataFrame) -> DataFrame:
    """A copy in the folder that the cluster shares, so that what reads it many times does not redo it; a temporary folder where none is set and all runs on one machine."""
    sc = d.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratadoc-"))
    return d.checkpoint()


def opened(files: DataFrame) -> Packages:
    """The packages unzipped once, and their paragraphs scanned once."""
    p = Packages(held(docx.parts(files)))
    p.paragraphs = held(p.paragraphs)
    return p


RESULT = "doc_id string, content binary, error string"
#: What a package that is not as it should be can raise; its row says so, the others go on.
BROKEN = (ValueError, KeyError, IndexError, AttributeError, TypeError, RuntimeError, NotImplementedError, OSError, ET.ParseError, zipfile.BadZipFile, zlib.error, re.error)


def installed(files: DataFrame, config: dict) -> DataFrame:
    """(doc_id, content, error): each package with the configuration's styles, numbering and theme fonts, in one map."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, content in zip(f["doc_id"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        parts = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
                    I.install(parts, config)
                    rows.append((doc, zipped(parts), None))
                except BROKEN as e:
                    rows.append((doc, content, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "error"])

    return files.select("doc_id", "content").mapInPandas(each, RESULT)


def _rewritten(files: DataFrame, plan: DataFrame, change: Callable[[Writer, pd.DataFrame], None], config: dict) -> DataFrame:
    """(doc_id, content, error): each package changed by its rows of the plan."""

    def each(old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        content, error = old["content"].iloc[0], None
        try:
            writer = Writer(content, config)
            change(writer, rows)
            content = writer.bytes()
        except BROKEN as e:
            content, error = old["content"].iloc[0], f"{type(e).__name__}: {e}"
        return pd.DataFrame({"doc_id": [old["doc_id"].iloc[0]], "content": [content], "error": [error]})

    return files.select("doc_id", "content").groupBy("doc_id").cogroup(plan.groupBy("doc_id")).applyInPandas(each, RESULT)


def apply_edits(files: DataFrame, config: dict) -> DataFrame:
    """(doc_id, content, error) of files (doc_id, content) after the configuration's edits."""
    p = opened(files)
    edits = config.get("edits", [])
    named = targets(p, edits)
    plan = named.join(refused(p, edits, named), ["doc_id", "ord", "para_seq"], "left").select("doc_id", "ord", "para_seq", "reason")

    def change(writer: Writer, rows: pd.DataFrame) -> None:
        for r in rows[rows["reason"].notna()].sort_values(["ord", "para_seq"]).itertuples():
            raise EditError(f"edit {r.ord}: paragraph {r.para_seq} is blocked ({r.reason})")
        writer.edit({int(i): [int(x) for x in g] for i, g in rows.groupby("ord")["para_seq"]})

    return _rewritten(files, plan, change, config)


def route(p: Packages, config: dict) -> DataFrame:
    """Indexed paragraphs with the rule that takes each; bulk rules name a look by its label or its hash."""
    looks = p.looks().select("doc_id", "para_seq", "raw_fp")
    names = p.fingerprints().select("doc_id", "raw_fp", "label", "fp_hash")
    bulk = {b["fingerprint"]: b["style"] for b in config.get("bulk_rules", [])}
    style = F.create_map(*[F.lit(x) for kv in bulk.items() for x in kv]) if bulk else None
    found = names.withColumn("bulk_style", F.coalesce(style[F.col("label")], style[F.col("fp_hash")]) if style is not None else F.lit(None).cast("string"))
    rows = p.paragraphs.where("para_index is not null").join(looks.join(found, ["doc_id", "raw_fp"]).select("doc_id", "para_seq", "bulk_style"), ["doc_id", "para_seq"], "left")
    exclude = [int(x) for x in config.get("exclude", [])]
    given = {int(a["para"]): a for a in config.get("assignments", [])}
    out = F.col("para_index").isin(exclude)
    # A paragraph that is kept or flagged by hand is taken too, with the style that it has.
    hand = reduce(lambda c, kv: F.when(F.col("para_index") == kv[0], F.lit(kv[1].get("style")) if kv[1]["action"] == "restyle" else F.coalesce("style_id", F.lit(""))).otherwise(c), given.items(), F.lit(None).cast("string"))
    key = rows.select("doc_id", "para_seq", "para_index", "style_id")
    patterns = [rules.Pattern(("(?i)" if "i" in (r.get("flags") or "") else "") + r["regex"], r["style"], r.get("stripMatch", False)) for r in config.get("pattern_rules", [])]
    # The bulk style is its own key in the route's map, so that labels of one document do not reach another.
    return rules.route(rows.withColumn("raw_fp", F.col("bulk_style")), patterns, key.where(out), key.withColumn("style", hand).where("style is not null"), {s: s for s in bulk.values()})


def rule_faults(p: Packages, config: dict) -> DataFrame:
    """(doc_id, fault): rules that name a style neither declared nor in the document, a paragraph or a look that it does not have."""
    docs = p.parts.select("doc_id").distinct()
    declared = [s["id"] for s in config.get("styles", [])]
    given = [a for a in config.get("assignments", []) if a["action"] == "restyle"]
    named = {x["style"] for key in ("pattern_rules", "bulk_rules") for x in config.get(key, [])} | {a["style"] for a in given}
    index = {int(x) for x in config.get("exclude", [])} | {int(a["para"]) for a in config.get("assignments", [])}
    marks = {b["fingerprint"] for b in config.get("bulk_rules", [])}

    def missing(what: str, wanted: list, have: DataFrame) -> DataFrame:
        each = docs.select("doc_id", F.explode(F.array(*[F.lit(x) for x in wanted])).alias("x")) if wanted else docs.select("doc_id", F.lit(None).alias("x")).where("false")
        return each.join(have, ["doc_id", "x"], "left_anti").select("doc_id", F.concat(F.lit(f"{what} "), F.col("x").cast("string"), F.lit(" is not there")).alias("fault"))

    style = missing("style", sorted(named - set(declared)), p.styles.where("id is not null").select("doc_id", F.col("id").alias("x")))
    para = missing("paragraph", sorted(index), p.paragraphs.where("para_index is not null").select("doc_id", F.col("para_index").cast("int").alias("x")))
    f = p.fingerprints()
    look = missing("fingerprint", sorted(marks), f.select("doc_id", F.col("label").alias("x")).unionByName(f.select("doc_id", F.col("fp_hash").alias("x"))))
    return style.unionByName(para).unionByName(look).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("fault")), "; ").alias("fault"))


def apply_rules(files: DataFrame, config: dict) -> DataFrame:
    """(doc_id, content, error) of files (doc_id, content) with the rules' styles set and what they strip gone; a document that a rule does not fit is left as it is."""
    p = opened(files)
    routed = route(p, config)
    cut = (F.length("text") - F.length("new_text")).alias("cut")
    plan = routed.where("route not in ('keep', 'exclude') and new_style <> ''").select("doc_id", "para_seq", "new_style", cut, F.lit(None).cast("string").alias("fault"))
    plan = plan.unionByName(rule_faults(p, config), allowMissingColumns=True)
    numbers = I.strip_patterns(config)

    def change(writer: Writer, rows: pd.DataFrame) -> None:
        for fault in rows["fault"].dropna():
            raise EditError(fault)
        for r in rows.itertuples():
            p = writer.paragraphs[int(r.para_seq)]
            writer.restyle(p, r.new_style)
            writer.strip(p, int(r.cut))
            if r.new_style in numbers:
                writer.strip_number(p, numbers[r.new_style])
        writer.page_setup()
        writer.header_footer()

    return _rewritten(files, plan, change, config)


def problems(config: dict) -> list[str]:
    """Beside the grammar's: keys that nothing acts on yet, and requirements of styles that are not declared."""
    out = C.problems(config)
    if out:
        return out
    out = [f"{k}: not implemented" for k in ("template",) if config.get(k)]
    out += [f"styles[{i}].fromParagraph: not implemented" for i, s in enumerate(config.get("styles", [])) if "fromParagraph" in s]
    out += [f"trackChanges: a {e['op']} edit can't be tracked" for e in config.get("edits", []) if config.get("trackChanges") and e["op"] in ("format", "set-run", "edit-caption")]
    declared = {s["id"] for s in config.get("styles", [])}
    out += [f'requirements: style "{k}" is not declared' for k in config.get("requirements", {}) if k not in declared]
    acts = ("styles", "numbering", "theme", "edits", "assignments", "bulk_rules", "pattern_rules", "pageSetup", "headerFooter")
    return out + ([] if any(config.get(k) for k in acts) else ["config: nothing to do"])


def apply(files: DataFrame, config: dict) -> DataFrame:
    """(doc_id, content, error) of files (doc_id, content) under a whole configuration: what it installs, its edits, its rules.

    Each step is held, so that the next does not redo it. With dryRun every step runs and
    says what fails, and content is what it was. A package that can't be read has a row
    with an error; so has one that an edit or a rule does not fit.
    """
    if found := problems(config):
        raise C.ConfigError("\n".join(found))
    now = files.select("doc_id", "content", F.lit(None).cast("string").alias("error"))
    if any(config.get(k) for k in ("styles", "numbering", "theme")):
        now = held(installed(files, config))
    if config.get("edits"):
        now = held(apply_edits(now.where("error is null"), config).unionByName(now.where("error is not null")))
    done = apply_rules(now.where("error is null"), config).unionByName(now.where("error is not null"))
    if config.get("dryRun"):
        return held(done.select("doc_id", "error")).join(files.select("doc_id", "content"), "doc_id").select("doc_id", "content", "error")
    # a package that failed goes out as it came in
    failed = done.where("error is not null").select("doc_id", "error")
    return done.where("error is null").unionByName(files.select("doc_id", "content").join(failed, "doc_id"))
