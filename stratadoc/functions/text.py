"""Formats, sizes and names as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as reports collapse it, blanks of all scripts included.
BLANKS = r"[\s   -     　﻿]+"

#: Built-in style names and their Chinese forms.
STYLE_NAMES = [
    ("Normal", "正文"),
    *[(f"heading {n}", f"标题 {n}") for n in range(1, 10)],
    ("Title", "标题"),
    ("Subtitle", "副标题"),
    ("Body Text", "正文文本"),
    ("Caption", "题注"),
    ("Quote", "引用"),
    ("List Bullet", "列表项目符号"),
    ("List Number", "列表编号"),
    ("Header", "页眉"),
    ("Footer", "页脚"),
    *[(f"TOC {n}", f"目录 {n}") for n in range(1, 4)],
    ("Default Paragraph Font", "默认段落字体"),
    ("Normal Table", "普通表格"),
    ("No List", "无列表"),
]

#: Points of the Chinese names of font sizes.
FONT_SIZES = {"初号": 42.0, "小初": 36.0, "一号": 26.0, "小一": 24.0, "二号": 22.0, "小二": 18.0, "三号": 16.0, "小三": 15.0, "四号": 14.0, "小四": 12.0, "五号": 10.5, "小五": 9.0, "六号": 7.5, "小六": 6.5}

#: Fixed value: characters of which a run is a typed number or bullet and nothing else.
NUMBER_RUN = r"^[\d一二三四五六七八九十百千零０-９.()（）【】［］〔〕\[\]•·○●◆◇■□★☆※\-、，,\s]+$"


def plain(n: Column) -> Column:
    """A number without trailing zeros, four decimals at most."""
    return F.regexp_replace(F.format_string("%.4f", n.cast("double")), r"\.?0+$", "")


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def canonical_style_name(name: Column) -> Column:
    """The English form of a built-in style's name; any other name as it is."""
    return F.coalesce(F.element_at(_map((zh, en) for en, zh in STYLE_NAMES), name), name)


def font_size(name: Column) -> Column:
    """Points of a Chinese size name; null for others."""
    return F.element_at(_map(FONT_SIZES.items()), name)


def millimetres(twips: Column) -> Column:
    return F.round(twips / 56.6929, 1)


def pad3(n: Column) -> Column:
    """At least three digits."""
    s = n.cast("string")
    return F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def truncate(text: Column, most: int) -> Column:
    """White space collapsed, trimmed, and cut with an ellipsis."""
    one = F.trim(F.regexp_replace(text, BLANKS, " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most), F.lit("…")))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / 1048576))


def line_spacing(line: Column, rule: Column) -> Column:
    """A line measure: fixed or least points, else a multiple to two decimals."""
    return F.when(rule == "exact", F.concat(plain(line / 20), F.lit("pt fixed"))).when(rule == "atLeast", F.concat(plain(line / 20), F.lit("pt atLeast"))).otherwise(F.concat(plain(F.floor(line / 240 * 100 + 0.5) / 100), F.lit("×")))


def line_spacing_key(multiple: Column, exact_pt: Column, least_pt: Column) -> Column:
    """The three ways to declare a line measure as one comparable mode:value."""
    at = lambda mode, n: F.concat(F.lit(f"{mode}:"), F.round(n).cast("long").cast("string"))
    return F.when(multiple.isNotNull(), at("auto", multiple * 240)).when(exact_pt.isNotNull(), at("exact", exact_pt * 20)).when(least_pt.isNotNull(), at("atLeast", least_pt * 20))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def description(f: dict[str, Column]) -> Column:
    """A look in words: font, points, marks, color, alignment, first-line indent, then the heading's level or List."""
    parts = [
        F.coalesce(_some(f["font_east_asia"]), _some(f["font_ascii"]), _some(f["font_h_ansi"])),
        F.concat(plain(f["size"] / 2), F.lit("pt")),
        *[F.when(F.coalesce(f[k], F.lit(False)), F.lit(v)) for k, v in (("bold", "Bold"), ("italic", "Italic"))],
        F.when(_some(f["underline"]).isNotNull(), "Underline"),
        F.when(f["caps"], "Caps"),
        F.when(_some(f["color"]) != "auto", F.concat(F.lit("#"), f["color"])),
        F.concat(F.upper(F.substring(f["alignment"], 1, 1)), F.substring(f["alignment"], 2, 99)),
        F.when(F.coalesce(f["first_line_indent"], F.lit(0)) != 0, "1stIndent"),
        F.coalesce(F.concat(F.lit("Heading-"), (f["outline_level"] + 1).cast("string")), F.when(_some(f["num_id"]).isNotNull(), "List")),
    ]
    words = F.concat_ws(" ", *parts)
    return F.when(words == "", "(no formatting)").otherwise(words)


def run_properties(f: dict[str, Column], on_only: bool = False) -> Column:
    """Run formats as name: value parts. Of equal Latin and CJK fonts one is told; on_only leaves out what is off."""
    latin, cjk = F.coalesce(f["font_ascii"], f["font_h_ansi"]), f["font_east_asia"]
    quoted = lambda name, c: F.concat(F.lit(f'{name}: "'), c, F.lit('"'))
    both = latin == cjk
    toggle = lambda k: F.when(f[k] | F.lit(not on_only), F.concat(F.lit(f"{k}: "), f[k].cast("string")))
    return F.concat_ws(
        ", ",
        F.when(both, quoted("font", latin)),
        F.when(~F.coalesce(both, F.lit(False)), quoted("fontCJK", _some(cjk))),
        F.when(~F.coalesce(both, F.lit(False)), quoted("fontLatin", _some(latin))),
        F.concat(F.lit("size: "), plain(f["size"] / 2), F.lit("pt")),
        toggle("bold"),
        toggle("italic"),
        F.concat(F.lit("color: "), _some(f["color"])),
    )


def footer_format(instructions: Column, page_numbers: Column) -> Column:
    """How a footer shows page numbers: the section's own format, else the switch of its PAGE field, else decimal; null without such a field."""
    switch = _some(F.regexp_extract(instructions, r"\\\*\s*([A-Za-z]+)", 1))
    return F.coalesce(_some(page_numbers), F.when(instructions.rlike("(?i)PAGE"), F.coalesce(switch, F.lit("decimal"))))
