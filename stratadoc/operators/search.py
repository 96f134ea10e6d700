"""Text search: literal and regular-expression hits with places, runs and contexts; lints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces whose lengths are added up at a time.
CHUNK = 256


def find_paragraphs(paragraphs: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """Paragraphs whose text matches; `limit` a document, in order (null: all). The filter runs before the window."""
    hits = paragraphs.where(F.col("text").rlike(pattern))
    if limit is None:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_seq"))).where(F.col("_n") <= limit).drop("_n")


def find_literal(paragraphs: DataFrame, needle: str, context: int = 25) -> DataFrame:
    """(doc_id, para_seq, ch, len, matched, context): occurrences that don't overlap, from 0; an empty needle, and one with a tab or line end, has none.

    Offsets are sums over the lengths of the pieces between the occurrences: over whole
    chunks of them first, then inside one, so many hits in a paragraph stay cheap.
    """
    n = len(needle)
    if not needle or re.search(r"[\t\n]", needle):
        paragraphs = paragraphs.where(F.lit(False))
    pieces = F.split("text", re.sub(r"([^\w\s])", r"\\\1", needle) or "x", -1)
    total = "aggregate(slice({}, {}, cast({} as int)), 0, (a, x) -> a + x)".format
    chunks = f"transform(sequence(0, cast((size(l) - 1) div {CHUNK} as int)), c -> {total('l', f'c * {CHUNK} + 1', CHUNK)})"
    one = f"{total('c', 1, f'(i - 1) div {CHUNK}')} + {total('l', f'cast((i - 1) div {CHUNK} as int) * {CHUNK} + 1', f'(i - 1) % {CHUNK} + 1')} - {n}"
    at = F.expr(f"transform(array(transform(pieces, x -> length(x) + {n})), l -> transform(array({chunks}), c -> transform(sequence(1, size(l) - 1), i -> {one}))[0])[0]")
    r = paragraphs.where(F.contains(F.col("text"), F.lit(needle))).withColumn("pieces", pieces).where("size(pieces) > 1")
    r = r.select("doc_id", "para_seq", "text", F.explode(at).alias("ch"))
    return r.select("doc_id", "para_seq", F.col("ch").cast("long").alias("ch"), F.lit(n).cast("long").alias("len"), F.lit(needle).alias("matched"), around(F.col("text"), F.col("ch"), F.lit(n), context).alias("context"))


def around(text: Column, at: Column, n: Column, context: int) -> Column:
    """The match with `context` characters on either side, marked where more is left out."""
    start, end = F.greatest(at - context, F.lit(0)), at + n + context
    cut = F.substring(text, (start + 1).cast("int"), (F.least(end, F.length(text)) - start).cast("int"))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))


def find_regex(paragraphs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, para_seq, nth, matched): non-empty matches in order, by the JVM's expressions; those across a tab or line end are none, and count in nth."""
    r = paragraphs.where(F.col("text").rlike(pattern)).select("doc_id", "para_seq", F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("nth", "matched"))
    return r.where((F.col("matched") != "") & ~F.col("matched").rlike(r"[\t\n]")).select("doc_id", "para_seq", (F.col("nth") + 1).cast("long").alias("nth"), "matched")


def overlaps(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, para_seq, ch, first_run, last_run, cross_run, region): the segments (run_index, start, end, region) that a hit (ch, len) touches.

    The range condition is checked inside the equality on the paragraph, so the join stays a hash or merge join.
    """
    on = (hits["doc_id"] == segments["doc_id"]) & (hits["para_seq"] == segments["para_seq"]) & (segments["start"] < hits["ch"] + hits["len"]) & (segments["end"] > hits["ch"])
    r = hits.join(segments, on).groupBy(hits["doc_id"], hits["para_seq"], hits["ch"])
    return r.agg(F.min("run_index").alias("first_run"), F.max("run_index").alias("last_run"), F.min_by("region", "start").alias("region")).withColumn("cross_run", F.col("first_run") < F.col("last_run"))


#: Shapes of typed captions and what each suggests, in the order they are tried.
CAPTION_SHAPES = [
    (r"^图\s*\d+(?:[.-]\d+)?", "Figure"),
    (r"^表\s*\d+(?:[.-]\d+)?", "Table"),
    (r"(?i)^Figure\s+\d+(?:[.-]\d+)?", "Figure"),
    (r"(?i)^Table\s+\d+(?:[.-]\d+)?", "Table"),
    (r"(?i)^Equation\s+\d+(?:[.-]\d+)?", "Equation"),
    (r"^\(\s*\d+(?:[.-]\d+)?\s*\)", "Equation"),
    (r"^\[\s*\d+(?:[.-]\d+)?\s*\]", "Equation"),
]

#: Number prefixes that people type.
TYPED_PREFIXES = [
    r"^\s*\d+(\.\d+)+\s",
    r"^\s*\d+\.\s",
    r"^\s*\d+、",
    r"^\s*第[一二三四五六七八九十百千零〇0-9]+[章节篇部条款]",
    r"^\s*[一二三四五六七八九十百千零〇]+、",
    r"^\s*[（(][一二三四五六七八九十百千零〇0-9]+[)）]",
    r"^\s*[①-⑳⒈-⒛]",
    r"(?i)^\s*Chapter\s+\d+",
]


def caption_candidates(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_seq, identifier, prefix): paragraphs that look like typed captions; the first shape that fits decides."""
    identifier = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(i)) for p, i in CAPTION_SHAPES])
    prefix = F.coalesce(*[F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 0)) for p, _ in CAPTION_SHAPES])
    return paragraphs.select("doc_id", "para_seq", identifier.alias("identifier"), prefix.alias("prefix")).where("identifier is not null")


def typed_prefixes(paragraphs: DataFrame, numbered: DataFrame) -> DataFrame:
    """(style_id, kind, n): typed numbers by style, bound where the style (style_id) numbers by itself."""
    hit = F.col("text").rlike("|".join(f"(?:{p})" for p in TYPED_PREFIXES))
    r = paragraphs.where(hit).join(numbered.select("style_id", F.lit(True).alias("bound")), "style_id", "left")
    return r.groupBy("style_id").agg(F.when(F.first("bound"), "bound").otherwise("unbound").alias("kind"), F.count("*").alias("n"))


def cjk_spacing(paragraphs: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, para_seq, nth, hit): spaces typed between CJK and Latin letters or digits, up to `most` a text: after CJK first, then before it."""
    after, before = "([\\u3400-\\u4dbf\\u4e00-\\u9fff] +[A-Za-z0-9])", "([A-Za-z0-9] +[\\u3400-\\u4dbf\\u4e00-\\u9fff])"
    hits = F.slice(F.concat(F.regexp_extract_all("text", F.lit(after), F.lit(1)), F.regexp_extract_all("text", F.lit(before), F.lit(1))), 1, most)
    return paragraphs.select("doc_id", "para_seq", F.posexplode(hits).alias("nth", "hit")).select("doc_id", "para_seq", (F.col("nth") + 1).cast("long").alias("nth"), "hit")
