"""Tables and page geometry: the layout or data decision, paper sizes, usable width, layered page setup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cell with more paragraphs holds running text.
BULK_CELL = 5
#: Paper sizes in twips.
PAPERS = [("A4", 11906, 16838), ("A4", 16838, 11906), ("A3", 16838, 23811), ("A5", 8392, 11906), ("Letter", 12240, 15840), ("Legal", 12240, 20160)]


def classify(cells: DataFrame) -> DataFrame:
    """(doc_id, table_idx, rows, cols, classification, reason) from cells (r, span, paras, outline): cell, row, then table, in two aggregations."""
    rows = cells.groupBy("doc_id", "table_idx", "r").agg(F.count("*").alias("tcs"), F.sum("span").alias("cols"), F.sum("paras").alias("paras"), F.max("paras").alias("most"), F.max("outline").alias("outline"))
    t = rows.groupBy("doc_id", "table_idx").agg(F.count("*").alias("rows"), F.max("cols").alias("cols"), F.sum("paras").alias("paras"), F.max("most").alias("most"), F.max("tcs").alias("tcs"), F.max("outline").alias("outline"))
    reason = (
        F.when((F.col("rows") == 1) & (F.col("cols") == 1), "1x1")
        .when((F.col("tcs") == 1) & (F.col("paras") > 3), "singleTcStack")
        .when(F.col("outline"), "outlineLvl")
        .when(F.col("most") > BULK_CELL, "bulkCell")
        .when((F.col("rows") > 1) & (F.col("cols") > 1), "multiColData")
        .otherwise("fallback")
    )
    return t.withColumn("reason", reason).select("doc_id", "table_idx", "rows", "cols", F.when(F.col("reason").isin("multiColData", "fallback"), "data").otherwise("layout").alias("classification"), "reason")


def paper(sects: DataFrame, slack: int = 50) -> DataFrame:
    """Adds paper and usable_width: the first known size within `slack` twips, else Custom; the width less its margins, 0 at least."""
    name = F.coalesce(*[F.when((F.abs(F.col("width") - w) < slack) & (F.abs(F.col("height") - h) < slack), F.lit(n)) for n, w, h in PAPERS], F.lit("Custom"))
    return sects.withColumns({"paper": name, "usable_width": F.greatest(F.lit(0), F.col("width") - F.col("margin_left") - F.col("margin_right")).cast("long")})


def selected_sections(selectors: DataFrame) -> DataFrame:
    """(selector, section_index) of selectors "N" and "N-M"."""
    lo = F.split("selector", "-")[0].cast("long")
    hi = F.coalesce(F.get(F.split("selector", "-"), F.lit(1)), F.split("selector", "-")[0]).cast("long")
    return selectors.select("selector", F.explode(F.sequence(lo, hi)).alias("section_index"))


def layered(sects: DataFrame, overrides: DataFrame, fields: list[str], defaults: dict[str, int], slack: int = 1) -> DataFrame:
    """Page setup: an override (selector) beats the default, which beats what is there; single numbers come before ranges, ranges in written order, the last one wins. changed: over `slack` twips in any field."""
    picked = selected_sections(overrides).join(overrides, "selector").withColumn("rank", F.when(F.contains(F.col("selector"), F.lit("-")), F.col("ord") + 1_000_000).otherwise(F.split("selector", "-")[0].cast("int")))
    last = picked.groupBy("section_index").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("rank"))).alias(f"o_{f}") for f in fields])
    r = sects.join(last, "section_index", "left")
    new = {f: F.coalesce(f"o_{f}", F.lit(defaults.get(f)).cast("int"), f) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | F.coalesce(F.abs(new[f] - F.col(f)) > slack, new[f].isNotNull() != F.col(f).isNotNull())
    return r.select("doc_id", "section_index", *[new[f].alias(f) for f in fields], changed.alias("changed"))


def same_configs(sects: DataFrame, fields: list[str]) -> DataFrame:
    """(config, sections): sections with the same header and footer share one part."""
    return sects.groupBy(F.to_json(F.struct(*fields)).alias("config")).agg(F.count("*").alias("sections"))
