"""Order-dependent operators in closed form: numbering, captions, list restarts, fields, islands, drift.

All of them are windows over one document, so they share its partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counters

START = Window.unboundedPreceding


def numbering_counters(rows: DataFrame, levels: int = 3) -> DataFrame:
    """Adds value_0 .. value_(levels - 1) to rows (doc_id, num_id, para_seq, level, start_0 ...): the counters as each paragraph shows them.

    A paragraph at level l raises counter l and restarts the deeper ones. Level k's
    value is its start - 1 plus the paragraphs at k since the last one above it (the
    epoch); null while nothing at k or above has come.
    """
    run = Window.partitionBy("doc_id", "num_id").orderBy("para_seq").rowsBetween(START, 0)
    count = lambda c: F.sum(c.cast("int"))
    out = rows
    for k in range(levels):
        out = out.withColumns({f"_e{k}": count(F.col("level") < k).over(run), f"_r{k}": count(F.col("level") <= k).over(run)})
    for k in range(levels):
        epoch = Window.partitionBy("doc_id", "num_id", f"_e{k}").orderBy("para_seq").rowsBetween(START, 0)
        value = F.col(f"start_{k}") - 1 + count(F.col("level") == k).over(epoch)
        out = out.withColumn(f"value_{k}", F.when(F.col(f"_r{k}") > 0, value).cast("long"))
    return out.drop(*[f"_{x}{k}" for x in "er" for k in range(levels)])


def level_text(pattern: Column, formats: list[Column], legal: Column, levels: int = 3) -> Column:
    """The pattern with %1, %2, ... replaced by the counters value_0, value_1, ...; legal numbering is decimal throughout."""
    for k in range(levels):
        shown = F.coalesce(counters.numbering(F.when(legal, F.lit("decimal")).otherwise(formats[k]), F.col(f"value_{k}")), F.lit(""))
        pattern = F.replace(pattern, F.lit(f"%{k + 1}"), shown)
    return pattern


def caption_counters(rows: DataFrame) -> DataFrame:
    """Adds parent and sub to the captions among rows (doc_id, ident, para_seq, kind, sub_group, new_value).

    kind: caption or reset. A reset sets the parent counter to new_value - 1 (null: 0).
    A caption that does not continue a group raises the parent; sub counts inside a
    group that was started, 0 for one that stands alone.
    """
    run = Window.partitionBy("doc_id", "ident").orderBy("para_seq").rowsBetween(START, 0)
    r = rows.withColumns({"_epoch": F.sum((F.col("kind") == "reset").cast("int")).over(run), "_base": F.coalesce(F.last(F.when(F.col("kind") == "reset", F.coalesce(F.col("new_value") - 1, F.lit(0))), True).over(run), F.lit(0))})
    r = r.where("kind = 'caption'").withColumn("_step", (~F.col("sub_group").eqNullSafe("continue")).cast("int"))
    epoch = Window.partitionBy("doc_id", "ident", "_epoch").orderBy("para_seq").rowsBetween(START, 0)
    r = r.withColumn("parent", (F.col("_base") + F.sum("_step").over(epoch)).cast("long"))
    group = Window.partitionBy("doc_id", "ident", "_epoch", "parent").orderBy("para_seq").rowsBetween(START, 0)
    r = r.withColumn("sub", F.when(F.col("sub_group").isNull(), 0).otherwise(F.row_number().over(group)).cast("long"))
    return r.drop("_epoch", "_base", "_step", "kind", "new_value")


def restarts(rows: DataFrame, target: str, mode: str, boundary: str | None = None, others: Sequence[str] = (), base_num: str | None = None) -> DataFrame:
    """(doc_id, para_seq, run_no): the runs, from 1, of the target style's paragraphs that each get a counter of their own.

    perInstance: any other paragraph ends a run. byHeading and atStyleChange: a
    paragraph of the boundary style does. others: list styles that restart in another
    way; they end no run, be they headings or not. base_num (byHeading): the scheme's
    id; a paragraph (num_id) with another of its own ends the run and is in none.
    """
    breaks = F.col("style_id") != target if mode == "perInstance" else F.col("style_id") == boundary
    breaks = F.coalesce(breaks, F.lit(mode == "perInstance")) & ~F.coalesce(F.col("style_id").isin(list(others)), F.lit(False))
    apart = (F.col("style_id") == target) & (F.col("num_id") != base_num) if base_num is not None else F.lit(False)
    apart = F.coalesce(apart, F.lit(False))
    seen = F.sum((breaks | apart).cast("int")).over(Window.partitionBy("doc_id").orderBy("para_seq").rowsBetween(START, 0))
    r = rows.withColumn("_epoch", seen).where((F.col("style_id") == target) & ~apart)
    return r.select("doc_id", "para_seq", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_epoch")).cast("long").alias("run_no"))


def fork_ids(runs: DataFrame, highest: DataFrame) -> DataFrame:
    """(doc_id, run_no, num_id): a new numbering id for every run, above the document's highest (doc_id, max_num)."""
    return runs.select("doc_id", "run_no").distinct().join(highest, "doc_id").select("doc_id", "run_no", (F.col("max_num") + F.col("run_no")).alias("num_id"))


def field_depth(events: DataFrame) -> DataFrame:
    """Adds depth after each event (doc_id, event_seq, kind): begin +1, end -1, never under 0.

    The running sum less its running minimum, where that is under 0.
    """
    run = Window.partitionBy("doc_id").orderBy("event_seq").rowsBetween(START, 0)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    r = events.withColumn("_s", F.sum(step).over(run))
    return r.withColumn("depth", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(run))).cast("long")).drop("_s")


def blockers(events: DataFrame) -> DataFrame:
    """(doc_id, para_seq, reason) of paragraphs that can't be edited: inside a field, a tracked change or an sdt; the first reason holds."""
    d = field_depth(events)
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("doc_id").orderBy("event_seq")), F.lit(0))
    reason = F.when(F.col("kind").isin("ins", "del"), "tracked-change").when(F.col("kind") == "sdt", "sdt").when((before > 0) & (F.col("kind") == "p") | (F.col("kind") == "begin"), "field")
    return d.withColumn("reason", reason).where("reason is not null").groupBy("doc_id", "para_seq").agg(F.min_by("reason", "event_seq").alias("reason"))


def empty_runs(items: DataFrame) -> DataFrame:
    """(doc_id, first_seq, last_seq, n): neighbouring empty paragraphs as one row; items inside layout tables do not part them."""
    body = items.where("not in_layout")
    run = Window.partitionBy("doc_id").orderBy("item_seq").rowsBetween(START, 0)
    r = body.withColumn("_island", F.sum((~F.col("is_empty")).cast("int")).over(run)).where("is_empty")
    return r.groupBy("doc_id", "_island").agg(F.min("item_seq").alias("first_seq"), F.max("item_seq").alias("last_seq"), F.count("*").alias("n")).drop("_island")


def sections(paragraphs: DataFrame) -> DataFrame:
    """Adds section_index, from 1: a paragraph that holds section properties is the last of its section."""
    before = Window.partitionBy("doc_id").orderBy("para_seq").rowsBetween(START, -1)
    return paragraphs.withColumn("section_index", (F.coalesce(F.sum(F.col("has_sect").cast("int")).over(before), F.lit(0)) + 1).cast("long"))


def section_changes(sects: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, section_index, field, old, new) where a section differs from the one before."""
    w = Window.partitionBy("doc_id").orderBy("section_index")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lag(F.col(f).cast("string")).over(w).alias("old"), F.col(f).cast("string").alias("new")) for f in fields])
    r = sects.select("doc_id", "section_index", F.row_number().over(w).alias("n"), pairs.alias("p")).where("n > 1")
    return r.select("doc_id", "section_index", F.explode("p").alias("p")).select("doc_id", "section_index", "p.*").where("not (old <=> new)")


def neighbours(paragraphs: DataFrame, radius: int = 4) -> DataFrame:
    """Adds around: the lengths of the texts up to `radius` paragraphs before and after, in order."""
    w = Window.partitionBy("doc_id").orderBy("para_seq").rowsBetween(-radius, radius)
    return paragraphs.withColumn("around", F.collect_list(F.length("text").cast("long")).over(w))


def drift(edits: DataFrame) -> DataFrame:
    """(doc_id, from_index, shift): from that paragraph on, how far the edits (doc_id, at, delta) move indices; bands without a change are left out."""
    at = edits.groupBy("doc_id", "at").agg(F.sum("delta").alias("delta"))
    r = at.withColumn("shift", F.sum("delta").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(START, 0)).cast("long")).where("delta <> 0")
    return r.select("doc_id", F.col("at").alias("from_index"), "shift")


def skipped_levels(headings: DataFrame) -> DataFrame:
    """(doc_id, para_seq, level, before): headings more than one level under the one before."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy("doc_id").orderBy("para_seq")), F.lit(0))
    return headings.withColumn("before", before).where("level > before + 1").select("doc_id", "para_seq", "level", "before")


def nearest_heading(paragraphs: DataFrame, heading: str) -> DataFrame:
    """Adds heading_seq and heading_no: the last heading at or before each paragraph, and how many have come."""
    w = Window.partitionBy("doc_id").orderBy("para_seq").rowsBetween(START, 0)
    is_heading = F.col("style_id") == heading
    return paragraphs.withColumns({"heading_seq": F.last(F.when(is_heading, F.col("para_seq")), True).over(w), "heading_no": F.sum(is_heading.cast("int")).over(w).cast("long")})
