"""Rule routing over paragraphs: exclude, assignment, first pattern, bulk, keep; and what it strips and leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A pattern rule: matches at the text's start; `strip` removes what matched."""

    regex: str
    style: str
    strip: bool = False


def route(paragraphs: DataFrame, patterns: list[Pattern], exclude: DataFrame | None = None, assign: DataFrame | None = None, bulk: dict[str, str] | None = None) -> DataFrame:
    """Adds route, rule and new_style, and new_text where a rule strips. exclude and assign (style): doc_id, para_seq; bulk: style by raw_fp.

    All patterns are one CASE over the text, evaluated once in order.
    """
    p = paragraphs
    keys = ["doc_id", "para_seq"]
    p = p.join(exclude.select(*keys, F.lit(True).alias("_x")), keys, "left") if exclude is not None else p.withColumn("_x", F.lit(None).cast("boolean"))
    p = p.join(assign.select(*keys, F.col("style").alias("_a")), keys, "left") if assign is not None else p.withColumn("_a", F.lit(None).cast("string"))
    hit = F.coalesce(*[F.when(F.col("text").rlike(f"^(?:{r.regex})"), F.lit(i)) for i, r in enumerate(patterns)], F.lit(None).cast("int"))
    by_bulk = F.element_at(F.create_map(*[F.lit(x) for kv in bulk.items() for x in kv]), F.col("raw_fp")) if bulk else F.lit(None).cast("string")
    p = p.withColumns({"_p": hit, "_b": by_bulk})
    kind = F.when(F.col("_x"), "exclude").when(F.col("_a").isNotNull(), "assignment").when(F.col("_p").isNotNull(), "pattern").when(F.col("_b").isNotNull(), "bulk").otherwise("keep")
    p = p.withColumn("route", kind)
    style = F.when(F.col("route") == "assignment", F.col("_a")).when(F.col("route") == "bulk", F.col("_b"))
    text = F.col("text")
    for i, r in enumerate(patterns):
        mine = (F.col("route") == "pattern") & (F.col("_p") == i)
        style = F.when(mine, F.lit(r.style)).otherwise(style)
        if r.strip:
            text = F.when(mine, F.regexp_replace("text", f"^(?:{r.regex})", "")).otherwise(text)
    return p.withColumns({"new_style": F.coalesce(style, F.when(F.col("route") != "exclude", F.col("style_id"))), "new_text": text, "rule": F.when(F.col("route") == "pattern", F.col("_p"))}).drop("_x", "_a", "_p", "_b")


def strip_stats(routed: DataFrame) -> DataFrame:
    """(rule, matched, stripped): paragraphs a pattern took, and those it shortened."""
    return routed.where("rule is not null").groupBy("rule").agg(F.count("*").alias("matched"), F.count_if(F.length("new_text") < F.length("text")).alias("stripped"))


def kept(routed: DataFrame, by: str) -> DataFrame:
    """(by, empty, non_empty): paragraphs that no rule took."""
    blank = F.trim(F.col("text")) == ""
    return routed.where("route = 'keep'").groupBy(by).agg(F.count_if(blank).alias("empty"), F.count_if(~blank).alias("non_empty"))


def samples(routed: DataFrame, by: str, most: int = 5) -> DataFrame:
    """The first `most` paragraphs of each value of `by`."""
    w = Window.partitionBy(by).orderBy("doc_id", "para_seq")
    return routed.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).withColumn("nth", F.col("nth").cast("long"))


def mixed_prefixes(paragraphs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(style_id, n, kinds, mixed): how many kinds of typed numbers each style's paragraphs begin with."""
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in kinds.items()])
    r = paragraphs.withColumn("_k", kind).where("_k is not null")
    return r.groupBy("style_id").agg(F.count("*").alias("n"), F.count_distinct("_k").alias("kinds")).withColumn("mixed", F.col("kinds") >= 2)


def strippable(runs: DataFrame, provided: DataFrame) -> DataFrame:
    """(doc_id, para_seq, prop): direct run properties that are the same in all runs of a paragraph and that its style chain (style_id, prop) sets."""
    total = Window.partitionBy("doc_id", "para_seq")
    n = F.size(F.collect_set("run_idx").over(total))
    r = runs.withColumn("_n", n).groupBy("doc_id", "para_seq", "style_id", "prop", "_n").agg(F.count_distinct("value").alias("values"), F.count_distinct("run_idx").alias("in_runs"))
    return r.where("values = 1 and in_runs = _n").join(provided, ["style_id", "prop"], "left_semi").select("doc_id", "para_seq", "prop")
