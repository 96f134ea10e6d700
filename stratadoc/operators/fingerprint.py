"""Visual fingerprints of paragraphs: the raw key, its hash, labels by frequency, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counters


def raw(p: DataFrame) -> Column:
    """font|size|flags|color|alignment|indent|list of resolved columns; empty strings count as unset."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    flag = lambda c, letter: F.when(c, letter).otherwise("")
    flags = F.concat(flag(F.col("bold"), "B"), flag(F.col("italic"), "I"), flag(some("underline").isNotNull(), "U"), flag(F.col("caps"), "C"))
    return F.concat_ws(
        "|",
        F.coalesce(some("font_ascii"), some("font_h_ansi"), some("font_east_asia"), F.lit("?")),
        F.coalesce(F.col("size").cast("string"), F.lit("?")),
        flags,
        F.when(F.col("color") != "auto", F.col("color")).otherwise(""),
        F.coalesce("alignment", F.lit("")),
        F.when(F.coalesce("first_line_indent", F.lit(0)) != 0, "1stInd").otherwise(""),
        F.when(F.col("num_id") != "", "L").otherwise(""),
    )


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 6)


def letters(n: Column) -> Column:
    """A to Z, AA, AB, ...: n from 0; six letters name 321 million."""
    return counters.alpha(n + 1)


def summary(paragraphs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, raw_fp, label, fp_hash, n, first_doc, first_seq, avg_len, dominant_style) of paragraphs with raw_fp, doc_id, para_seq, style_id, text.

    Over the corpus, or inside each document with by=["doc_id"]. Labels go by falling
    count, ties by key. A style dominates with 0.8 of the paragraphs; ties go to the one
    seen first; Normal never does. Two aggregations, both partial in each task; labels
    rank the few distinct keys.
    """
    keys = list(by)
    place = F.struct("doc_id", "para_seq")
    of_style = paragraphs.groupBy(*keys, "raw_fp", "style_id").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.sum(F.length(F.trim(F.col("text")))).alias("chars"))
    best = F.min_by(F.struct("style_id", "n"), F.when(F.col("style_id").isNotNull(), F.struct(-F.col("n"), F.col("first"))))
    out = of_style.groupBy(*keys, "raw_fp").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("chars").alias("chars"), best.alias("best"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "raw_fp")) - 1
    dominant = F.when((F.col("best.style_id") != "Normal") & (F.col("best.n") >= 0.8 * F.col("n")), F.col("best.style_id"))
    return out.withColumn("rank", rank).select(*keys, "raw_fp", letters(F.col("rank")).alias("label"), short_hash(F.col("raw_fp")).alias("fp_hash"), "n", F.col("first.doc_id").alias("first_doc"), F.col("first.para_seq").alias("first_seq"), F.floor(F.col("chars") / F.col("n") + 0.5).cast("long").alias("avg_len"), dominant.alias("dominant_style"))


def dominant_run(runs: DataFrame) -> DataFrame:
    """(doc_id, para_seq, run_idx): the run with the longest text, the later of equals."""
    return runs.groupBy("doc_id", "para_seq").agg(F.max_by("run_idx", F.struct(F.length("text"), F.col("run_idx"))).alias("run_idx"))


def diversity(runs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, values, verdict): how many values a property takes over the runs; unset is a value."""
    long = runs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("<absent>")).alias("value")) for f in fields])).alias("x"))
    n = F.count_distinct("x.value")
    return long.groupBy("doc_id", F.col("x.field").alias("field")).agg(n.alias("values"), F.when(n > 1, "mixed").otherwise("uniform").alias("verdict"))
