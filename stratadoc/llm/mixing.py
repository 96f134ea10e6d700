"""Mixing sources to target weights on a time-varying curriculum. DataFrame functions only.

Targets: the words of all sources are shared out by weight; no target is above
`most_epochs` times its source's words. The shares are w * level, cut at the caps;
`level` solves sum(min(w * level, cap)) = all words, which sorting the sources by
cap / w gives in one pass.

Positions: source s asks for target_s * (1 + slope_s * (2t - 1)) words a unit of time,
t from 0 to 1. The integral u(t) = t + slope * (t * t - t) is its share used up at t;
inverting it gives the time at which a document's first word is due, in each pass: pass
i puts i times the source's words before it. Documents of a
source stand in the order of md5(doc_id); the words before each are a prefix sum in two
levels, over md5 prefixes (buckets) and inside a bucket, so a source with a third of
all rows is spread over its buckets. The result is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACE_WORD


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """(sk, rank, source_size, target, slope) from (sk, source_size), one row a source.

    Sources in the order of sk take the weights in turn.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("rank", F.row_number().over(Window.orderBy("sk"))).withColumns({"w": w, "cap": most_epochs * F.col("source_size")})
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"total": F.sum("source_size").over(every), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open_w": F.sum("w").over(rest)})
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "sk", "level"))).over(every)["level"])
    return rows.select(
        "sk",
        "rank",
        "source_size",
        F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")).alias("target"),
        ((F.pmod(F.col("rank"), F.lit(3)) - 1) * 0.5).alias("slope"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_epochs: int = 3, bucket_digits: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, positions) per row of docs (doc_id, text, source), sorted by position.

    size: words of the whole text (null: 0). taken: words the mix takes from the
    document, its repeats counted: as many whole passes as the target has, then the
    first documents in md5 order up to the rest, the last one in part. So each source's
    taken words differ from its target by less than one word, and no document gives
    more than most_epochs times its size. position: the time, 0 to 1, at which its
    first word is due; null if nothing is taken. positions: the same for each pass over
    the document, the last perhaps in part; empty if nothing is taken. A null source is a source, the last.
    Repeated rows each count; reruns agree. An empty table gives an empty result; other
    columns are ignored. Rows without a doc_id stand in the order of md5 of their texts.
    bucket_digits: hex digits of md5 that make a bucket.
    """
    d = docs.select(
        "doc_id",
        "source",
        F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("sk"),
        F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("text")), F.lit(""))).alias("okey"),
    ).withColumn("bucket", F.substring("okey", 1, bucket_digits))
    buckets = d.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = source_targets(buckets.groupBy("sk").agg(F.sum("bucket_size").alias("source_size")), weights, most_epochs)
    starts = buckets.withColumn("bucket_start", F.sum("bucket_size").over(Window.partitionBy("sk").orderBy("bucket")) - F.col("bucket_size")).join(goals, "sk")
    inside = Window.partitionBy("sk", "bucket").orderBy("okey", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = d.join(starts, ["sk", "bucket"]).withColumn("before", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))
    goal = F.round(F.col("target")).cast("long")
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(0).cast("long")).withColumn("rest", goal - F.col("passes") * F.col("source_size"))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    k = F.col("slope")

    def due(before: Column) -> Column:
        u = before / F.col("target")
        return F.when(k == 0, u).otherwise(F.abs((k - 1 + F.sqrt((1 - k) * (1 - k) + 4 * k * u)) / (2 * k)))  # no -0.0

    count = F.ceil(F.col("taken") / F.col("size")).cast("int")  # a pass in part is the last
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: due(F.col("before") + i * F.col("source_size")))
    return (
        rows.withColumn("taken", F.least(taken, F.lit(most_epochs) * F.col("size")).cast("long"))
        .withColumn("position", F.when(F.col("taken") > 0, due(F.col("before"))))
        .withColumn("positions", F.when(F.col("taken") > 0, each).otherwise(F.array().cast("array<double>")))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )
