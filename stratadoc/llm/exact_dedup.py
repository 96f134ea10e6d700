"""Exact deduplication: binary fuse filters of an immutable snapshot screen a new batch.

The snapshot's digests (SHA-256) get one static filter a shard; the batch's distinct
digests are screened against the filter of their shard. Positives join the snapshot's
exact buckets on the whole digest. Digests that occur twice in the batch itself are
grouped apart from that. The texts of the digests found in either way, and of no others,
are then grouped on digest and text, so equal means equal bytes.

Up to `most_broadcast` repeated digests (counted; 32 bytes each) are broadcast, so rows
find their group without a shuffle. More are joined by a shuffle on the digest; a digest
may hold a third of all rows, so there those with over 1 / (4 * partitions) of the rows,
at most 4 * partitions of them, are dealt out by a salt. The grouping on text adds up in
each task before anything moves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, shuffle_partitions
from .fuse_filter import FuseFilter


def _key(digest: Column) -> Column:
    return F.xxhash64(digest)


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, segment, segments, filter): one static filter a shard of the snapshot's digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["k"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.segments], "filter": [f.table.tobytes()]})

    keys = digests.select(_key(F.col("digest")).alias("k")).distinct().withColumn("shard", F.pmod("k", F.lit(shards)))
    return keys.groupBy("shard").applyInPandas(build, "shard long, seed string, segment long, segments long, filter binary")


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The digests that the filter of their shard may hold: all that it holds, and 1 in 256 of the others."""

    def keep(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(theirs) or not len(mine):
            return mine[["digest"]].iloc[:0]
        x = theirs.iloc[0]
        f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["filter"], np.uint8))
        return mine.loc[f.has(mine["k"].to_numpy().view(np.uint64)), ["digest"]]

    mine = digests.select("digest", _key(F.col("digest")).alias("k")).withColumn("shard", F.pmod("k", F.lit(shards)))
    return mine.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(keep, "digest binary")


def exact_groups(docs: DataFrame, in_snapshot: Column, shard_rows: int = 500_000, most_broadcast: int = 1_000_000, digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256)) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of docs (doc_id, text).

    in_snapshot: true for the rows of the immutable snapshot, on the columns of docs;
    the others are the new batch. Texts are equal when their bytes are; null counts as
    empty, and empty texts are equal. Of equal texts the largest doc_id stays, in the
    snapshot or not. Rows with one doc_id and one text count each in group_size and are
    kept or dropped together; without any doc_id in a group, all its rows are kept. An
    empty table gives an empty result. Other columns are ignored. shard_rows: rows a
    filter's shard is meant for. digest: hex digits of a text; texts of one digest that
    differ are kept apart, whatever the digest.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    d = d.withColumn("digest", F.unhex(digest(F.col("text"))))
    ids = checkpoint(d.select("doc_id", "digest", "old"))
    by_digest = checkpoint(ids.groupBy("digest", "old").agg(F.count("*").alias("n")))
    n = by_digest.agg(F.sum("n")).first()[0] or 0
    shards = max(parts, -(-n // shard_rows))
    old, new = by_digest.where("old"), by_digest.where("not old")
    positives = screen(new, build_filters(old, shards), shards)
    in_both = positives.join(old.select("digest"), "digest", "left_semi")
    suspects = in_both.unionByName(by_digest.where("n > 1").select("digest")).distinct()
    suspects = checkpoint(suspects.join(by_digest.groupBy("digest").agg(F.sum("n").alias("n")), "digest"))
    few = suspects.count() <= most_broadcast

    often = suspects.where(F.col("n") * (4 * parts) > n).select("digest", F.lit(parts).alias("salts"))  # at most 4 * parts rows
    salted = lambda x: x.join(F.broadcast(often), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    spread = lambda x: x.join(F.broadcast(often), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    def meet(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
        if few:
            return rows.join(F.broadcast(groups), "digest", how)
        return salted(rows).join(spread(groups), ["digest", "salt"], how).drop("salt")

    same = meet(d.drop("old"), suspects.select("digest"), "left_semi").groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    same = same.join(F.broadcast(suspects) if few else suspects, "digest")
    # Texts of one digest that differ: none are known, but the digest alone must not decide.
    same = checkpoint(same.select("digest", F.when(F.col("group_size") < F.col("n"), F.col("text")).alias("text"), "group_size", "keep_id"))
    out = meet(ids.drop("old"), same.where("text is null").select("digest", "group_size", "keep_id"), "left")
    mixed = same.where("text is not null")
    if mixed.limit(1).count():
        apart = meet(d.drop("old"), mixed.select("digest").distinct(), "left_semi").join(mixed, ["digest", "text"])
        rest = out.join(mixed.select("digest").distinct(), "digest", "left_anti")
        out = rest.unionByName(apart.select("doc_id", "digest", "group_size", "keep_id"))
    return out.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
