"""SimHash near-duplicates: pigeonhole blocks find close fingerprints, Hamming distance verifies them.

A fingerprint is split into `blocks` blocks. Two that differ at up to `distance` bits
agree on at least blocks - distance whole blocks, so each distinct fingerprint is put
under every choice of that many blocks (6 blocks, 3 bits: 20 keys of 32 bits) and meets
all its partners. Copies share one fingerprint and count once. A key with over
`most_bucket` distinct fingerprints is not paired up: its fingerprints go to the points
at distance 1 and 2 from them. Two fingerprints at distance 3 or less meet at a point
that is within 1 of the one and 2 of the other, and all that meet there link to the
least that is within 1, at a number of rows that grows with the fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpoint, texts
from .graph import components

_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, A-Z lower-cased; 0 without words."""
    w = text.encode().lower().split()  # of bytes: lowers A-Z alone, cuts at 0x20 and 0x09 to 0x0D alone
    if not w:
        return 0
    s = list(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))) if len(w) >= shingle else [b" ".join(w)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(s), _CHUNK):
        h = np.array([digest(x, 42) for x in s[i : i + _CHUNK]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(s)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) per row of docs (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of blocks - distance blocks, as signed 64-bit numbers."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, blocks - distance)]


def links(fps: DataFrame, distance: int = 3, blocks: int = 6, most_bucket: int = 256) -> DataFrame:
    """(a, b): a set of links among the distinct `fp` that joins the same fingerprints as all links at `distance` (3 at most)."""
    if not 0 <= distance <= 3 or blocks <= distance:
        raise ValueError("distance must be 0 to 3 and under blocks")
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(blocks, distance))])
    met = fps.select("fp").distinct().select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    met = checkpoint(met.withColumn("n", F.count("*").over(Window.partitionBy("c", "key"))).where("n > 1"))
    few = met.where(F.col("n") <= most_bucket).select("c", "key", F.col("fp").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), ["c", "key"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")

    many = met.where(F.col("n") > most_bucket).select("fp").distinct()
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    reach = {0: ("array(0L)", "array(0L)"), 1: ("array(0L)", f"concat(array(0L), {one})"), 2: (f"concat(array(0L), {one})",) * 2, 3: (f"concat(array(0L), {one})", f"concat(array(0L), {two})")}[distance]
    ball = lambda r: many.select("fp", F.explode(F.expr(f"transform({r}, m -> fp ^ m)")).alias("point"))
    centre = ball(reach[0]).groupBy("point").agg(F.min("fp").alias("b"))
    stars = ball(reach[1]).join(centre, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: int = 6, most_bucket: int = 256, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs (doc_id, text).

    Texts link when their fingerprints differ at `distance` bits or fewer; component_id
    is the least doc_id that can be reached. A null or empty text, or one of white
    space, has fingerprint zero and is linked like any other. Repeated rows stay and
    link to each other. An empty table gives an empty result. Other columns are ignored.
    """
    d = checkpoint(fingerprints(docs, shingle))
    fps = checkpoint(d.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, distance, blocks, most_bucket))
    least = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "first")
    least = least.join(least.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("node").alias("fp"), "component_id")
    of = checkpoint(fps.join(least, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return d.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
