"""Edits as set operations: targets on the snapshot, gates, the new order, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def targets(edits: DataFrame) -> DataFrame:
    """(doc_id, ord, op, para_seq): each edit (doc_id, ord, op, lo, hi) with the paragraphs it names, before any edit runs."""
    return edits.select("doc_id", "ord", "op", F.explode(F.sequence("lo", "hi")).alias("para_seq"))


def apply(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, new_seq, text): replace, delete, insert-before, insert-after; edits carry text.

    The new order is a key: inserts before a paragraph stand in the order of the edits,
    inserts after it in the reverse, as each goes right behind its anchor; a replacement
    stands before what it replaces.
    """
    t = targets(edits)
    gone = t.where("op in ('delete', 'replace')").select("doc_id", "para_seq").distinct()
    kept = paragraphs.join(gone, ["doc_id", "para_seq"], "left_anti").select("doc_id", F.col("para_seq").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), "text")
    before = edits.where("op in ('insert-before', 'replace')").select("doc_id", F.col("lo").alias("k1"), F.lit(-1).alias("k2"), F.col("ord").alias("k3"), "text")
    after = edits.where("op = 'insert-after'").select("doc_id", F.col("hi").alias("k1"), F.lit(1).alias("k2"), (-F.col("ord")).alias("k3"), "text")
    rows = kept.unionByName(before).unionByName(after)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k1", "k2", "k3")).cast("long").alias("new_seq"), "text")


def stale(edits: DataFrame) -> DataFrame:
    """(doc_id, ord, para_seq): targets that an earlier edit has removed."""
    t = targets(edits)
    first = t.where("op in ('delete', 'replace')").groupBy("doc_id", "para_seq").agg(F.min("ord").alias("gone"))
    return t.join(first, ["doc_id", "para_seq"]).where("ord > gone").select("doc_id", "ord", "para_seq")


def refused(edits: DataFrame, blocked: DataFrame, overwrite_fields: bool = False) -> DataFrame:
    """(doc_id, ord, para_seq, reason): targets in paragraphs that can't be edited; overwriting fields lifts that reason alone."""
    b = blocked.where("reason <> 'field'") if overwrite_fields else blocked
    return targets(edits).where("op in ('replace', 'delete', 'merge', 'format')").join(b, ["doc_id", "para_seq"]).select("doc_id", "ord", "para_seq", "reason")


def preview(edits: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(op, edits, paragraphs, chars): what each kind of edit would touch."""
    t = targets(edits).join(paragraphs.select("doc_id", "para_seq", F.length("text").alias("chars")), ["doc_id", "para_seq"], "left")
    return t.groupBy("op").agg(F.count_distinct("doc_id", "ord").alias("edits"), F.count("*").alias("paragraphs"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def deltas(edits: DataFrame) -> DataFrame:
    """(doc_id, at, delta): by how many paragraphs each edit moves what follows."""
    size = F.col("hi") - F.col("lo") + 1
    delta = F.when(F.col("op") == "delete", -size).when(F.col("op") == "replace", 1 - size).when(F.col("op").isin("insert-before", "insert-after"), 1).otherwise(0)
    at = F.when(F.col("op") == "insert-before", F.col("lo")).otherwise(F.col("hi") + 1)
    return edits.select("doc_id", at.alias("at"), delta.alias("delta"))


def merge(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, para_seq, text): the paragraphs of each merge as one, at the first of them."""
    span = edits.where("op = 'merge'").select("doc_id", "lo", "hi")
    p = paragraphs.join(span, ["doc_id"], "left").where("lo is null or para_seq between lo and hi")
    joined = p.where("lo is not null").groupBy("doc_id", F.col("lo").alias("para_seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_seq", "text"))), lambda x: x["text"]), "").alias("text"))
    rest = paragraphs.join(targets(edits.where("op = 'merge'")), ["doc_id", "para_seq"], "left_anti").select("doc_id", "para_seq", "text")
    return rest.unionByName(joined)
