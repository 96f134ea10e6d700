"""A training-data pipeline over documents: five of the corpus operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. run() applies them in order. In every stage a null text counts
as empty, whole texts are read however long, other columns are carried along whatever
their names, and an empty table gives an empty result. A doc_id stands for a document:
where rows share one, a stage other than drop_copies judges them together. Rows without
a doc_id are judged by drop_copies alone and stay in the other filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.llm import decontaminate, exact_dedup, mixing, quality, simhash
from stratadoc.llm.base import checkpoint, maybe_broadcast, table

#: Ids of dropped documents that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = checkpoint(ids.distinct())
    return docs.join(maybe_broadcast(ids, ids.count(), MOST_BROADCAST), "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects: documents more likely of grade 0 (low quality) than above.

    Grade 1 is good but toxic, and stays on purpose: this stage judges quality alone,
    toxicity has its own operator. Without labels of two grades nothing is dropped. An
    empty text has no features, so the thresholds alone decide it. Repeated rows get the
    same verdict; of a document's conflicting labels the lower grade holds.
    """
    model = quality.train(docs, quality.label_grades(table(spark, sf_dir, "labels")), grades=3)
    return _without(docs, quality.score(docs, model).where("not accepted").select("doc_id"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays, and one row of it where that row repeats.

    Null and empty texts are equal. Rows with one doc_id and different texts are
    different documents here. Of rows that repeat with different other columns, the
    row that comes first as JSON stays. Rows without a doc_id go where their text has a row with one, and
    else one of them stays.
    """
    judged = checkpoint(exact_dedup.exact_groups(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("t"), "kept"))
    gone = judged.where("not kept").distinct().select("i", "t", F.lit(1).alias("n"))
    again = judged.where("kept").groupBy("i", "t").agg(F.count("*").alias("n")).where("n > 1")
    marks = checkpoint(gone.unionByName(again).withColumn("gone", F.col("n") == 1))
    few = maybe_broadcast(marks, marks.count(), MOST_BROADCAST)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")).alias("d")
    met = lambda m, how: rows.join(m.alias("m"), F.expr("d.i <=> m.i and d.t = m.t"), how)
    rest = met(few, "left_anti").select("row")
    if marks.where("not gone").limit(1).count():  # a repeated row adds up in each task before it moves
        once = met(few.where("not gone"), "inner").groupBy("d.i", "d.t").agg(F.min_by("row", F.to_json("row")).alias("row"))
        rest = rest.unionByName(once.select("row"))
    return rest.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the one with the least doc_id stays.

    Near are fingerprints within 3 of 64 bits, as the fingerprint operator has it;
    pairs at a word-shingle similarity of 0.8 often differ at more (README). Empty texts
    share fingerprint zero and are one group.
    """
    return _without(docs, simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Empty texts hold none; an empty benchmark drops nothing."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shares the training words out over the sources and gives each document its positions.

    A null source is a source; empty texts have size 0 and no position; repeated rows
    count each, ties go by md5 of doc_id, then doc_id.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: SQL can't express the classifier or the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
