"""Plain tables as paragraph rows: (doc_id, para_seq, style_id, text), para_seq unique and ordered in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags at which a block of a web page begins or ends, and those that make a paragraph.
BLOCK_EDGE = r"<(/?(?:h[1-6]|p|li|ul|ol|div|table|tr|td|th|pre|section|article|header|footer|nav|main|body|html|head|title|script|style|blockquote)\b)"
BLOCK = r"^<(h1|p|li)\b"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document, a turn a paragraph, its role the style."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_seq"), F.col("role").alias("style_id"), "text")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a paragraph, numbered from 1; the language is the style."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = t.select("doc_id", F.col("lang").alias("style_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("para_seq"), "style_id", "text")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each h1, p and li of a web page, whole, up to where a block ends or the next begins, without the tags inside; headings are Heading1, items List, the rest Body."""
    t = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pieces = F.filter(F.split(F.regexp_replace("html", BLOCK_EDGE, "\u0001<$1"), "\u0001"), lambda x: x.rlike(BLOCK))
    blocks = t.select(F.col("page_id").alias("doc_id"), F.posexplode(pieces).alias("n", "b"))
    tag = F.regexp_extract("b", BLOCK, 1)
    style = F.when(tag == "h1", "Heading1").when(tag == "li", "List").otherwise("Body")
    return blocks.select("doc_id", (F.col("n") + 1).cast("long").alias("para_seq"), style.alias("style_id"), F.regexp_replace("b", "<[^>]*>", "").alias("text"))
