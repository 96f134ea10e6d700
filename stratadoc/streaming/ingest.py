"""A landing folder of Word packages as a stream: each file is whole, so every micro-batch stands alone and needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import docx


def packages(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("doc_id"), "content")


def runs_to(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the runs of all files that are there, and of later ones at the next call."""
    rows = docx.runs(docx.parts(packages(spark, path)))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
