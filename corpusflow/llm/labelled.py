"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table

#: Labelled rows that a classifier is fitted on at most.
FIT_ROWS = 16_000


def sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most `rows` labelled documents outside
    the held-out fold: those whose hashed id is smallest. Repeated labels of a
    document are averaged, null ones ignored; of rows with one id the least text counts."""
    once = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(column).alias("mean"))
    chosen = once.where(crc_mod("doc_id", modulus) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", (F.col("mean") >= 0.5).cast("int").alias("y"))
    # At most `rows` ids are sent to every task.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")
