"""Streaming twins of the corpus operators, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.quality import general_rejection


def rejection_counts(docs: DataFrame) -> DataFrame:
    reason = general_rejection(X.stripped(F.col("text")))
    return docs.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def dedup(docs: DataFrame) -> DataFrame:
    """Rows whose normalised text the stream hasn't had. The state is a hash per
    distinct text, without end: keep-first over a whole corpus has to know them
    all. dedup_within bounds it where rows carry a time."""
    return docs.withColumn("h", X.normalized_hash(F.col("text"))).dropDuplicates(["h"])


def dedup_within(docs: DataFrame, time: str, late: str) -> DataFrame:
    """As dedup, but texts are forgotten once the watermark has passed them."""
    return docs.withColumn("h", X.normalized_hash(F.col("text"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["h"])


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
