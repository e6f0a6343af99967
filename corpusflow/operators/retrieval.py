"""Chunking, BM25, exact vector search, fusion, hydration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def chunks(docs: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, position, chunk_id, content."""
    rows = docs.select("doc_id", F.posexplode(X.chunked(F.col("text"), size, overlap)).alias("position", "content"))
    return rows.withColumn("chunk_id", F.concat_ws(":", "doc_id", "position"))


def terms(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: F.octet_length(t) <= 40)


def bm25(docs: DataFrame, queries: DataFrame, key: str, fields: dict[str, Column], boosts: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score of every match: BM25 per field, summed by boosts.

    Of the documents' words those of the queries alone leave their task, once,
    and are dealt by document; what a query's words weigh goes to all tasks (a
    row per query, field and word), so that scores are made where a document
    lies and no frequent word is one task's."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(c).alias("w")) for f, c in fields.items()])).alias("f")
    words = docs.select(key, each).select(key, "f.field", "f.w")
    totals = words.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).collect()  # a row per field
    known = lambda values: F.element_at(F.create_map(*[F.lit(x) for f, v in values for x in (f, float(v))]), F.col("field"))
    if not totals:
        totals = [(f, 0, 1.0) for f in fields]
    n, mean = known([(f, c) for f, c, _ in totals]), known([(f, m or 1) for f, _, m in totals])
    boost = known([(f, (boosts or {}).get(f, 1.0)) for f in fields])
    found = words.select(key, "field", F.size("w").alias("length"), F.explode("w").alias("term")).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    index = found.repartition(key).groupBy(key, "field", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = index.groupBy("field", "term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(asked), "term").select("field", "term", "query_id", (boost * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("weight"))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    parts = index.select(key, "field", "term", tf.alias("part"))
    return parts.join(F.broadcast(weights), ["field", "term"]).groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def top(scores: DataFrame, n: int, key: str) -> DataFrame:
    """The n best per query with their rank; ties by key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fuse(rankings: list[DataFrame], key: str, constant: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, key, rank)."""
    if constant <= 0:
        raise ValueError("the constant must be positive")
    all_ = rankings[0].select("query_id", key, "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("query_id", key, "rank"))
    return all_.groupBy("query_id", key).agg(F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"))


def rerank(candidates: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], n: int, key: str) -> DataFrame:
    """Replace scores by those of a scorer over (query, content), keep the n best."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=scorer(f["query"], f["content"]).astype("float64"))

    return top(candidates.mapInPandas(run, candidates.schema), n, key)
