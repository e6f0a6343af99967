"""Hybrid search: an index of tables, lexical and dense lists, fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.stage import staged
from . import lexicon, retrieval, vectors

# The default retrieval configuration.
CONFIG = {
    "embedding_model": {"name": "sentence-transformers/multi-qa-MiniLM-L6-cos-v1", "revision": "b207367332321f8e44f96e224ef15bc607f4dbf0"},
    "reranker_model": {"name": "cross-encoder/ms-marco-MiniLM-L6-v2", "revision": "233902d25c440f23af6f7d6e94d2946bac0bee0a"},
    "candidate_multiplier": 10, "rrf_constant": 60, "hnsw_connections": 32, "hnsw_construction_depth": 200,
}

Search = Callable[[DataFrame, int], DataFrame]
"""A provider: queries (query_id, text, ...) and k to query_id, key, score, rank."""


def encoded(rows: DataFrame, text: str, encoder: Callable[[pd.Series], pd.Series], name: str = "embedding", batch: int = 256) -> DataFrame:
    """rows with the embedding that an encoder gives for `batch` texts at a time.
    A batch whose result isn't one vector per text is an error."""
    schema = rows.withColumn(name, F.array().cast("array<float>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                found = list(encoder(part[text]))
                if len(found) != len(part) or len({len(x) for x in found}) > 1:
                    raise ValueError("the encoder returned an invalid matrix")
                yield part.assign(**{name: [[float(y) for y in x] for x in found]})

    return rows.mapInPandas(run, schema)


def valid_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows; an error where a vector is missing or unlike the first in length."""
    size = F.size(vector)
    ok = F.coalesce(size > 0, F.lit(False)) & (size == F.lit((rows.select(size).head() or [0])[0]))
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a vector has another length")).cast("boolean")))


def fused(lexical: DataFrame, dense: DataFrame, key: str, constant: float = 60.0) -> DataFrame:
    """query_id, key, score, bm25, dense, rank: both lists in a full outer join, a
    missing score being 0. Equal scores keep the order in which ids are first
    seen: the lexical list, then the dense one."""
    a = lexical.select("query_id", key, F.col("score").alias("bm25"), F.col("rank").alias("_a"))
    b = dense.select("query_id", key, F.col("score").alias("dense"), F.col("rank").alias("_b"))
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", key], "full_outer").withColumn("score", part("_a") + part("_b"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("_a").isNull(), "_a", "_b")
    return both.select("query_id", key, "score", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("dense", F.lit(0.0)).alias("dense"), F.row_number().over(w).alias("rank"))


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the given keys."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def hydrated(found: DataFrame, chunks: DataFrame, key: str, n: int, provider: str = "local") -> DataFrame:
    """The n best of each query with cleaned title, snippet and content, and the
    map of their scores."""
    # The n best of each query go to the chunks, not the chunks to them.
    best = F.broadcast(found.where(F.col("rank") <= n)).join(chunks.select(key, "title", "url", "content"), key)
    parts = F.map_from_arrays(F.array(*map(F.lit, ("rrf", "bm25", "dense"))), F.array("score", "bm25", "dense"))
    return best.select("query_id", key, X.sanitized(F.col("title"), limit=500).alias("title"), "url", X.sanitized(F.col("content"), limit=500).alias("snippet"), X.sanitized(F.col("content")).alias("content"), "score", F.lit(provider).alias("provider"), parts.alias("score_components"), "rank")


def reranked(found: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int, key: str) -> DataFrame:
    """The k best by a scorer over (query, title and content); equal ones keep
    their order. The score goes into score_components too."""
    asked = found.withColumn("_x", F.concat("title", F.lit("\n"), "content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=scorer(f["query"], f["_x"]).astype("float64"))

    scored = asked.mapInPandas(run, asked.schema).drop("_x")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumn("score_components", F.map_concat("score_components", F.create_map(F.lit("reranker"), "score")))


def hybrid(queries: DataFrame, lexical: Search, dense: Search, chunks: DataFrame | Callable[[DataFrame], DataFrame], key: str, k: int, config: dict = CONFIG) -> DataFrame:
    """The k best chunks of each query; a query of white space has none. chunks is a
    table, or gives the chunks of found rows."""
    asked = queries.where(F.length(X.stripped(F.col("text"))) > 0)
    limit = max(k, k * int(config["candidate_multiplier"]))
    both = fused(lexical(asked, limit), dense(asked, limit), key, config["rrf_constant"])
    if callable(chunks):
        both = staged(both.where(F.col("rank") <= k), "hybrid")
    return hydrated(both, chunks(both) if callable(chunks) else chunks, key, k)


def chunk_table(docs: DataFrame) -> DataFrame:
    """chunk_id, title, url, content of documents (id, title, url, text)."""
    rows = docs.select("id", "title", "url", F.posexplode(X.chunked(F.col("text"))).alias("position", "content"))
    return rows.select(F.concat_ws(":", "id", "position").alias("chunk_id"), "title", "url", "content")


def lexical_search(docs: DataFrame, key: str, fields: dict[str, Column], boosts: dict[str, float]) -> Search:
    """BM25 over several fields, the sum of their boosted scores."""

    def run(queries: DataFrame, n: int) -> DataFrame:
        scores = retrieval.bm25(docs, queries, key, fields, boosts)
        return retrieval.top(scores.withColumn("score", F.round("score", 6)), n, key)

    return run


def dense_search(corpus: DataFrame, key: str) -> Search:
    """Exact cosine search of the queries' column `query` over all rows."""
    return lambda queries, n: vectors.exact_top(corpus, queries, key, n, decimals=6)


def quantised_search(index: vectors.Quantised, candidates: int = 50, probes: int | None = None) -> Search:
    """Search in a stored index, by the queries' column `query`."""
    return lambda queries, n: index.search(queries, n, candidates, probes)


def lexicon_search(index: lexicon.Lexicon, key: str) -> Search:
    """Search in a stored lexical index, by the queries' column `text`."""
    return lambda queries, n: index.search(queries, n, key)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """One row: the share of exact results that were found."""
    hits = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hits.agg(F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)).alias("recall"))
