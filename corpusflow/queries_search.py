"""Queries of hybrid search: benchmark items ask, documents and vectors of the same ids answer."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from .functions import text as X
from .operators import search, vectors
from .plans.stage import scratch
from .registry import query, table

COSINE = "e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM e), dn AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round(list_inner_product(x.e, q.e) / (x.l * q.l), 6) AS score FROM n q JOIN n x ON q.vec_id IN (SELECT item_id FROM benchmark)), d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn QUALIFY rank <= 50)"


def _field(field: str, name: str) -> str:
    return rf"""{name}w AS (SELECT doc_id, list_filter(regexp_extract_all(lower({field}), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 40) AS ws FROM documents),
{name}t AS (SELECT doc_id, term, count(*) AS tf, any_value(len(ws)) AS dl FROM (SELECT doc_id, ws, unnest(ws) AS term FROM {name}w) GROUP BY 1, 2),
{name}q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: strlen(t) <= 40)) AS term FROM benchmark),
{name}d AS (SELECT term, count(*) AS df FROM {name}t GROUP BY 1), {name}n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM {name}w),
{name} AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM {name}t JOIN {name}d USING (term) JOIN {name}q USING (term), {name}n GROUP BY 1, 2)"""


TITLE = "string_split(text, chr(10))[1]"
LEXICAL = f"{_field(TITLE, 'h')}, {_field('text', 'b')}, ls AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT query_id, doc_id, 2.0 * score FROM h) GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ls QUALIFY rank <= 50)"
FUSED = f"{COSINE}, {LEXICAL}, f AS (SELECT query_id, doc_id, coalesce(1 / (60.0 + l.rank), 0) + coalesce(1 / (60.0 + d.rank), 0) AS score, coalesce(l.score, 0) AS bm25, coalesce(d.score, 0) AS dense, l.rank AS lr, d.rank AS dr FROM l FULL JOIN d USING (query_id, doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, lr IS NULL, lr, dr) AS rank FROM f)"


def _parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.concat(F.lit("doc:"), "doc_id").alias("url"))
    rows = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    queries = asked.join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    lexical = search.lexical_search(docs, "doc_id", {f: F.col(f) for f in ("title", "content")}, {"title": 2.0, "content": 1.0})
    dense = search.dense_search(rows.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return queries, lexical, dense, docs


@query(f"WITH {FUSED} SELECT query_id, doc_id, round(score, 9) AS score, bm25, dense, rank FROM r")
def rrf_fusion(spark, sf_dir):
    queries, lexical, dense, _ = _parts(spark, sf_dir)
    out = search.fused(lexical(queries, 50), dense(queries, 50), "doc_id")
    return out.select("query_id", "doc_id", F.round("score", 9).alias("score"), "bm25", "dense", F.col("rank").cast("long").alias("rank"))


SANITIZED = "regexp_replace(%s, '" + X.UNPRINTABLE + "', ' ', 'g')"


@query(f"WITH {FUSED} SELECT query_id, doc_id, r.rank, round(r.score, 9) AS score, sha256(left({SANITIZED % 'text'}, 500)) AS snippet, round(dense, 6) AS dense FROM r JOIN documents USING (doc_id) WHERE r.rank <= 5")
def hybrid_topk(spark, sf_dir):
    queries, lexical, dense, docs = _parts(spark, sf_dir)
    out = search.hybrid(queries, lexical, dense, docs, "doc_id", 5)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.sha2("snippet", 256).alias("snippet"), F.round(F.col("score_components")["dense"], 6).alias("dense"))


@query(f"""WITH {FUSED}, s AS (SELECT query_id, doc_id, r.rank AS was, (length({TITLE}) + length(text)) % 7 AS score FROM r JOIN documents USING (doc_id) WHERE r.rank <= 5)
SELECT query_id, doc_id, score::DOUBLE AS score, score::DOUBLE AS reranker, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM s) WHERE rank <= 3""")
def rerank_pluggable(spark, sf_dir):
    """A scorer that looks at lengths only."""
    queries, lexical, dense, docs = _parts(spark, sf_dir)
    found = F.broadcast(search.hybrid(queries, lexical, dense, docs, "doc_id", 5).drop("content", "title")).join(docs.select("doc_id", "content", "title"), "doc_id")
    named = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scorer = lambda q, x: x.map(lambda t: (len(t) - 1) % 7)
    out = search.reranked(named.drop("provider", "url", "snippet"), scorer, 3, "doc_id")
    return out.select("query_id", "doc_id", "score", F.col("score_components")["reranker"].alias("reranker"), F.col("rank").cast("long").alias("rank"))


@query()
def ann_topk(spark, sf_dir):
    """The product-quantised index, written and then searched: 16 bytes a row are
    scored, 50 vectors a query are read. Recall: see README."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vectors.Quantised.build(rows, "vec_id", f"{scratch(spark)}/vectors-{uuid.uuid4().hex}")
    out = index.search(queries, 10)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT doc_id, [length(text)::DOUBLE, (doc_id % 3)::DOUBLE]::VARCHAR AS vector FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def pluggable_encoder(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\t", "doc_id", F.length(F.coalesce("text", F.lit("")))).alias("text"))
    encoder = lambda s: pd.Series([[float(t.split("\t")[1]), float(int(t.split("\t")[0]) % 3)] for t in s])
    out = search.valid_vectors(search.encoded(rows, "text", encoder))
    return out.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", "), F.lit("]")).alias("vector"))
