"""BM25 against a plain version, and what of it is shuffled."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import retrieval, search


def plain(docs, queries, boosts):
    out = Counter()
    for field, boost in boosts.items():
        held = {i: Counter((d[field] or "").split()) for i, d in docs.items()}
        known = [sum(c.values()) for i, c in held.items() if docs[i][field] is not None]
        df, mean = Counter(w for c in held.values() for w in c), sum(known) / len(known)
        for q, text in queries.items():
            for w in set(text.split()):
                for i, c in held.items():
                    if c[w]:
                        idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                        out[q, i] += boost * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return out


def test_bm25_leaves_only_asked_words(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    docs = {i: {"title": text(3), "content": text(rng.randint(1, 40)) + " the the"} for i in range(120)}
    docs[7]["content"] = None
    queries, boosts = {1: "the aa b", 2: "ccc zz the", 3: ""}, {"title": 2.0, "content": 1.0}
    rows = spark.createDataFrame([(i, d["title"], d["content"]) for i, d in docs.items()], "doc_id long, title string, content string")
    asked = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    scores = retrieval.bm25(rows, asked, "doc_id", {f: F.col(f) for f in boosts}, boosts)
    got, want = {(r.query_id, r.doc_id): r.score for r in scores.collect()}, plain(docs, queries, boosts)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    steps = scores._jdf.queryExecution().executedPlan().toString()
    # Words are dealt by document once; scores are made there, without another exchange.
    assert "SortMergeJoin" not in steps and "hashpartitioning(query_id" not in steps and "LeftSemi" in steps
    assert retrieval.bm25(rows.limit(0), asked, "doc_id", {"title": F.col("title")}).count() == 0
    best = search.lexical_search(rows, "doc_id", {f: F.col(f) for f in boosts}, boosts)(asked, 5).collect()
    assert Counter(r.query_id for r in best) == {1: 5, 2: 5}


def test_found_rows_go_to_the_chunks(spark):
    found = spark.createDataFrame([(1, 5, 0.5, 1.0, 0.2, 1)], "query_id int, doc_id long, score double, bm25 double, dense double, rank int")
    chunks = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("c").alias("content"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = search.hydrated(found, chunks, "doc_id", 3)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
