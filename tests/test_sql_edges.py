"""Rows on which queries once differed from their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from corpusflow import queries
from corpusflow.functions import text as X
from corpusflow.operators import quality
from test_oracles import DIR, TABLES, rows_of

needs_tables = pytest.mark.skipif(not TABLES, reason="no test tables here")


def both(spark, tmp_path, table, rows, names):
    """What each query and its SQL give over the smallest tables, one of them replaced."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        os.symlink(f"{DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.unlink(tmp_path / f"{table}.parquet")
    rows.write.parquet(str(tmp_path / f"{table}.parquet"))
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet{'/*.parquet' if t == table else ''}'")
    return [(rows_of(queries.QUERIES[n](spark, str(tmp_path)).toPandas()), rows_of(con.sql(queries.ORACLE_SQL[n]).df())) for n in names]


def documents(spark, texts):
    kinds = spark.read.parquet(f"{DIR}/documents.parquet").schema
    held = spark.createDataFrame(texts, "doc_id long, text string")
    return held.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in held.columns else F.lit("1").cast(f.dataType).alias(f.name) for f in kinds])


@needs_tables
def test_single_letters_beside_other_scripts(spark, tmp_path):
    texts = ["éA x", "Aé", "B", "ßc d", "ſd", "ıe .", "nothing", "x_a", "éa-b", ""]
    rows = documents(spark, [(5 * i + 1, t) for i, t in enumerate(texts)])
    for got, want in both(spark, tmp_path, "documents", rows, ["math_answers"]):
        assert got == want
    out = spark.createDataFrame([("éA B",), ("ßc d",)], "t string").select(X.choice(F.col("t"))).collect()
    assert [r[0] for r in out] == ["B", "D"]


@needs_tables
def test_long_reasoning_rows_by_sql(spark, tmp_path):
    rows = documents(spark, [(1, "word " * 30_000), (3, "short text"), (16, "x" * 199_000), (11, "w " * 120_000)])
    for got, want in both(spark, tmp_path, "documents", rows, ["preparation_counters", "reasoning_documents", "reasoning_gate", "verification_route"]):
        assert got == want
    row = spark.createDataFrame([("src-1", "p" * 200_001, "<think>a</think><answer>b</answer>")], "s string, p string, r string")
    gate = lambda **k: row.select(quality.reasoning_rejection(F.col("s"), F.col("p"), F.col("r"), F.lit("stop"), ["src-1"], **k)).first()[0]
    assert gate() == "too_long" and gate(longest=None) is None
