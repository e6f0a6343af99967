"""Every query of the library with a DuckDB twin gives its rows at the smallest size."""

import math
import os

import pytest

from corpusflow import queries

DIR = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(DIR)) if f.endswith(".parquet")] if os.path.isdir(DIR) else []


def rows_of(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return list(df.columns), sorted(tuple(map(str, map(plain, r))) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.skipif(not TABLES, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = rows_of(queries.QUERIES[name](spark, DIR).toPandas()), rows_of(con.sql(queries.ORACLE_SQL[name]).df())
    number = lambda x: [[f"{float(c):.6g}" if c.replace(".", "", 1).replace("-", "", 1).isdigit() else c for c in r] for r in x]
    assert got[0] == want[0] and number(got[1]) == number(want[1])
