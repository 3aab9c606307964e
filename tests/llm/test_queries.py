"""Queries of this package against their SQL on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")

from tidelog.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(map(plain, want)) == Counter(map(plain, df.select(*cols).collect()))
