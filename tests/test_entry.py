"""Queries against their SQL on the smallest tables; the contract of the entry module."""

import glob
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")

import __spark_entry__ as entry  # noqa: E402
from tidelog.plans import catalogue, problems  # noqa: E402


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*problems.SQL, *catalogue.SQL])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.select(*cols).collect()]
    assert Counter(got) == Counter(tuple(map(plain, r)) for r in want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert not any(line.startswith(("from tidelog.llm", "import tidelog.llm")) for p in glob.glob("tidelog/**/*.py", recursive=True) if "/llm/" not in p for line in open(p))
