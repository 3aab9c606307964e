"""Queries on odd tables (a null master, extra columns whose names clash, repeated rows) and on empty ones, against their SQL."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")

from tidelog.plans import catalogue, problems  # noqa: E402

KEYED = ("wal_log", "replica_log", "repl_batches", "sync_messages")
OTHER = ("events", "orders", "customer", "supplier", "nation")
CLASH = "7 AS pos, 'x' AS key, 'y' AS value, true AS dead, 3 AS side, 9 AS block, 'z' AS slave, 1 AS lo, 2 AS n, 'k' AS bucket, true AS accepted, 'e' AS error"
QUERIES = {**problems.QUERIES, **catalogue.QUERIES}
SQL = {**problems.SQL, **catalogue.SQL}
# Left out: kv_replica_ids, whose SQL takes msg_id for unique, and what names a replica by ``master || '/' || slave``, which is null for a null master.
NAMES = ("batch_validate", "handshake_validate", "handshake_reply", "replica_apply", "record_validate", "oversize", "next_lsn", "last_segment", "gaps", "file_order", "verdict")
ODD = [*problems.SQL, *(n for n in catalogue.SQL if any(w in n for w in NAMES))]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    con = duckdb.connect()
    one = con.execute(f"SELECT master_id FROM '{D}/replica_log.parquet' WHERE master_id IS NOT NULL GROUP BY 1 ORDER BY count(*) LIMIT 1").fetchall()[0][0]
    out = {kind: str(tmp_path_factory.mktemp(kind)) for kind in ("odd", "empty")}
    for t in (*KEYED, *OTHER):
        src = f"'{D}/{t}.parquet'"
        odd = f"SELECT * FROM {src}"
        if t in KEYED:
            odd = f"SELECT * REPLACE (nullif(master_id, '{one}') AS master_id), {CLASH} FROM {src}"
            if t != "repl_batches":
                odd = f"{odd} UNION ALL (SELECT * FROM ({odd}) LIMIT 50)"
        for kind, q in (("odd", odd), ("empty", f"SELECT * FROM {src} LIMIT 0")):
            con.execute(f"COPY ({q}) TO '{out[kind]}/{t}.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("kind,name", [*(("odd", n) for n in ODD), *(("empty", n) for n in SQL)])
def test_odd_and_empty_tables(spark, tables, kind, name):
    con = duckdb.connect()
    for t in (*KEYED, *OTHER):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables[kind]}/{t}.parquet')")
    df = QUERIES[name](spark, tables[kind])
    cols = sorted(df.columns)
    plain = lambda r: tuple(bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v for v in r)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert Counter(map(plain, df.select(*cols).collect())) == Counter(map(plain, want))
