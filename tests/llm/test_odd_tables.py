"""Queries of this package on odd tables (null ids, extra columns whose names clash, repeated rows) and on empty ones."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")

from tidelog.llm import queries  # noqa: E402

ODD = {
    "wal_log": "SELECT *, 1 AS arg_pos, 'i' AS item, 2 AS n, 3 AS node, 4 AS place FROM {0} UNION ALL (SELECT *, 1, 'i', 2, 3, 4 FROM {0} LIMIT 300)",
    "documents": "SELECT *, 'a' AS item_id, 'b' AS subject, 'c' AS classes, [1] AS ids, 's' AS sentences FROM {0} UNION ALL (SELECT * REPLACE (NULL AS doc_id), 'a', 'b', 'c', [1], 's' FROM {0} LIMIT 5)",
    "eval_items": "SELECT *, 1 AS doc_id, 'x' AS words FROM {0} UNION ALL (SELECT *, 1, 'x' FROM {0} LIMIT 3) UNION ALL (SELECT * REPLACE (NULL AS item_id), 1, 'x' FROM {0} LIMIT 3)",
    "subjects": "SELECT *, 1 AS doc_id, 't' AS text FROM {0} UNION ALL (SELECT * REPLACE (NULL AS subject), 1, 't' FROM {0} LIMIT 1)",
    "subject_labels": "SELECT *, 't' AS text, [1] AS classes FROM {0} UNION ALL (SELECT * REPLACE (NULL AS doc_id), 't', [1] FROM {0} LIMIT 4) UNION ALL (SELECT * REPLACE (NULL AS annotator), 't', [1] FROM {0} LIMIT 4)",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    con = duckdb.connect()
    out = {kind: str(tmp_path_factory.mktemp(kind)) for kind in ("odd", "empty")}
    for t, odd in ODD.items():
        for kind, q in (("odd", odd), ("empty", "SELECT * FROM {0} LIMIT 0")):
            src = f"'{D}/{t}.parquet'"
            con.execute(f"COPY ({q.format(src)}) TO '{out[kind]}/{t}.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("kind", ["odd", "empty"])
@pytest.mark.parametrize("name", ["p4_found", "p4_top100", "p8_found", "p8_coverage"])
def test_against_sql(spark, tables, kind, name):
    con = duckdb.connect()
    for t in ODD:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables[kind]}/{t}.parquet')" + (" WHERE item_id IS NOT NULL" if t == "eval_items" else " WHERE doc_id IS NOT NULL" if t == "documents" else ""))
    df = queries.QUERIES[name](spark, tables[kind])
    cols = sorted(df.columns)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(map(plain, df.select(*cols).collect())) == Counter(map(plain, con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()))


def test_without_sql(spark, tables):
    assert queries.p7_ids(spark, tables["empty"]).count() == queries.p9_found(spark, tables["empty"]).count() == queries.p9_composition(spark, tables["empty"]).count() == 0
    ids = queries.p7_ids(spark, tables["odd"])
    plain = queries.p7_ids(spark, D)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == plain.count() + 5 and ids.where("ids IS NULL").count() == 0
    assert ids.where("doc_id IS NOT NULL").exceptAll(plain).count() == 0
    found = queries.p9_found(spark, tables["odd"])
    names = {r.subject for r in spark.read.parquet(f"{D}/subjects.parquet").collect()}
    assert found.columns == ["doc_id", "subject"] and {r.subject for r in found.collect()} <= names
