"""Plans stay as they are meant: exchanges, pushed filters, columns read."""

import os
import re

import pytest

import __spark_entry__ as entry
from tidelog.operators.state import point_get

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan(df)))


@pytest.mark.parametrize(
    "name,most",
    [("p1_found", 1), ("p1_state", 1), ("p5_found", 2), ("kv_state_latest", 1), ("kv_point_get", 1), ("kv_shard_sizes", 2), ("kv_scan_from_lsn", 0), ("kv_record_bytes", 0), ("kv_history", 1)],
)
def test_number_of_shuffles(spark, name, most):
    assert exchanges(entry.queries()[name](spark, D)) <= most


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "y")], "lsn bigint, command int, key string, value string").write.parquet(path)
    text = plan(point_get(spark.read.parquet(path), "a"))
    assert "EqualTo(key,a)" in text


def test_lsn_bound_reaches_the_scan(spark):
    text = plan(entry.queries()["kv_scan_from_lsn"](spark, D))
    assert "GreaterThanOrEqual(event_id,9000)" in text and "props" not in text.split("ReadSchema")[1]


def test_only_needed_columns_are_read(spark):
    read = plan(entry.queries()["p1_found"](spark, D)).split("ReadSchema:")[1].split("\n")[0]
    assert all(c not in read for c in ("segment", "ordinal", "logged_at"))


def test_no_udf_in_plain_operators(spark):
    for name in ("p1_found", "p3_found", "p5_found", "kv_state_latest", "kv_shard_of_key", "kv_command_frame_hex", "kv_handshake_validate", "kv_batch_validate"):
        assert not re.search(r"Python|Pandas|Arrow", plan(entry.queries()[name](spark, D))), name
