"""Work along a global order against a plain walk."""

import random

import pytest

from tidelog.operators import batching, state
from tidelog.operators.ordered import Bytes, numbered, with_last, with_next


def walk_time(rows, size, wait):
    """rows: (writer, lsn, t) -> {(writer, lsn): batch}"""
    out, open_ = {}, {}
    for w, lsn, t in sorted(rows, key=lambda r: ((r[0] is not None, r[0]), r[1])):
        batch, held, first = open_.get(w, (-1, size, None))
        if held >= size or (t is not None and first is not None and t - first >= wait):
            batch, held, first = batch + 1, 0, t
        open_[w] = (batch, held + 1, first)
        out[w, lsn] = batch
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batches_over_block_borders(spark, seed):
    r = random.Random(seed)
    t, rows = 0, []
    for lsn in range(600):
        t += r.choice([0, 1, 3, 40]) - (30 if r.random() < 0.03 * (seed % 2) else 0)
        rows.append((r.choice(["hot", "hot", "hot", "a", None]) if seed > 1 else "hot", lsn * 3, None if r.random() < 0.02 * seed else t, "x"))
    size, wait = r.choice([3, 7, 40]), r.choice([10, 60, 10**6])
    df = spark.createDataFrame(rows, "w string, lsn bigint, at_ms bigint, batch string")
    got = {(x.w, x.lsn): x.batch_id for x in batching.batches_by_size_or_time(df, size, wait, scope=("w",), bits=5).collect()}
    assert got == walk_time([x[:3] for x in rows], size, wait)


@pytest.mark.parametrize("limit", [1, 10, 55, 10**6])
def test_segments_over_block_borders(spark, limit):
    r = random.Random(limit)
    rows = [(w, i, r.choice([0, 1, 5, 9, 80])) for w in ("a", "b") for i in range(r.choice([90, 300]))]
    df = spark.createDataFrame(rows, "w string, batch_id bigint, bytes bigint")
    want, held, segment, writer = {}, 0, 0, None
    for w, i, n in sorted(rows):
        if w != writer:
            writer, held, segment = w, 0, 0
        if held + n >= limit and held > 0:
            segment, held = segment + 1, 0
        held += n
        want[w, i] = segment
    assert {(x.w, x.batch_id): x.segment for x in batching.pack_segments(df, limit, ("w",), bits=4).collect()} == want


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "lsn bigint, at_ms bigint")
    assert batching.batches_by_size_or_time(none, 5, 5).count() == 0
    assert batching.batches_by_size_or_time(spark.createDataFrame([(7, None)], none.schema), 5, 5).first().batch_id == 0
    assert batching.pack_segments(spark.createDataFrame([], "batch_id bigint, bytes bigint"), 5).count() == 0
    assert state.lsn_gaps(none).count() == 0
    assert Bytes(10).entry(Bytes(10).head(__import__("numpy").array([50])), (0, 0)) == 2**62


def test_numbers_neighbours_and_carried_values(spark):
    r = random.Random(7)
    rows = [(r.choice(["hot", "hot", "k", None]), i, r.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, lsn bigint, v bigint").repartition(5)
    order = sorted(rows, key=lambda x: ((x[0] is not None, x[0] or ""), x[1]))
    assert [(x.key, x.lsn) for x in numbered(df, ["key", "lsn"], "n", 10).orderBy("n").collect()] == [x[:2] for x in order]
    got = {(x.key, x.lsn): x.next and tuple(x.next) for x in with_next(df, ["key", "lsn"], ["key", "lsn"], bits=4).collect()}
    assert got == {a[:2]: b and b[:2] for a, b in zip(order, [*order[1:], None])}
    last, want = None, {}
    for k, i, v in order:
        last = v if v is not None else last
        want[k, i] = last
    from pyspark.sql import functions as F

    assert {(x.key, x.lsn): x.last for x in with_last(df, ["key", "lsn"], F.col("v"), bits=4).collect()} == want


def test_no_task_gets_everything(spark):
    """Neither a hot key nor the whole log is one partition of an exchange."""
    df = spark.createDataFrame([("hot", i, 1, "v") for i in range(100)], "key string, lsn bigint, command int, value string")
    for out in (state.history(df), state.lsn_gaps(df), batching.batches_by_size_or_time(df.withColumn("at_ms", df.lsn), 5, 5)):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in text and "hashpartitioning(key" not in text
