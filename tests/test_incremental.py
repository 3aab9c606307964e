"""Interval ledgers against sets of positions."""

import random

import pytest

from tidelog.operators.incremental import IntervalLedger, merge_intervals, to_intervals, unprocessed

AVAILABLE, CONSUMERS = "master_id string, pos bigint, extra string", "master_id string, slave_id string, position bigint"


def covered(df):
    out = {}
    for r in df.collect():
        points = set(range(r.lo, r.hi + 1))
        held = out.setdefault((r.master_id, r.slave_id), set())
        assert not held & points
        held |= points
    return out


def test_intervals_cover_exactly_their_points(spark):
    r = random.Random(5)
    rows = [("m", "s%d" % r.randrange(3), r.randrange(-6000, 12000)) for _ in range(3000)]
    rows += rows[:100] + [("m", "s0", None)]
    got = covered(to_intervals(spark.createDataFrame(rows, "master_id string, slave_id string, pos bigint"), ["master_id", "slave_id"], bits=9))
    want = {}
    for m, s, p in rows:
        if p is not None:
            want.setdefault((m, s), set()).add(p)
    assert got == want


def test_merge_of_overlapping_touching_and_distant(spark):
    rows = [("m", "s", 0, 1, 5), ("m", "s", 0, 3, 4), ("m", "s", 0, 6, 8), ("m", "s", 0, 10, 12), ("m", "t", 0, 7, 7)]
    df = spark.createDataFrame(rows, "master_id string, slave_id string, block bigint, lo bigint, hi bigint")
    got = sorted((r.slave_id, r.lo, r.hi) for r in merge_intervals(df, ["master_id", "slave_id"]).collect())
    assert got == [("s", 1, 8), ("s", 10, 12), ("t", 7, 7)]


def brute(available, consumers, processed):
    out = set()
    for m, s, position in consumers:
        for am, p, _ in available:
            if am == m and p is not None and m is not None and (position is None or p > position) and (m, s, p) not in processed:
                out.add((m, s, p))
    return out


def test_gaps_late_commits_and_hot_master(spark):
    r = random.Random(6)
    available = [("hot" if r.random() < 0.6 else "m%d" % r.randrange(3), r.randrange(0, 9000), "x") for _ in range(2500)] + [("m1", None, "x"), (None, 4, "x")]
    consumers = [("hot", "a", 100), ("hot", "b", None), ("m0", "a", 8999), ("m1", "a", 50), ("gone", "a", None), (None, "n", None)]
    done = {(m, s, p) for m, s, _ in consumers for _, p, _ in available if m and p is not None and r.random() < 0.5}
    processed = to_intervals(spark.createDataFrame(list(done), "master_id string, slave_id string, pos bigint"), ["master_id", "slave_id"], bits=8)
    out = unprocessed(spark.createDataFrame(available, AVAILABLE), spark.createDataFrame(consumers, CONSUMERS), processed, bits=8, salts=4)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(available, consumers, done)


def test_empty_tables(spark):
    none = to_intervals(spark.createDataFrame([], "master_id string, slave_id string, pos bigint"), ["master_id", "slave_id"])
    assert none.count() == 0
    assert unprocessed(spark.createDataFrame([], AVAILABLE), spark.createDataFrame([("m", "s", None)], CONSUMERS), none).count() == 0


def test_ledger_skips_and_repeats_nothing(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger")
    consumers = spark.createDataFrame([("m", "a", None), ("m", "b", 2)], CONSUMERS)
    log = lambda *ps: spark.createDataFrame([("m", p, "") for p in ps], AVAILABLE)
    rows = lambda run: sorted((r.slave_id, r.pos) for r in ledger.output(run).collect())

    assert ledger.run(log(1, 2, 4), consumers) == 0
    assert rows(0) == [("a", 1), ("a", 2), ("a", 4), ("b", 4)]

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(log(1, 2, 4, 5), consumers, fails)
    assert ledger.last() == 0
    # 3 was committed late, below what has been processed.
    assert ledger.run(log(1, 2, 3, 4, 5), consumers) == 1
    assert rows(1) == [("a", 3), ("a", 5), ("b", 3), ("b", 5)]
    assert ledger.run(log(1, 2, 3, 4, 5), consumers) == 2
    assert rows(2) == []
    assert covered(ledger.intervals())["m", "a"] == {1, 2, 3, 4, 5}


def test_ledger_writes_only_touched_blocks_and_compacts(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger", compact_every=2)
    consumers = spark.createDataFrame([("m", "a", None)], CONSUMERS)
    seen = set()
    for run in range(6):
        ps = [run * 5000 + 1, run * 5000 + 2, 7000 + run]
        seen |= set(ps)
        assert ledger.run(spark.createDataFrame([("m", p, "") for p in ps], AVAILABLE), consumers) == run
        assert covered(ledger.intervals()) == {("m", "a"): seen}
    blocks = lambda run: {r.block for r in spark.read.parquet(f"{ledger.path}/runs/{ledger._commits()[run]['run']}/intervals").collect()}
    assert blocks(5) == {7005 >> 12, 25001 >> 12} and len(blocks(4)) > 3
    assert {r.pos for n in range(6) for r in ledger.output(n).collect()} == seen


def test_of_two_drivers_one_is_void_and_leftovers_go(spark, tmp_path):
    one, two = (IntervalLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    consumers = spark.createDataFrame([("m", "a", None)], CONSUMERS)
    log = spark.createDataFrame([("m", 1, ""), ("m", 2, "")], AVAILABLE)

    def meanwhile(df):
        two.run(log, consumers)
        return df

    with pytest.raises(RuntimeError, match="another driver"):
        one.run(log, consumers, meanwhile)
    assert sorted(r.pos for r in two.output(0).collect()) == [1, 2]
    assert one.run(log, consumers) == 1 and one.output(1).count() == 0
    assert one.vacuum() == 1 and sorted(r.pos for r in one.output(0).collect()) == [1, 2]


def test_positions_processed_elsewhere(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger")
    ledger.mark(spark.createDataFrame([("m", "a", 2), ("m", "a", None), (None, None, 3)], "master_id string, slave_id string, pos bigint"))
    ledger.run(spark.createDataFrame([("m", 1, ""), ("m", 2, "")], AVAILABLE), spark.createDataFrame([("m", "a", None)], CONSUMERS))
    assert [r.pos for r in ledger.output().collect()] == [1]
