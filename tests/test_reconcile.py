"""compare_copies against a full comparison; the table's own parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators.reconcile import build_tables, compare_copies, differing_keys, peel

SCHEMA = "m string, pos bigint, command int, key binary, value binary, extra int"


def brute(left, right):
    pick = lambda rows: {k: max((r[2:5] for r in rows if r[:2] == k), key=lambda t: tuple((x is not None, x) for x in t)) for k in {r[:2] for r in rows}}
    l, r = pick(left), pick(right)
    out = {(*k, "only_l") for k in l.keys() - r.keys()} | {(*k, "only_r") for k in r.keys() - l.keys()}
    for k in l.keys() & r.keys():
        out |= {(*k, f) for f, a, b in zip(("command", "key", "value"), l[k], r[k]) if a != b}
    return out


def copies(seed, n, lost):
    r = random.Random(seed)
    left = [("m%d" % r.randrange(3), i - 20, r.choice([1, 3]), b"k%d" % r.randrange(50), r.choice([None, b"v%d" % i]), i) for i in range(n)]
    right = []
    for row in left:
        if r.random() < lost:
            kind = r.randrange(5)
            if kind == 0:
                continue
            row = list(row)
            row[2 + kind % 3] = {0: 3 if row[2] == 1 else 1, 1: b"other", 2: None if row[4] else b"new"}[kind % 3]
            row = tuple(row)
        right += [(*row[:5], -1)] * r.choice([1, 1, 2])
    right += [("m9", i, 1, b"foreign", b"v", 0) for i in range(int(n * lost))]
    r.shuffle(right)
    return left + left[:30], right


def run(spark, left, right, **kw):
    dfs = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    out = compare_copies(*dfs, "m", "pos", ["command", "key", "value"], "only_l", "only_r", **kw).collect()
    got = {(r.m, r.pos, r["diff"]) for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("lost", [0.0, 0.02, 0.7])
def test_differences(spark, lost):
    left, right = copies(11, 800, lost)
    assert run(spark, left, right, bucket_rows=200) == brute(left, right)


def test_bucket_that_does_not_peel_is_compared_directly(spark):
    left, right = copies(12, 400, 0.6)
    assert run(spark, left, right, bucket_rows=400, cells_per_difference=0.2) == brute(left, right)


def test_empty_sides(spark):
    left, _ = copies(13, 50, 0)
    assert run(spark, [], []) == set()
    assert run(spark, left, []) == brute(left, [])
    assert run(spark, [], left) == brute([], left)


def test_two_rows_under_one_name_are_one(spark):
    left = [("m", 1, 1, b"a", b"x", 0), ("m", 1, 1, b"b", b"x", 0)]
    assert run(spark, left, left[1:]) == set()
    assert run(spark, left, left[:1]) == {("m", 1, "key")}


def test_tables_are_exchanged_not_rows(spark):
    rows = [("m%d" % (i % 2), i, 1, b"k%d" % i, b"v", 0) for i in range(20_000)]
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([r for r in rows if r[1] % 1000], SCHEMA)
    elements = [d.select(F.lit(s).alias("side"), F.xxhash64("m").alias("kid"), "pos", F.xxhash64("key", "value").alias("rowhash")) for s, d in ((1, left), (-1, right))]
    out = differing_keys(elements[0].unionByName(elements[1]), bucket_rows=2000)
    assert sorted(r.pos for r in out.collect()) == list(range(0, 20_000, 1000))
    one = elements[0].unionByName(elements[1]).toPandas()
    batch = build_tables(one["side"].to_numpy(float), *(one[c].to_numpy() for c in ("kid", "pos", "rowhash")), 10, 50)
    # Rows that both sides have cancel out where they are met together: three cells for each of the 20 differences stay.
    assert sum(len(x) for x in batch.column(2).to_pylist()) <= 60


def test_repeats_that_differ_in_number(spark):
    left, right = copies(21, 300, 0.05)
    many = left * 2 + left[:50] * 3
    assert run(spark, many, right + right[::3], bucket_rows=100) == brute(many, right)


def test_sparse_and_extreme_positions(spark):
    r = random.Random(3)
    left = [("m%d" % r.randrange(3), r.choice([-(2**63), 2**63 - 1, 0, r.randrange(-(2**62), 2**62)]), 1, b"k", b"v", 0) for _ in range(200)]
    left = list({x[:2]: x for x in left}.values())
    right = [x for i, x in enumerate(left) if i % 9] + [(None, 5, 1, b"k", b"v", 0), ("m1", None, 1, b"k", b"v", 0)]
    assert run(spark, left, right) == brute(left, right[:-1])


def test_peeling():
    r = np.random.default_rng(1)
    for size in (0, 1, 30, 300):
        at, row = r.integers(0, 4096, size), r.integers(-(2**63), 2**63 - 1, size)
        side = r.choice([1.0, -1.0], size)
        kid = np.zeros(size, np.int64)
        if not size:
            continue
        batch = build_tables(side, kid, at.astype(np.int64), row, 12, 220)
        n, sums = np.zeros(660, np.int64), np.zeros((4, 660), np.uint64)
        for times in (1, 2):
            for name, i in (("at", 0), ("high", 1), ("low", 2), ("check", 3)):
                sums[i, batch.column("cell").to_pylist()[0]] = (np.array(batch.column(name).to_pylist()[0], np.int64) * times).view(np.uint64) & np.uint64(0xFFFFFFFF)
            n[batch.column("cell").to_pylist()[0]] = np.array(batch.column("n").to_pylist()[0]) * times
            got, whole = peel(n, sums, 220)
            assert whole and set(got.tolist()) == set(at.tolist())
