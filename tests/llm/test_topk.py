"""Threshold counting against plain counting."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidelog.llm.topk import frequent_items, local_counts


def items(seed, n=4000):
    r = random.Random(seed)
    return [(r.choice([1, 3]), bytes([65 + min(int(r.expovariate(0.5)), 25)]) if r.random() < 0.5 else b"%d" % r.randrange(10**6), "x") for _ in range(n)]


def frame(spark, rows, parts=6):
    return spark.createDataFrame(rows, "command int, item binary, extra string").repartition(parts)


def test_top_k_and_threshold_are_exact_over_many_nodes(spark):
    rows = items(1)
    want = Counter((c, i) for c, i, _ in rows)
    df = frame(spark, rows)
    got = {(r.command, bytes(r.item)): r.n for r in frequent_items(df, ["command", "item"], k=10, node_items=50).collect()}
    kth = sorted(want.values(), reverse=True)[9]
    assert got == {k: n for k, n in want.items() if n >= kth}
    got = {(r.command, bytes(r.item)): r.n for r in frequent_items(df, ["command", "item"], at_least=40, node_items=50).collect()}
    assert got == {k: n for k, n in want.items() if n >= 40}
    got = {(r.command, bytes(r.item)): r.n for r in frequent_items(df, ["command", "item"], k=3, at_least=40).collect()}
    kth = max(40, sorted(want.values(), reverse=True)[2])
    assert got == {k: n for k, n in want.items() if n >= kth}


def test_nodes_are_bounded_and_lose_nothing(spark):
    rows = [(1, b"%d" % i, "") for i in range(500_000)] + [(1, b"7", "")] * 3
    local = local_counts(frame(spark, rows, 1), ["command", "item"], node_items=100_000)
    stats = local.groupBy("node").agg(F.count("*").alias("n")).collect()
    assert len(stats) > 1 and max(r.n for r in stats) <= 100_000 + 200_000
    assert local.agg(F.sum("n")).first()[0] == len(rows)


def test_item_that_is_spread_thin_is_found(spark):
    rows = [(1, b"thin", "")] * 60 + [(1, b"lump%d" % (i // 20), "") for i in range(1000)]
    random.Random(3).shuffle(rows)
    got = {bytes(r.item): r.n for r in frequent_items(frame(spark, rows, 12), ["item"], k=1).collect()}
    assert got == {b"thin": 60}


def test_null_ties_and_empty(spark):
    rows = [(1, None, ""), (1, None, ""), (1, b"", ""), (1, b"", ""), (1, b"a", "")]
    got = {r.item if r.item is None else bytes(r.item): r.n for r in frequent_items(frame(spark, rows), ["item"], k=1).collect()}
    assert got == {None: 2, b"": 2}
    assert frequent_items(frame(spark, []), ["item"], at_least=1).count() == 0


def test_both_ways_of_counting_agree_where_the_last_item_is_rare(spark):
    # The 30th item lies on two rows, like hundreds of others: nearly all local counts would be candidates.
    rows = [(1, b"often%d" % (i % 20), "") for i in range(800)] + [(1, b"rare%d" % (i // 2), "") for i in range(1000)] + [(1, b"once%d" % i, "") for i in range(500)]
    random.Random(5).shuffle(rows)
    got = {bytes(r.item): r.n for r in frequent_items(frame(spark, rows, 3), ["item"], k=30).collect()}
    assert got == {i: n for i, n in Counter(i for _, i, _ in rows).items() if n >= 2}


def test_long_items_are_not_broadcast(spark):
    long = [(1, b"x" * 200_000 + b"%d" % (i % 5), "") for i in range(40)]
    got = {bytes(r.item)[-1:]: r.n for r in frequent_items(frame(spark, long), ["item"], k=5).collect()}
    assert got == {b"%d" % i: 8 for i in range(5)}
