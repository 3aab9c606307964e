"""Eager aggregation against the join itself."""

import random

from pyspark.sql import functions as F

from tidelog.operators.eager import eager_join_aggregate, key_states, roll_up


def test_eager_equals_the_join(spark):
    r = random.Random(9)
    rows = lambda n: [("hot" if r.random() < 0.4 else r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.choice([1, 2, None]), "e") for _ in range(n)]
    l, rr = rows(300), rows(200)
    schema = "k string, g string, v int, extra string"
    out = eager_join_aggregate(
        spark.createDataFrame(l, schema), spark.createDataFrame(rr, schema), ["k"], ["g"],
        {"ls": F.col("v")}, {"rs": F.col("v")}, {"lm": F.col("v")},
    )
    want = {}
    for lk, lg, lv, _ in l:
        for rk, _, rv, _ in rr:
            if lk == rk:
                w = want.setdefault(lg, [0, 0, 0, None])
                w[0] += 1
                w[1] += lv or 0
                w[2] += rv or 0
                w[3] = max(x for x in (w[3], lv, -1) if x is not None)
    assert {r.g: [r.n, r.ls, r.rs, r.lm] for r in out.collect()} == want


def test_eager_by_the_join_key_itself_and_empty(spark):
    schema = "k string, v int"
    some, none = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), spark.createDataFrame([], schema)
    assert {(r.k, r.n) for r in eager_join_aggregate(some, some, ["k"], ["k"]).collect()} == {("a", 4), ("b", 1)}
    assert eager_join_aggregate(some, none, ["k"], ["k"]).count() == 0


def test_counts_beyond_64_bits(spark):
    schema = "k string, __n bigint, __s_v bigint"
    states = spark.createDataFrame([("hot", 3_100_000_000_000, 2**62), ("cold", 2, 5)], schema)
    out = {r.k: r for r in roll_up(states, states.withColumnRenamed("__s_v", "__s_w"), ["k"], ["k"], ["v"], ["w"]).collect()}
    assert out["hot"].n == 3_100_000_000_000**2 and out["hot"].v == 2**62 * 3_100_000_000_000 == out["hot"].w
    assert (out["cold"].n, out["cold"].v, out["cold"].w) == (4, 10, 10)
    huge = spark.createDataFrame([("k", 2**63 - 1, 1)] * 3, schema)
    assert roll_up(huge, huge, ["k"], ["k"]).first().n is None


def test_states_of_great_values_and_floats(spark):
    df = spark.createDataFrame([("a", 2**63 - 1, 0.5), ("a", 2**63 - 1, 0.25), (None, None, None)], "k string, v bigint, f double")
    s = {r.k: r for r in key_states(df, ["k"], {"v": F.col("v"), "f": F.col("f")}).collect()}
    assert s["a"]["__s_v"] == 2 * (2**63 - 1) and s["a"]["__s_f"] == 0.75 and s[None]["__s_v"] is None
    out = {r.k: r for r in eager_join_aggregate(df, df, ["k"], ["k"], {"f": F.col("f")}, {"g": F.col("f")}).collect()}
    assert (out["a"].n, out["a"].f, out["a"].g) == (4, 1.5, 1.5) and (out[None].n, out[None].f) == (1, None)


def test_without_null_keys_the_join_needs_no_exchange(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int")
    out = eager_join_aggregate(df, df, ["k"], ["k"], null_keys=False)
    assert [(r.k, r.n) for r in out.collect()] == [("a", 4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = eager_join_aggregate(df, df, ["k"], ["k"], null_keys=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
