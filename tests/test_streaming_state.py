"""stream == batch == sequential replay, for logs that arrive in any order, in pieces, and more than once."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.state import fold
from tidelog.schema import SET
from tidelog.streaming.ship import MESSAGE, Receiver, received, ship
from tidelog.streaming.commit import GroupCommit
from tidelog.streaming.state import ROCKSDB, Replica, changes_as_they_come, latest_changes, run_once

LOG = "lsn bigint, command int, key string, value string"


def random_log(seed, n=120):
    r = random.Random(seed)
    rows = [(i, c := r.choice([1, 1, 3]), "k%d" % r.randrange(9), "v%d" % i if c == 1 else None) for i in range(n)]
    arriving = rows + r.choices(rows, k=30)
    r.shuffle(arriving)
    return rows, arriving


def replay(rows):
    out = {}
    for lsn, c, k, v in sorted(rows):
        out[k] = (v, lsn) if c == 1 else None
    return {k: v for k, v in out.items() if v}


def values(df):
    got = [(r.key, (r.value, r.lsn)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_native_state(spark, tmp_path, seed):
    rows, arriving = random_log(seed)
    folder = f"file://{tmp_path}/log"
    for i in range(3):
        arrive(spark, folder, arriving[i::3])
    out = run_once(latest_changes(stream(spark, folder)), f"file://{tmp_path}/cp", "complete")
    assert values(out.where(F.col("command") == SET)) == replay(rows) == values(fold(spark.createDataFrame(arriving, LOG)))


def test_stateful_processor(spark, tmp_path):
    rows, arriving = random_log(3)
    folder = f"file://{tmp_path}/log"
    for i in range(3):
        arrive(spark, folder, arriving[i::3])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = run_once(changes_as_they_come(stream(spark, folder)), f"file://{tmp_path}/cp", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert values(fold(out)) == replay(rows)


def test_replica_resumes(spark, tmp_path):
    rows, arriving = random_log(4)
    folder = f"file://{tmp_path}/log"
    replica = Replica(spark, f"file://{tmp_path}/replica", compact_every=2)
    assert replica.state().count() == 0
    for i in range(7):
        arrive(spark, folder, arriving[i::7])
        replica.follow(stream(spark, folder))
    assert values(replica.state()) == replay(rows) == values(Replica(spark, replica.path).state())
    last = replica._made("epoch")[-1]
    # What an epoch before the last base had written is gone; a repeated epoch changes nothing.
    assert len(replica._made("base")) == 2 and len(replica._made("epoch")) < 5
    replica._apply(spark.createDataFrame(arriving[last::7], LOG), last)
    assert values(replica.state()) == replay(rows)


def test_shipping_end_to_end(spark, tmp_path):
    rows, arriving = random_log(5)
    odd = [(1000, 1, "bytes", "\x00\n é")]
    log, inbox, at = (f"file://{tmp_path}/{n}" for n in ("log", "inbox", "replica"))
    receiver = Receiver(spark, inbox, at)
    for part in (arriving[:70], arriving[70:] + odd):
        arrive(spark, log, part)
        ship(stream(spark, log), inbox, f"file://{tmp_path}/cp", size=7)
        receiver.follow()
    want = {k.encode(): (v.encode(), n) for k, (v, n) in replay(rows + odd).items()}
    assert {bytes(k): (bytes(v), n) for k, (v, n) in values(receiver.state()).items()} == want
    sizes = [r.n for r in received(spark.read.schema(MESSAGE).parquet(f"{inbox}/epoch=*")).groupBy("batch_id").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 7


def test_shipping_starts_after_a_position(spark, tmp_path):
    log, inbox = f"file://{tmp_path}/log", f"file://{tmp_path}/inbox"
    arrive(spark, log, [(i, 1, "k", "v") for i in range(20)])
    ship(stream(spark, log), inbox, f"file://{tmp_path}/cp", last_lsn=14)
    assert sorted(r.lsn for r in received(spark.read.schema(MESSAGE).parquet(f"{inbox}/epoch=*")).collect()) == [15, 16, 17, 18, 19]


def test_refused_messages_do_not_become_gaps(spark, tmp_path):
    good = '{"total":1,"events":[{"lsn":1,"cmdid":1,"args":["aw==","dg=="]}]}'
    bad = ['{"total":0,"events":[]}', "nonsense", '{"total":1,"events":[{"lsn":2,"cmdid":-1,"args":["aw=="]}]}', None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate([good, *bad])], MESSAGE)
    got = {r.batch_id: (r.error, r.lsn) for r in received(df).collect()}
    assert got == {0: (None, 1), 1: ("invalid total", None), 2: ("invalid message", None), 3: ("invalid command id", None), 4: ("invalid message", None)}
    inbox = f"file://{tmp_path}/inbox"
    df.coalesce(1).write.parquet(f"{inbox}/epoch=0")
    with pytest.raises(Exception, match="refused message|STREAM_FAILED"):
        Receiver(spark, inbox, f"file://{tmp_path}/a").follow()
    assert [bytes(r.key) for r in Receiver(spark, inbox, f"file://{tmp_path}/b", skip_bad=True).follow().state().collect()] == [b"k"]


def test_group_commit_over_epochs_and_a_repeat(spark, tmp_path):
    schema = "seq bigint, command string, key string, value string"
    folder, at = f"file://{tmp_path}/in", f"file://{tmp_path}/commit"
    commit = GroupCommit(spark, at, size=3)
    assert commit.told().count() == 0 and commit.refused().count() == 0
    parts = [[(i, "SET", f"k{i % 2}", "v") for i in range(7)] + [(7, "SET", "", "v"), (8, "GET", "k1", None)], [(10, "DEL", "k0", None), (11, "NOPE", "k", None)], [(20, "GET", "k1", None)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        commit.follow(spark.readStream.schema(schema).parquet(folder))
    want = [(0, 0, 0, "k0", 2), (1, 1, 0, "k1", 1), (2, 2, 0, "k0", 2), (3, 3, 1, "k1", 2), (4, 4, 1, "k0", 1), (5, 5, 1, "k1", 2), (6, 6, 2, "k0", 1), (10, 7, 3, "k0", 1)]
    told = lambda: sorted((r.seq, r.lsn, r.batch_id, bytes(r.key).decode(), r.n) for r in commit.told().collect())
    assert told() == want
    assert sorted(map(tuple, commit.refused().collect())) == [(7, "key cannot be empty"), (11, "unknown command")]
    # As after a failure between the table and the end of the epoch.
    commit._commit(spark.createDataFrame(parts[1], schema), 1)
    assert told() == want
    assert sorted(int(r.lsn) for r in spark.read.format("wal").load(f"{at}/log").select("lsn").distinct().collect()) == list(range(8))
