"""Fold, lookups, batching, layout and replication helpers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import config, retry
from tidelog.client import Client
from tidelog.config import ClientConfig, Config
from tidelog.errors import Cancelled, ConnectionFailed, InvalidArgument, KeyNotFound, NetworkFailed, ReadOnly, ServerError
from tidelog.functions import layout
from tidelog.functions.records import batch_error, handshakes
from tidelog.functions.u64 import from_pos, pos_to_bigint, to_pos
from tidelog.operators import batching, replication, state
from tidelog.sources import codec
from tidelog.table import COMMANDS, KvTable

LOG = "lsn bigint, command int, key string, value string"


def random_log(seed, n=300):
    r = random.Random(seed)
    rows = [(i * 2, r.choice([1, 1, 3]), "k%d" % r.randrange(12), "v%d" % i) for i in range(n)]
    rows = [(a, c, k, v if c == 1 else None) for a, c, k, v in rows]
    r.shuffle(rows)
    return rows


def replay(rows):
    out = {}
    for lsn, c, k, v in sorted(rows):
        if c == 1:
            out[k] = v
        else:
            out.pop(k, None)
    return out


def test_fold_and_its_relatives(spark):
    rows = random_log(1)
    df = spark.createDataFrame(rows + rows[:50], LOG)
    values = lambda d: {r.key: r.value for r in d.collect()}
    assert values(state.fold(df)) == replay(rows)
    assert values(state.as_of(df, 200)) == replay([r for r in rows if r[0] <= 200])
    wanted = spark.createDataFrame([("k1",), ("k1",), ("nope",), (None,)], "key string")
    got = {r.key: (r.found, r.value) for r in state.multi_get(df, wanted).collect()}
    assert got == {"k1": ("k1" in replay(rows), replay(rows).get("k1")), "nope": (False, None), None: (False, None)}
    assert state.fold(spark.createDataFrame([], LOG)).count() == 0


def test_history_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (5, 1, "a", "y"), (70_000, 3, "a", None), (9, 1, "b", "z")], LOG)
    assert sorted((r.key, r.since, r.until) for r in state.history(df).collect()) == [("a", 1, 5), ("a", 5, 70_000), ("b", 9, None)]
    assert sorted(map(tuple, state.lsn_gaps(df).collect())) == [(1, 5, 3), (5, 9, 3), (9, 70_000, 69_990)]


def test_lsns_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "seq bigint, x string").repartition(5)
    got = sorted((r.seq, r.lsn) for r in state.assign_lsn(df, 41).collect())
    assert got == [(i, 42 + i) for i in range(101)]


def test_batches_counts_and_segments(spark):
    r = random.Random(4)
    rows = [(i, "k%d" % r.randrange(5), i * r.choice([1, 1, 1, 5]) + i * 10) for i in range(1, 250)]
    df = spark.createDataFrame(rows, "lsn bigint, key string, at_ms bigint").repartition(4)
    ids = {x.lsn: x.batch_id for x in batching.batches_by_size(df, 7).collect()}
    assert ids == {i: (i - 1) // 7 for i in range(1, 250)}
    want, batch, held, first = {}, -1, 99, 0
    for lsn, _, t in rows:
        if held >= 9 or t - first >= 60:
            batch, held, first = batch + 1, 0, t
        held += 1
        want[lsn] = batch
    assert {x.lsn: x.batch_id for x in batching.batches_by_size_or_time(df, 9, 60).collect()} == want
    sizes = [r.randrange(1, 60) for _ in range(80)]
    packed = batching.pack_segments(spark.createDataFrame(list(enumerate(sizes)), "batch_id bigint, bytes bigint"), 100).collect()
    segment, held, want = 0, 0, {}
    for i, n in enumerate(sizes):
        if held and held + n >= 100:
            segment, held = segment + 1, 0
        held += n
        want[i] = segment
    assert {p.batch_id: p.segment for p in packed} == want


def test_segment_lookup(spark):
    m = spark.createDataFrame([("a", 100), ("b", 200), ("c", 500_000)], "segment string, lsn_start bigint")
    asked = [5, 100, 199, 200, 70_000, 499_999, 500_000, 10**9]
    got = {r.lsn: r.segment for r in batching.segment_for(m, spark.createDataFrame([(x,) for x in asked], "lsn bigint")).collect()}
    assert got == dict(zip(asked, "aaabbbcc"))


def test_layout_expressions_equal_the_codec(spark):
    rows = [(n, c, k, v) for n in (0, 1, 127, 128, 16383, 16384, 2**62) for c, k, v in ((1, b"k" * 200, b"v" * 300), (3, b"\xff\x00", None))]
    df = spark.createDataFrame(rows, "lsn bigint, command int, key binary, value binary")
    args = F.when(F.col("command") == 1, F.array("key", "value")).otherwise(F.array("key"))
    name = F.when(F.col("command") == 1, "SET").otherwise("DEL")
    out = df.select("*", layout.record_length(F.col("lsn"), F.col("command"), args).alias("n"), layout.command_frame(name, F.col("key"), F.col("value")).alias("f"))
    for r in out.collect():
        a = [bytes(r.key)] + ([bytes(r.value)] if r.command == 1 else [])
        assert r.n == len(codec.encode_record(r.lsn, r.command, a))
        assert bytes(r.f) == codec.encode_command("SET" if r.command == 1 else "DEL", *a)


def test_frame_that_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([(b"k" * 65536,)], "k binary").select(layout.command_frame(F.lit("GET"), F.col("k"), F.lit(None).cast("binary")).alias("f"))
    with pytest.raises(Exception, match="key too long"):
        df.collect()
    assert spark.range(1).select(layout.command_frame(F.lit("GET"), F.lit(None).cast("binary"), F.lit(b"")).alias("f")).first().f is None


def test_fnv(spark):
    # Published FNV-1a vectors.
    vectors = {b"": 0x811C9DC5, b"a": 0xE40C292C, b"foobar": 0xBF9CF968}
    df = spark.createDataFrame([(k,) for k in [*vectors, None]], "k binary").select("k", layout.fnv1a(F.col("k")).alias("h"))
    assert {None if r.k is None else bytes(r.k): r.h for r in df.collect()} == {**vectors, None: None}


def test_unsigned_positions_keep_their_order(spark):
    from decimal import Decimal

    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(Decimal(v),) for v in [*values, 2**64, -1]] + [(None,)], "u decimal(21,0)")
    rows = df.select("u", to_pos(F.col("u")).alias("p"), from_pos(to_pos(F.col("u"))).alias("back"), pos_to_bigint(to_pos(F.col("u"))).alias("b")).collect()
    good = [r for r in rows if r.u is not None and 0 <= r.u < 2**64]
    assert [r.p for r in sorted(good, key=lambda r: r.u)] == sorted(r.p for r in good)
    assert all(r.back == r.u and r.b == (int(r.u) if r.u < 2**63 else None) for r in good)
    assert all(r.p is None for r in rows if r not in good)


def test_batch_rules_and_envelopes(spark):
    ev = lambda lsn, cmd=1, args=("k", "v"): (lsn, cmd, list(args))
    rows = [(0, 0, [ev(1)]), (1, 1, []), (2, 1, None), (3, 1, [ev(1), ev(2)]), (4, 2, [ev(1, args=())]), (5, 2, [ev(1, -1)]), (6, 5, [ev(1), ev(2)]), (7, None, [ev(1)]), (8, 1, [ev(1, None)])]
    df = spark.createDataFrame(rows, "batch_id bigint, total int, events array<struct<lsn:bigint,cmdid:int,args:array<string>>>")
    got = {r.batch_id: r.e for r in df.select("batch_id", batch_error(F.col("total"), F.col("events")).alias("e")).collect()}
    assert got == {
        0: "invalid total", 1: "no events", 2: "no events", 3: "more events than total", 4: "event without arguments",
        5: "invalid command id", 6: None, 7: "invalid total", 8: "invalid command id",
    }
    back = replication.events_of(replication.batch_from_json(replication.batch_json(df)))
    assert sorted((r.batch_id, int(r.lsn)) for r in back.collect()) == [(6, 1), (6, 2)]


def test_handshakes(spark):
    ok = '{"type":"lsn_sync","last_lsn":5,"slave_id":"a"}'
    cases = [
        (ok, "OK", True), (ok, '{"status":"OK"}', True), (ok, '{"status":"no"}', False), (ok, "ERROR: x", False), (ok, None, False), (ok, '["OK"]', False),
        (ok + " x", "OK", False), (ok + "{}", "OK", False), (ok[:-1], "OK", False), ("[" + ok + "]", "OK", False), ("", "OK", False), (None, "OK", False),
        (ok.replace("5", '"5"'), "OK", False), (ok.replace("5", "5.0"), "OK", False), (ok.replace("5", "5e0"), "OK", False), (ok.replace("5", "-5"), "OK", False),
        (ok.replace("5", "null"), "OK", False), (ok.replace('"last_lsn":5,', ""), "OK", False), (ok.replace('"a"', '""'), "OK", False), (ok.replace('"a"', "7"), "OK", False),
        (ok.replace("5", str(2**64 - 1)), "OK", True), (ok.replace("5", str(2**64)), "OK", False), (ok.replace("lsn_sync", "LSN_SYNC"), "OK", False),
        ('{ "x": {"last_lsn": 9},\n"slave_id": "a", "last_lsn": 5, "type": "lsn_sync" }', "OK", True), (ok + "],[", "OK", False), (ok + "},{", "OK", False),
    ]
    df = spark.createDataFrame([(i, "m", m, r) for i, (m, r, _) in enumerate(cases)], "msg_id int, master_id string, message string, reply string")
    rows = {r.msg_id: r for r in handshakes(df).collect()}
    assert [rows[i].accepted for i in range(len(cases))] == [c[2] for c in cases]
    assert rows[20].pos is None and rows[0].pos == 5 - 2**63


def test_positions(spark):
    pos = spark.createDataFrame([("a", 100), ("b", 200), ("c", 100), ("d", None)], "replica string, last_lsn bigint")
    ev = lambda *ls: [(x,) for x in ls]
    sent = spark.createDataFrame([("a", 1, ev(150, 160), True), ("b", 1, ev(150), True), ("c", 1, ev(150), False), ("d", 1, ev(), True)], "replica string, batch_id bigint, events array<struct<lsn:bigint>>, ok boolean")
    assert {r.replica: r.last_lsn for r in replication.advance_positions(pos, sent).collect()} == {"a": 160, "b": 200, "c": 100, "d": None}
    assert int(replication.min_replica_lsn(pos).first().min_lsn) == 100
    assert int(replication.min_replica_lsn(pos.limit(0)).first().min_lsn) == 2**64 - 1
    regs = spark.createDataFrame([("a", 1, False, 1), ("a", 9, False, 2), ("b", 1, False, 1), ("b", None, True, 2)], "replica string, last_lsn bigint, removed boolean, at bigint")
    assert [tuple(r) for r in replication.registry(regs).collect()] == [("a", 9)]


def test_table(spark, tmp_path):
    t = KvTable(spark, f"file://{tmp_path}/t")
    assert t.last_lsn() is None and t.ping()
    with pytest.raises(KeyNotFound):
        t.get(b"k")
    t.set(b"k", b"\xff not found ")
    assert t.get(b"k") == b"\xff not found "
    t.delete(b"gone")
    bad = t.apply(spark.createDataFrame([(2, "DEL", b"k", None), (1, "SET", b"k", b"w"), (3, "SET", b"j", b"x"), (4, "SET", b"", b"x"), (5, "FOO", b"k", None)], COMMANDS))
    assert sorted(r.error for r in bad.collect()) == ["key cannot be empty", "unknown command"]
    got = {bytes(r.key): r.found for r in t.get_many(spark.createDataFrame([(b"k",), (b"j",)], "key binary")).collect()}
    assert got == {b"k": False, b"j": True} and t.last_lsn() == 4
    c = t.compact(f"file://{tmp_path}/c")
    assert [bytes(r.key) for r in c.state().collect()] == [b"j"] and c.last_lsn() == t.last_lsn()
    for call, error in ((lambda: t.set(b"", b"v"), InvalidArgument), (lambda: t.set(b"k", b""), InvalidArgument)):
        with pytest.raises(error):
            call()
    with pytest.raises(ReadOnly):
        KvTable(spark, t.path, Config(read_only=True)).set(b"k", b"v")
    assert KvTable(spark, t.path, Config(read_only=True)).get(b"j") == b"x"


def test_backoff_and_retry():
    plain = retry.Backoff(jitter=False, cap_ms=0)
    assert [plain.delay_ms(n) for n in range(4)] == [100, 200, 400, 800]
    assert retry.Backoff(jitter=False, cap_ms=500).delay_ms(3) == 500
    assert retry.Backoff(attempts=0).delay_ms(1) == 0
    assert all(150 <= retry.Backoff().delay_ms(1) <= 250 for _ in range(50))
    kinds = [ConnectionFailed(), NetworkFailed(), ServerError(), KeyNotFound("k"), InvalidArgument(), Cancelled(), RuntimeError()]
    assert [retry.retryable(e) for e in kinds] == [True, True, False, False, False, False, True]
    calls, slept = [], []

    def third():
        calls.append(1)
        if len(calls) < 3:
            raise NetworkFailed()
        return "done"

    assert retry.retry(third, retry.Backoff(jitter=False), slept.append) == "done" and slept == [0.1, 0.2]
    with pytest.raises(ServerError):
        retry.retry(lambda: (_ for _ in ()).throw(ServerError()), sleep=slept.append)


SERVER = """
engine: {type: "in_memory"}
network: {ip: "127.0.0.1", port: 3224, max_connections: 100, max_message_size: 4096, idle_timeout: 300, graceful_shutdown_timeout: 5}
logging: {level: "info", output: "stdout"}
wal: {flush_batch_size: 100, flush_batch_timeout: 10, max_segment_size: 10485760, data_directory: "/tmp/x"}
replication: {role: "slave", master_address: "127.0.0.1", master_port: 3333, slave_id: "slave1"}
"""


def test_config(tmp_path):
    assert config.load(_yaml(tmp_path, "")) == Config(wal=None)
    c = config.load(_yaml(tmp_path, SERVER))
    assert (c.network.port, c.wal.max_segment_size, c.replication.slave_id, c.refuses_writes) == (3224, 10 << 20, "slave1", True)
    c = config.load(_yaml(tmp_path, "shards: 4\nwal: {max_segment_size: 10MB}\nreplication: {role: master}"))
    assert (c.shards, c.wal.max_segment_size, c.refuses_writes) == (4, 10 << 20, False)
    for bad in (
        "engine: {type: disk}", "engine: disk", "engine: {type: ''}", "wal: {flush_batch_size: 4}", "wal: {flush_batch_timeout: 1001}", "wal: {max_segment_size: 1GB}", "wal: {max_segment_size: 4095}",
        "wal: null\nreplication: {role: master}", "replication: {role: master}", "wal: {}\nreplication: {role: king}", "wal: {}\nreplication: {role: slave}", "wal: {max_segment_size: x}", "logging: {level: loud}", "network: {ip: here}",
        "network: {port: 80}", "network: {port: 65536}", "network: {port: x}", "network: {max_connections: 0}", "network: {max_connections: 10001}", "network: {max_message_size: 0}", "network: {idle_timeout: 0}",
        "network: {graceful_shutdown_timeout: -1}", "wal: {data_directory: ''}", "shards: 0", "log_format: csv",
    ):
        with pytest.raises(InvalidArgument):
            config.load(_yaml(tmp_path, bad))
    with pytest.warns(UserWarning, match="wal.nonsense"):
        config.load(_yaml(tmp_path, "wal: {nonsense: 1}"))


def test_client_config():
    c = ClientConfig().check()
    assert c.backoff == retry.Backoff() and c.with_(retry_attempts=0, retry_jitter=False).backoff == retry.Backoff(0, jitter=False)
    for bad in ({"host": ""}, {"port": 0}, {"port": 65536}, {"connection_timeout_ms": 0}, {"operation_timeout_ms": 0}, {"max_message_size": 0}, {"retry_attempts": -1}, {"retry_base_delay_ms": -1}, {"retry_max_delay_ms": -1}, {"retry_base_delay_ms": 10, "retry_max_delay_ms": 5}):
        with pytest.raises(InvalidArgument):
            c.with_(**bad).check()
    assert c.with_(retry_max_delay_ms=0).check()


def test_linear_reconnect():
    slept, calls = [], []

    def third():
        calls.append(1)
        if len(calls) < 3:
            raise OSError()
        return "up"

    assert retry.connect(third, sleep=slept.append) == "up" and slept == [1.0, 2.0]
    slept.clear()
    with pytest.raises(ConnectionFailed, match="after 5 attempts"):
        retry.connect(lambda: 1 / 0, sleep=slept.append)
    assert slept == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(Cancelled):
        retry.connect(lambda: (_ for _ in ()).throw(Cancelled()), sleep=slept.append)


def test_client(spark, tmp_path):
    c = Client(KvTable(spark, f"file://{tmp_path}/t", Config(log_format="wal")), ClientConfig(max_message_size=64, retry_jitter=False), sleep=lambda s: None)
    c.set("k", "v")
    assert c.get_text("k") == "v" and c.ping()
    c.delete("k")
    with pytest.raises(KeyNotFound):
        c.get("k")
    with pytest.raises(InvalidArgument, match="too large"):
        c.set("k", "x" * 64)
    tried = []

    class Flaky:
        def get(self, key):
            tried.append(key)
            if len(tried) < 3:
                raise NetworkFailed()
            return b"back"

    assert Client(Flaky(), sleep=lambda s: None).get(b"k") == b"back" and len(tried) == 3


def test_frames_of_columns_are_those_of_the_codec(spark):
    good = [codec.encode_command("SET", "héllo 🌍".encode(), bytes([0, 1, 2, 255, 254, 253])), codec.encode_command("GET", b"k"), codec.encode_command("DEL", b"k"), codec.encode_command("SET", b"k" * 65535, b"v" * 70000)]
    bad = [b"", b"\x0a", b"\x00", codec.encode_command("INVALID", b"k"), codec.encode_command("SET", b"k"), codec.encode_command("GET", b"k", b"v"), good[0][:-1], good[1][:-1], good[1][:5], good[1] + b"more", codec.encode_command("GET"), codec.encode_command("set", b"k", b"v")]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate([*good, *bad])] + [(99, None)], "i int, f binary").select("i", layout.parse_frame(F.col("f")).alias("p")).collect()
    for r in rows:
        f = b"" if r.i == 99 else [*good, *bad][r.i]
        try:
            c = codec.parse_command(f)
            assert r.p.error is None and (r.p.command, bytes(r.p.key), None if r.p.value is None else bytes(r.p.value)) == (c.name, c.arguments[0], c.arguments[1] if len(c.arguments) > 1 else None)
        except codec.CodecError as e:
            assert (r.p.error, r.p.key) == (str(e), None)
    frames = [codec.frame(b""), codec.frame(b"abc"), codec.frame(b"abc")[:-1], b"\x00", codec.frame(b"x" * 20)]
    got = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i int, f binary").select("i", layout.read_message_frame(F.col("f"), 10).alias("m")).orderBy("i").collect()
    assert [(r.m.error, r.m.payload) for r in got] == [(None, b""), (None, b"abc"), ("failed to read message data", None), ("failed to read message header", None), ("message too large", None)]


@pytest.mark.parametrize("form", ["parquet", "wal"])
def test_many_at_once_and_answers(spark, tmp_path, form):
    t = KvTable(spark, f"file://{tmp_path}/t", Config(log_format=form))
    bad = t.set_many(spark.createDataFrame([(b"a", b"1", 1), (b"a", b"2", 2), (b"b", b"3", 3), (b"", b"x", 4), (None, b"x", 5), (b"c", b"", 6), (b"d", b"x" * 5000, 7)], "key binary, value binary, n int"), "n")
    assert sorted(r.error for r in bad.collect()) == ["invalid arguments number", "key cannot be empty", "key cannot be empty", "message too large"]
    assert t.get(b"a") == b"2" and t.last_lsn() == 2
    assert t.delete_many(spark.createDataFrame([(b"b",), (b"gone",), (b"",)], "key binary")).count() == 1
    assert {bytes(r.key) for r in t.state().collect()} == {b"a"} and t.last_lsn() == 4
    asked = [(1, "GET", b"a", None), (2, "SET", b"a", b"9"), (3, "GET", b"a", None), (4, "DEL", b"a", None), (5, "GET", b"a", None), (6, "SET", b"a", None), (7, "GET", b"b", None), (8, "NOPE", b"a", None), (9, "SET", b"z", b"1")]
    got = {r.seq: (r.error, None if r.value is None else bytes(r.value)) for r in t.serve(spark.createDataFrame(asked, COMMANDS)).collect()}
    missing = ("key not found", None)
    assert got == {1: (None, b"2"), 2: (None, None), 3: (None, b"9"), 4: (None, None), 5: missing, 6: ("invalid arguments number", None), 7: missing, 8: ("unknown command", None), 9: (None, None)}
    assert {bytes(r.key) for r in t.state().collect()} == {b"z"}
    t.set(b"s", b"single")
    t.delete(b"z")
    assert {bytes(r.key): bytes(r.value) for r in t.state().collect()} == {b"s": b"single"}
    t.close()
    c = t.compact(f"file://{tmp_path}/c")
    assert {bytes(r.key) for r in c.state().collect()} == {b"s"} and c.last_lsn() == t.last_lsn()
    replica = KvTable(spark, t.path, Config(log_format=form, replication=config.ReplicationConfig("slave", "127.0.0.1", 3333)))
    with pytest.raises(ReadOnly):
        replica.delete(b"s")
    assert {r.seq: r.error for r in replica.serve(spark.createDataFrame(asked[:2], COMMANDS)).collect()} == {1: "key not found", 2: "This instance is in read-only mode"}


def test_intermediate_tables_go(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidelog.session import materialize, path_exists, scratch

    with scratch(spark):
        df = materialize(spark.range(5), "x")
        path = df.inputFiles()[0].rpartition("/")[0]
        assert df.agg(F.count("*")).first()[0] == 5 and path_exists(spark, path)
    assert not path_exists(spark, path)


def _yaml(folder, text):
    p = folder / "c.yaml"
    p.write_text(text)
    return str(p)


def test_client_lines():
    from tidelog.cli import session

    class Fake(dict):
        def get(self, k):
            if k not in self:
                raise KeyNotFound(k)
            return self[k]

        def set(self, k, v):
            self[k] = v

        def delete(self, k):
            self.pop(k, None)

    lines = ["get a", "set a 1", "GET a", "", "SET a b c", "del a", "GET a", "what", "help", "exit", "GET a"]
    said = list(session(Fake(), lines))
    assert said[:3] == ["error: key not found: b'a'", "OK", "1"] and said[3] == "usage: SET key value"
    assert said[4:7] == ["OK", "error: key not found: b'a'", "unknown command: what"] and len(said) == 8


def test_replica_ids(spark):
    df = spark.createDataFrame([("a", 5), ("", 6), (None, 7)], "given string, lsn bigint").withColumn("at", F.timestamp_seconds(F.lit(100)))
    got = [r[0] for r in df.select(replication.replica_id(F.col("given"), F.col("lsn"), F.col("at"))).collect()]
    assert got == ["a", "slave-100-6", "slave-100-7"]
