"""Queries for the keyed-log operators, over the ``events`` table read as a change log, and their defining SQL.

``lsn`` is event_id, a DEL stands for an error event, the key is ``user:<user_id>``, the value is ``props``. Event ids are
unique; they need not be dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import layout
from tidelog.functions.records import batch_error, handshakes, record_error
from tidelog.functions.u64 import pos_to_bigint
from tidelog.operators import batching, replication, state
from tidelog.retry import delay_column, linear_delay_column, retryable_column, verdict
from tidelog.schema import DEL, SET
from tidelog.session import shared_dir, stream_path

BATCH, SHIP, SHARDS, SEGMENT_BYTES, WAIT_MS = 100, 50, 8, 16384, 300_000


def change_log(events: DataFrame) -> DataFrame:
    """``(lsn, command, key, value, at_ms)`` of an events DataFrame, batch or stream."""
    return events.select(
        F.col("event_id").alias("lsn"),
        F.when(F.col("event_type") == "error", DEL).otherwise(SET).alias("command"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("props")).alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
    )


def order_log(orders: DataFrame) -> DataFrame:
    """A second log: orders by customer, a finished order deletes."""
    return orders.select(
        F.col("o_orderkey").alias("lsn"),
        F.when(F.col("o_orderstatus") == "F", DEL).otherwise(SET).alias("command"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice").cast("string")).alias("value"),
    )


def _log(spark: SparkSession, d: str) -> DataFrame:
    return change_log(spark.read.parquet(f"{d}/events.parquet"))


def _args(log: DataFrame) -> DataFrame:
    """With ``arguments`` as they go to the log: key and, for a SET, value."""
    key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
    return log.withColumn("arguments", F.when(F.col("command") == SET, F.array(key, value)).otherwise(F.array(key)))


def kv_state_latest(spark, d):
    return state.fold(_log(spark, d))


def kv_state_orders(spark, d):
    return state.fold(order_log(spark.read.parquet(f"{d}/orders.parquet"))).select("key", "lsn")


def kv_point_get(spark, d):
    return state.point_get(_log(spark, d), "user:42").select("key", "value")


def kv_multi_get_found(spark, d):
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))
    return state.multi_get(_log(spark, d), wanted)


def kv_delete_idempotent(spark, d):
    log = _log(spark, d).drop("at_ms")
    user = F.concat(F.lit("user:"), F.col("n_nationkey").cast("string"))
    gone = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 10**12).alias("lsn"), F.lit(DEL).alias("command"), user.alias("key"), F.lit(None).cast("string").alias("value"))
    return state.fold(log.unionByName(gone))


def _commands(spark, d):
    """Events as client commands, some of which no server accepts."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "click", "set").otherwise("SET").alias("command"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("value"),
    )


def kv_command_validate(spark, d):
    checked = _commands(spark, d).select(F.coalesce(state.command_error(F.col("command"), F.col("key"), F.col("value")), F.lit("ok")).alias("error"))
    return checked.groupBy("error").agg(F.count("*").alias("n"))


def kv_read_only_gate(spark, d):
    return state.gate(_commands(spark, d), True).groupBy("command", F.coalesce("error", F.lit("served")).alias("outcome")).agg(F.count("*").alias("n"))


def kv_record_validate(spark, d):
    log = spark.read.parquet(f"{d}/wal_log.parquet")
    why = F.coalesce(record_error(F.col("lsn"), F.col("command"), F.col("arguments")), F.lit("ok"))
    return log.groupBy(why.alias("error")).agg(F.count("*").alias("n"))


def kv_shard_of_key(spark, d):
    keys = _log(spark, d).select("key").distinct()
    return keys.select("key", layout.shard_of(F.col("key").cast("binary"), SHARDS).alias("shard"))


def kv_shard_sizes(spark, d):
    return kv_shard_of_key(spark, d).groupBy("shard").agg(F.count("*").alias("keys"))


def kv_scan_from_lsn(spark, d):
    return _log(spark, d).where("lsn >= 9000").select("lsn", "command", "key")


def kv_last_lsn(spark, d):
    return _log(spark, d).agg(F.max("lsn").alias("last_lsn"))


def kv_assign_lsn(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), "user_id")
    return state.assign_lsn(e, 1000).select("seq", "lsn")


def kv_batches_by_size(spark, d):
    b = batching.batches_by_size(_log(spark, d), BATCH)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def kv_batches_size_or_time(spark, d):
    b = batching.batches_by_size_or_time(_log(spark, d).select("lsn", "at_ms"), BATCH, WAIT_MS)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def kv_batch_key_counts(spark, d):
    return batching.key_counts(batching.batches_by_size(_log(spark, d), BATCH))


def _batch_sizes(spark, d):
    size = layout.record_length(F.col("lsn"), F.col("command"), F.col("arguments"))
    b = batching.batches_by_size(_args(_log(spark, d)).select("lsn", size.alias("size")), BATCH)
    return b.groupBy("batch_id").agg(F.sum("size").alias("bytes"), F.min("lsn").alias("first_lsn"))


def kv_segment_packing(spark, d):
    return batching.pack_segments(_batch_sizes(spark, d), SEGMENT_BYTES)


def _manifest(spark, d):
    sizes = _batch_sizes(spark, d)
    packed = batching.pack_segments(sizes, SEGMENT_BYTES)
    return packed.join(sizes.select("batch_id", "first_lsn"), "batch_id").groupBy("segment").agg(F.min("first_lsn").alias("lsn_start"))


def kv_segment_for_lsn(spark, d):
    wanted = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("lsn")).distinct()
    return batching.segment_for(_manifest(spark, d), wanted)


def kv_uvarint_len(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", layout.uvarint_length(F.col("o_orderkey") * F.col("o_orderkey")).alias("n_bytes"))


def kv_record_bytes(spark, d):
    return _args(_log(spark, d)).select("lsn", layout.record_length(F.col("lsn"), F.col("command"), F.col("arguments")).alias("n_bytes"))


def kv_command_frame_hex(spark, d):
    name = F.when(F.col("command") == SET, "SET").otherwise("DEL")
    return _log(spark, d).select("lsn", F.hex(layout.command_frame(name, F.col("key").cast("binary"), F.col("value").cast("binary"))).alias("frame"))


def _shipped(spark, d):
    strings = F.when(F.col("command") == SET, F.array("key", "value")).otherwise(F.array("key"))
    return replication.ship_batches(_log(spark, d).withColumn("arguments", strings), SHIP)


def kv_replication_batches(spark, d):
    e = F.col("events")
    return _shipped(spark, d).select("batch_id", "total", F.element_at(e, 1)["lsn"].alias("first_lsn"), F.element_at(e, -1)["lsn"].alias("last_lsn"))


def kv_replication_json_roundtrip(spark, d):
    back = replication.events_of(replication.batch_from_json(replication.batch_json(_shipped(spark, d))))
    return back.select("batch_id", F.col("lsn").cast("bigint").alias("lsn"), "command", F.get("arguments", F.lit(0)).alias("key"), F.get("arguments", F.lit(1)).alias("value"))


def kv_batch_validate(spark, d):
    b = spark.read.parquet(f"{d}/repl_batches.parquet")
    return b.select("batch_id", F.coalesce(batch_error(F.col("total"), F.col("events")), F.lit("ok")).alias("error"))


def kv_handshake_validate(spark, d):
    h = handshakes(spark.read.parquet(f"{d}/sync_messages.parquet"))
    return h.select("msg_id", "accepted", F.when(F.col("accepted"), F.col("slave")).alias("slave_id"), F.when(F.col("accepted"), pos_to_bigint(F.col("pos"))).alias("last_lsn"))


def _positions(spark, d):
    h = handshakes(spark.read.parquet(f"{d}/sync_messages.parquet")).where("accepted")
    replica = F.concat_ws("/", "master_id", "slave")
    return h.groupBy(replica.alias("replica")).agg(F.max(pos_to_bigint(F.col("pos"))).alias("last_lsn"))


def kv_replica_position(spark, d):
    b = spark.read.parquet(f"{d}/repl_batches.parquet").where(batch_error(F.col("total"), F.col("events")).isNull())
    events = F.transform("events", lambda e: F.struct(e["lsn"].cast("bigint").alias("lsn")))
    sent = b.select(F.concat_ws("/", "master_id", "slave_id").alias("replica"), "batch_id", events.alias("events"), F.coalesce(F.col("reply") == "OK", F.lit(False)).alias("ok"))
    return replication.advance_positions(_positions(spark, d), sent)


def kv_min_replica_lsn(spark, d):
    return replication.min_replica_lsn(_positions(spark, d)).select(F.col("min_lsn").cast("string").alias("min_lsn"))


def kv_replica_registry(spark, d):
    m = handshakes(spark.read.parquet(f"{d}/sync_messages.parquet")).where("accepted")
    regs = m.select(F.concat_ws("/", "master_id", "slave").alias("replica"), pos_to_bigint(F.col("pos")).alias("last_lsn"), F.lit(False).alias("removed"), F.col("msg_id").alias("at"))
    return replication.registry(regs)


def kv_registry_removal(spark, d):
    """Replicas still registered after every fifth handshake's session has ended: its removal comes after it and before the next."""
    m = handshakes(spark.read.parquet(f"{d}/sync_messages.parquet")).where("accepted")
    came = m.select(F.concat_ws("/", "master_id", "slave").alias("replica"), pos_to_bigint(F.col("pos")).alias("last_lsn"), "msg_id")
    left = came.where("msg_id % 5 = 0").select("replica", "last_lsn", F.lit(True).alias("removed"), (F.col("msg_id") * 2 + 1).alias("at"))
    return replication.registry(came.select("replica", "last_lsn", F.lit(False).alias("removed"), (F.col("msg_id") * 2).alias("at")).unionByName(left))


def kv_handshake_roundtrip(spark, d):
    """Positions as handshakes, parsed again, and where shipping starts."""
    sent = replication.handshake_json(_positions(spark, d)).select("message", F.lit("OK").alias("reply"))
    back = handshakes(sent).where("accepted")
    lsn = pos_to_bigint(F.col("pos"))
    return back.select(F.col("slave").alias("replica"), lsn.alias("last_lsn"), replication.start_lsn(lsn).cast("bigint").alias("start_lsn"))


def kv_handshake_reply(spark, d):
    """The reply to every handshake, and the id it gives."""
    h = handshakes(spark.read.parquet(f"{d}/sync_messages.parquet").withColumn("reply", F.lit("OK")))
    reply = replication.handshake_reply(F.col("accepted"), F.col("slave"), F.lit("invalid message"))
    return h.select("msg_id", reply.alias("answer")).withColumn("slave_id", replication.assigned_id(F.when(F.col("answer").startswith("{"), F.col("answer"))))


def kv_oversize_records(spark, d):
    """Applicable records whose command frame would exceed a message of 256 bytes, per master."""
    from tidelog.functions.records import log_changes

    log = log_changes(spark.read.parquet(f"{d}/wal_log.parquet"))
    name = F.when(F.col("command") == SET, "SET").otherwise("DEL")
    size = F.octet_length(layout.command_frame(name, F.col("key"), F.col("value")))
    return log.groupBy("master_id").agg(F.sum(F.when(size > 256, 1).otherwise(0)).alias("oversize"), F.max(size).alias("largest"))


def kv_next_lsn(spark, d):
    """Per master, the LSN after its last applicable record."""
    from tidelog.functions.records import log_changes

    return log_changes(spark.read.parquet(f"{d}/wal_log.parquet")).groupBy("master_id").agg((pos_to_bigint(F.max("pos")) + 1).alias("next_lsn"))


def kv_last_segment(spark, d):
    """Per master, the manifest's last entry: the segment that opens latest, by its first LSN."""
    from tidelog.functions.records import log_changes

    log = log_changes(spark.read.parquet(f"{d}/wal_log.parquet"), scope=("master_id", "segment", "ordinal"))
    starts = log.groupBy("master_id", "segment").agg(F.min_by("pos", "ordinal").alias("start"))
    last = starts.groupBy("master_id").agg(F.max(F.struct("segment", "start")).alias("s"))
    return last.select("master_id", "s.segment", pos_to_bigint(F.col("s.start")).alias("lsn_start"))


def kv_replica_apply(spark, d):
    log = _log(spark, d)
    return replication.apply_batches(log.where("lsn < 9000"), log.where("lsn >= 8000"))


def kv_retry_delays(spark, d):
    return spark.range(0, 12).select(F.col("id").cast("int").alias("attempt"), delay_column(F.col("id")).alias("delay_ms"))


def kv_reconnect_delays(spark, d):
    return spark.range(0, 8).select(F.col("id").cast("int").alias("attempt"), linear_delay_column(F.col("id")).alias("delay_ms"))


def kv_retry_verdict(spark, d):
    """What a sender makes of the answer to each batch."""
    b = spark.read.parquet(f"{d}/repl_batches.parquet")
    return b.groupBy(verdict(F.col("reply")).alias("verdict")).agg(F.count("*").alias("n"))


def kv_retryable_errors(spark, d):
    from tidelog import errors

    kinds = [c.code for c in (errors.ConnectionFailed, errors.NetworkFailed, errors.ServerError, errors.ReadOnly, errors.KeyNotFound, errors.InvalidArgument, errors.Cancelled, errors.TidelogError)]
    df = spark.createDataFrame([(k,) for k in kinds], "kind string")
    return df.select("kind", retryable_column(F.col("kind")).alias("retryable"))


def kv_parse_frames(spark, d):
    """Commands as frames, every eleventh one byte short, parsed again."""
    c = _commands(spark, d)
    whole = layout.command_frame(F.col("command"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    cut = F.when(F.col("seq") % 11 == 0, F.substring("frame", F.lit(1), F.octet_length("frame") - 1)).otherwise(F.col("frame"))
    parsed = c.select("seq", whole.alias("frame")).select("seq", layout.parse_frame(cut).alias("p"))
    key, value = F.col("p.key").cast("string"), F.col("p.value").cast("string")
    return parsed.select("seq", F.coalesce("p.error", F.lit("ok")).alias("error"), state.command_id(F.coalesce("p.command", F.lit(""))).alias("command_id"), key.alias("key"), value.alias("value"))


def kv_message_frames(spark, d):
    """Values as framed messages of at most 60 bytes, every thirteenth one byte short, read again."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), layout.message_frame(F.coalesce("props", F.lit("")).cast("binary")).alias("f"))
    cut = F.when(F.col("seq") % 13 == 0, F.substring("f", F.lit(1), F.octet_length("f") - 1)).otherwise(F.col("f"))
    read = e.select("seq", layout.read_message_frame(cut, 60).alias("m"))
    return read.select("seq", F.coalesce("m.error", F.lit("ok")).alias("error"), F.col("m.payload").cast("string").alias("payload"))


def kv_serve_commands(spark, d):
    """The answer to every command, GETs seeing what was written before them, over the state that the customers left."""
    held = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    out = state.serve(_commands(spark, d), held)
    return out.select("seq", F.coalesce("error", F.lit("OK")).alias("answer"), "value")


def _event_stream(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return change_log(spark.readStream.schema(schema).parquet(stream_path(spark, path)))


def kv_stream_state(spark, d):
    from tidelog.streaming.state import latest_changes, run_once

    out = run_once(latest_changes(_event_stream(spark, d)), shared_dir(spark, "stream-state"), "complete")
    return out.where(F.col("command") == SET).select("key", "value", "lsn")


def kv_stream_state_tws(spark, d):
    from tidelog.streaming.state import ROCKSDB, changes_as_they_come, run_once

    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, ROCKSDB)
    try:
        out = run_once(changes_as_they_come(_event_stream(spark, d).drop("at_ms")), shared_dir(spark, "stream-tws"), "update")
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    return state.fold(out)


def kv_stream_replica(spark, d):
    from tidelog.streaming.state import Replica

    return Replica(spark, shared_dir(spark, "replica")).follow(_event_stream(spark, d)).state()


def kv_stream_group_commit(spark, d):
    """Commands of a stream committed in batches: the LSN, batch and per-batch key count that each is told."""
    from tidelog.streaming.commit import GroupCommit

    log = _event_stream(spark, d)
    commands = log.select(F.col("lsn").alias("seq"), F.when(F.col("command") == SET, "SET").otherwise("DEL").alias("command"), "key", "value")
    told = GroupCommit(spark, shared_dir(spark, "commit"), BATCH).follow(commands).told()
    return told.select("seq", "lsn", "batch_id", F.col("key").cast("string").alias("key"), "n")


def kv_ship_receive(spark, d):
    """The log shipped to a replica's inbox as JSON batches, received, checked and applied there."""
    from tidelog.streaming.ship import Receiver, ship

    at = shared_dir(spark, "ship")
    ship(_event_stream(spark, d).drop("at_ms"), f"{at}/inbox", f"{at}/sent", size=SHIP)
    state_of = Receiver(spark, f"{at}/inbox", f"{at}/replica").follow().state()
    return state_of.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "lsn")


def _wal_write(log, folder):
    rows = _args(log).select(F.col("lsn").cast("decimal(20,0)").alias("lsn"), "command", "arguments")
    rows.repartitionByRange("lsn").sortWithinPartitions("lsn").write.format("wal").mode("append").option("segmentBytes", 1 << 18).save(folder)


def _wal_rows(back):
    text = lambda i: F.get("arguments", F.lit(i)).cast("string")
    return back.select(F.col("lsn").cast("bigint").alias("lsn"), "command", text(0).alias("key"), text(1).alias("value"))


def _wal_folder(spark):
    from tidelog.sources.wal import register

    register(spark)
    return shared_dir(spark, "wal")


def kv_wal_roundtrip(spark, d):
    """Written to segment files in LSN order, read back and folded."""
    folder = _wal_folder(spark)
    _wal_write(_log(spark, d), folder)
    return state.fold(_wal_rows(spark.read.format("wal").load(folder)))


def kv_wal_scan_from_lsn(spark, d):
    """The log read back from an LSN on; segments below it are not opened."""
    folder = _wal_folder(spark)
    _wal_write(_log(spark, d), folder)
    return _wal_rows(spark.read.format("wal").load(folder).where("lsn >= 9000")).drop("value")


def kv_wal_tail(spark, d):
    """The log followed from LSN 2000 on while it grows: half is there when following starts, the rest comes later and is read by the next run."""
    from tidelog.streaming.state import run_once

    folder, at = _wal_folder(spark), shared_dir(spark, "tail")
    out = []
    for part in ("lsn % 10000 < 5000", "lsn % 10000 >= 5000"):
        _wal_write(_log(spark, d).where(part), folder)
        out.append(run_once(spark.readStream.format("wal").option("startingLsn", 2000).load(folder), at, "append"))
    return _wal_rows(out[0].select("lsn", "command", "arguments").unionByName(out[1].select("lsn", "command", "arguments"))).drop("value")


def kv_wal_segments(spark, d):
    """What segment files hold, found by reading them: each segment's first LSN is the manifest's, and its last record's LSN (not the greatest)."""
    from tidelog.sources.manifest import read_manifest

    folder = _wal_folder(spark)
    _wal_write(_log(spark, d), folder)
    found = state.last_lsn_in(spark.read.format("wal").load(folder))
    listed = spark.createDataFrame([(s.name, s.lsn_start) for s in read_manifest(folder)], "segment string, lsn_start bigint")
    both = listed.join(found, "segment", "full")
    whole = both.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.min("lsn_start").alias("first_lsn"), F.max("last_lsn").alias("last_lsn"), F.count_if(~F.col("lsn_start").eqNullSafe(F.col("first_lsn"))).alias("wrong"))
    return whole.select("records", "first_lsn", F.col("last_lsn").cast("bigint").alias("last_lsn"), "wrong")


def kv_wal_damaged(spark, d):
    """A log whose last segment has lost its last byte, read in PERMISSIVE mode: all records but one, and why that is missing."""
    from tidelog.sources.files import place, size_of
    from tidelog.sources.manifest import read_manifest

    folder = _wal_folder(spark)
    _wal_write(_log(spark, d), folder)
    system, path = place(folder)
    for segment in read_manifest(folder)[-1:]:
        last = f"{path}/{segment.name}"
        with system.open_input_file(last) as f:
            data = f.read(size_of(system, last) - 1)
        with system.open_output_stream(last) as f:
            f.write(data)
    rows = spark.read.format("wal").option("mode", "PERMISSIVE").load(folder)
    return rows.agg(F.count("lsn").alias("records"), F.max("error").alias("error"))


def _table_of(spark, d, form):
    """Customers set in bulk, every third deleted in bulk, then looked up with suppliers that were never there."""
    from tidelog.config import Config
    from tidelog.table import KvTable

    t = KvTable(spark, shared_dir(spark, "table"), Config(log_format=form))
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"))
    t.set_many(rows, "c_custkey")
    t.delete_many(rows.where("c_custkey % 3 = 0"))
    asked = rows.select("key").unionByName(spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).cast("binary").alias("key")))
    return t.get_many(asked).select(F.col("key").cast("string").alias("key"), "found", F.col("value").cast("string").alias("value"))


def kv_table_many(spark, d):
    return _table_of(spark, d, "parquet")


def kv_table_many_wal(spark, d):
    """The same with the table's log in segment files."""
    return _table_of(spark, d, "wal")


def kv_client_calls(spark, d):
    """Nations set one by one through a client, those of one region deleted again, as the log then has them."""
    from tidelog.client import Client
    from tidelog.config import Config
    from tidelog.table import KvTable

    t = KvTable(spark, shared_dir(spark, "client"), Config(log_format="wal"))
    c = Client(t)
    # A dimension of 25 rows.
    nations = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()
    for n in nations:
        c.set(f"nation:{n.n_nationkey}", n.n_name)
    for n in nations:
        if n.n_regionkey == 2:
            c.delete(f"nation:{n.n_nationkey}")
    t.close()
    return t.state().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "lsn")


def kv_replica_ids(spark, d):
    """The id of each replica: that which it gave, or, for every other one here, one made of time and position."""
    m = handshakes(spark.read.parquet(f"{d}/sync_messages.parquet")).where("accepted")
    given = F.when(F.col("msg_id") % 2 == 0, F.col("slave"))
    return m.select("msg_id", replication.replica_id(given, pos_to_bigint(F.col("pos")), F.col("received_at").cast("timestamp")).alias("replica"))


def kv_replay_file_order(spark, d):
    """Keys of which a replay in file order ends at another record than one in LSN order, per master."""
    from tidelog.functions.records import log_changes

    raw = spark.read.parquet(f"{d}/wal_log.parquet")
    log = log_changes(raw, scope=("master_id", "segment", "ordinal")).withColumnRenamed("pos", "lsn")
    file = F.max(F.struct("segment", "ordinal", "lsn"))["lsn"]
    last = log.groupBy("master_id", "key").agg(file.alias("by_file"), F.max("lsn").alias("by_lsn"))
    return last.where("by_file <> by_lsn").select("master_id", F.hex("key").alias("key_hex"), pos_to_bigint(F.col("by_file")).alias("by_file"), pos_to_bigint(F.col("by_lsn")).alias("by_lsn"))


def kv_as_of_lsn(spark, d):
    return state.as_of(_log(spark, d), 5000)


def kv_history(spark, d):
    return state.history(_log(spark, d))


def kv_lsn_gaps(spark, d):
    from tidelog.functions.records import log_changes

    log = log_changes(spark.read.parquet(f"{d}/wal_log.parquet")).withColumnRenamed("pos", "lsn")
    gaps = state.lsn_gaps(log, ("master_id",))
    return gaps.select("master_id", pos_to_bigint(F.col("after")).alias("after"), pos_to_bigint(F.col("before")).alias("before"), "missing")


def kv_compaction_savings(spark, d):
    log = _log(spark, d).withColumn("segment", F.floor(F.col("lsn") / 1000))
    return state.dead_records(log, 7500)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("kv_")}

_LOG = """(SELECT event_id AS lsn, CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS command, 'user:' || user_id AS key,
 CASE WHEN event_type <> 'error' THEN props END AS value, epoch_ms(ts) AS at_ms FROM events)"""


def _fold(log: str) -> str:
    return f"SELECT key, value, lsn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS rn FROM {log}) WHERE rn = 1 AND command = 1"


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(strlen(key)), lambda i: CAST(ord(key[i + 1]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
_COMMANDS = """(SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'view' THEN 'GET' WHEN 'click' THEN 'set' ELSE 'SET' END AS command,
 CASE WHEN user_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS key, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS value FROM events)"""
_COMMAND_ERROR = """CASE WHEN command NOT IN ('SET', 'GET', 'DEL') THEN 'unknown command'
 WHEN command = 'SET' AND coalesce(value, '') = '' THEN 'invalid arguments number' WHEN command <> 'SET' AND coalesce(value, '') <> '' THEN 'invalid arguments number'
 WHEN command = 'SET' AND key = '' THEN 'key cannot be empty' END"""
_VARLEN = "CAST(greatest(1, ceil(length(ltrim(bin({0}), '0')) / 7.0)) AS INTEGER)"
_RECORD = f"""({_VARLEN.format('lsn')} + 2 + {_VARLEN.format('strlen(key)')} + strlen(key)
 + CASE WHEN command = 1 THEN {_VARLEN.format('strlen(value)')} + strlen(value) ELSE 0 END)"""
_NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY lsn) - 1 AS place FROM {_LOG})"
_SIZES = f"""(SELECT place // {BATCH} AS batch_id, CAST(sum({_RECORD}) AS BIGINT) AS bytes, min(lsn) AS first_lsn FROM {_NUMBERED} GROUP BY 1)"""
_PACKED = f"""sizes AS {_SIZES},
 packed AS (SELECT batch_id, bytes, first_lsn, CAST(0 AS BIGINT) AS segment, bytes AS held FROM sizes WHERE batch_id = 0
 UNION ALL SELECT s.batch_id, s.bytes, s.first_lsn, p.segment + CASE WHEN p.held + s.bytes >= {SEGMENT_BYTES} THEN 1 ELSE 0 END,
  CASE WHEN p.held + s.bytes >= {SEGMENT_BYTES} THEN s.bytes ELSE p.held + s.bytes END FROM packed p JOIN sizes s ON s.batch_id = p.batch_id + 1)"""
_BATCH_ERROR = """CASE WHEN coalesce(total, 0) <= 0 THEN 'invalid total' WHEN coalesce(len(events), 0) <= 0 THEN 'no events' WHEN len(events) > total THEN 'more events than total'
 WHEN len(list_filter(events, lambda e: coalesce(len(e.args), 0) < 1)) > 0 THEN 'event without arguments'
 WHEN len(list_filter(events, lambda e: coalesce(e.cmdid, -1) < 0)) > 0 THEN 'invalid command id' END"""
_HANDSHAKE = """(SELECT msg_id, master_id, coalesce(json_type(m) = 'OBJECT' AND json_type(m, '$.type') = 'VARCHAR' AND json_extract_string(m, '$.type') = 'lsn_sync'
   AND json_type(m, '$.slave_id') = 'VARCHAR' AND json_extract_string(m, '$.slave_id') <> '' AND json_type(m, '$.last_lsn') IN ('UBIGINT', 'BIGINT')
   AND regexp_full_match(json_extract_string(m, '$.last_lsn'), '[0-9]+') AND (r0 = 'OK' OR (json_type(r) = 'OBJECT' AND json_extract_string(r, '$.status') = 'OK')), false) AS accepted,
  json_extract_string(m, '$.slave_id') AS slave_id, TRY_CAST(json_extract_string(m, '$.last_lsn') AS BIGINT) AS last_lsn
 FROM (SELECT msg_id, master_id, CASE WHEN json_valid(message) THEN message END AS m, reply AS r0, CASE WHEN json_valid(reply) THEN reply END AS r FROM sync_messages))"""
_POSITIONS = f"(SELECT master_id || '/' || slave_id AS replica, max(last_lsn) AS last_lsn FROM {_HANDSHAKE} WHERE accepted GROUP BY 1)"
_OK = """lsn IS NOT NULL AND ((command = 1 AND len(arguments) = 2 AND octet_length(arguments[1]) > 0 AND octet_length(arguments[2]) > 0)
 OR (command = 3 AND len(arguments) = 1 AND octet_length(arguments[1]) > 0))"""

SQL = {
    "kv_state_latest": _fold(_LOG),
    "kv_state_orders": "SELECT key, lsn FROM (SELECT 'cust:' || o_custkey AS key, o_orderkey AS lsn, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 AND s <> 'F'",
    "kv_point_get": f"SELECT key, value FROM ({_fold(_LOG)}) WHERE key = 'user:42'",
    "kv_multi_get_found": f"SELECT w.key, s.lsn IS NOT NULL AS found, s.value FROM (SELECT DISTINCT 'user:' || c_custkey AS key FROM customer) w LEFT JOIN ({_fold(_LOG)}) s ON w.key = s.key",
    "kv_delete_idempotent": _fold(f"(SELECT lsn, command, key, value FROM {_LOG} UNION ALL SELECT n_nationkey + 1000000000000, 3, 'user:' || n_nationkey, NULL FROM nation)"),
    "kv_command_validate": f"SELECT coalesce({_COMMAND_ERROR}, 'ok') AS error, count(*) AS n FROM {_COMMANDS} GROUP BY 1",
    "kv_read_only_gate": f"SELECT command, coalesce({_COMMAND_ERROR}, CASE WHEN command IN ('SET', 'DEL') THEN 'This instance is in read-only mode' END, 'served') AS outcome, count(*) AS n FROM {_COMMANDS} GROUP BY 1, 2",
    "kv_record_validate": """SELECT coalesce(CASE WHEN lsn IS NULL OR command IS NULL THEN 'log entry is nil' WHEN coalesce(len(arguments), 0) = 0 THEN 'log entry has no arguments'
 WHEN command = 1 AND len(arguments) <> 2 THEN 'invalid SET arguments' WHEN command = 3 AND len(arguments) <> 1 THEN 'invalid DEL arguments' WHEN command NOT IN (1, 3) THEN 'unknown command'
 WHEN coalesce(octet_length(arguments[1]), 0) = 0 THEN 'key cannot be empty' WHEN command = 1 AND coalesce(octet_length(arguments[2]), 0) = 0 THEN 'value cannot be empty' END, 'ok') AS error, count(*) AS n FROM wal_log GROUP BY 1""",
    "kv_shard_of_key": f"SELECT key, CAST({_FNV} % {SHARDS} AS INTEGER) AS shard FROM (SELECT DISTINCT key FROM {_LOG})",
    "kv_shard_sizes": f"SELECT CAST({_FNV} % {SHARDS} AS INTEGER) AS shard, count(*) AS keys FROM (SELECT DISTINCT key FROM {_LOG}) GROUP BY 1",
    "kv_scan_from_lsn": f"SELECT lsn, command, key FROM {_LOG} WHERE lsn >= 9000",
    "kv_last_lsn": f"SELECT max(lsn) AS last_lsn FROM {_LOG}",
    "kv_assign_lsn": "SELECT event_id AS seq, 1000 + row_number() OVER (ORDER BY event_id) AS lsn FROM events",
    "kv_batches_by_size": f"SELECT place // {BATCH} AS batch_id, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM {_NUMBERED} GROUP BY 1",
    "kv_batches_size_or_time": f"""WITH RECURSIVE log AS {_NUMBERED},
 walk AS (SELECT place, lsn, at_ms, CAST(0 AS BIGINT) AS batch_id, 1 AS held, at_ms AS first_ms FROM log WHERE place = 0
 UNION ALL SELECT l.place, l.lsn, l.at_ms, w.batch_id + CASE WHEN w.held >= {BATCH} OR l.at_ms - w.first_ms >= {WAIT_MS} THEN 1 ELSE 0 END,
  CASE WHEN w.held >= {BATCH} OR l.at_ms - w.first_ms >= {WAIT_MS} THEN 1 ELSE w.held + 1 END,
  CASE WHEN w.held >= {BATCH} OR l.at_ms - w.first_ms >= {WAIT_MS} THEN l.at_ms ELSE w.first_ms END FROM walk w JOIN log l ON l.place = w.place + 1)
SELECT batch_id, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM walk GROUP BY 1""",
    "kv_batch_key_counts": f"SELECT place // {BATCH} AS batch_id, key, count(*) AS n FROM {_NUMBERED} GROUP BY 1, 2",
    "kv_segment_packing": f"WITH RECURSIVE {_PACKED} SELECT batch_id, bytes, segment FROM packed",
    "kv_segment_for_lsn": f"""WITH RECURSIVE {_PACKED}, manifest AS (SELECT segment, min(first_lsn) AS lsn_start FROM packed GROUP BY 1)
SELECT o.lsn, coalesce(m.segment, 0) AS segment FROM (SELECT DISTINCT o_orderkey AS lsn FROM orders) o ASOF LEFT JOIN manifest m ON o.lsn >= m.lsn_start""",
    "kv_uvarint_len": f"SELECT o_orderkey, {_VARLEN.format('o_orderkey * o_orderkey')} AS n_bytes FROM orders",
    "kv_record_bytes": f"SELECT lsn, CAST({_RECORD} AS INTEGER) AS n_bytes FROM {_LOG}",
    "kv_command_frame_hex": f"""SELECT lsn, '03' || CASE WHEN command = 1 THEN hex('SET') ELSE hex('DEL') END || printf('%04X', strlen(key)) || hex(key)
 || printf('%08X', CASE WHEN command = 1 THEN strlen(value) ELSE 0 END) || CASE WHEN command = 1 THEN hex(value) ELSE '' END AS frame FROM {_LOG}""",
    "kv_replication_batches": f"SELECT place // {SHIP} AS batch_id, CAST(count(*) AS INTEGER) AS total, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM {_NUMBERED} GROUP BY 1",
    "kv_replication_json_roundtrip": f"SELECT place // {SHIP} AS batch_id, lsn, command, key, value FROM {_NUMBERED}",
    "kv_batch_validate": f"SELECT batch_id, coalesce({_BATCH_ERROR}, 'ok') AS error FROM repl_batches",
    "kv_handshake_validate": f"SELECT msg_id, accepted, CASE WHEN accepted THEN slave_id END AS slave_id, CASE WHEN accepted THEN last_lsn END AS last_lsn FROM {_HANDSHAKE}",
    "kv_replica_position": f"""SELECT p.replica, greatest(p.last_lsn, s.lsn) AS last_lsn FROM {_POSITIONS} p LEFT JOIN (
 SELECT master_id || '/' || slave_id AS replica, CAST(max(events[len(events)].lsn) AS BIGINT) AS lsn FROM repl_batches WHERE reply = 'OK' AND {_BATCH_ERROR} IS NULL GROUP BY 1) s USING (replica)""",
    "kv_min_replica_lsn": f"SELECT CAST(coalesce(min(last_lsn), 18446744073709551615) AS VARCHAR) AS min_lsn FROM {_POSITIONS}",
    "kv_replica_registry": f"SELECT replica, last_lsn FROM (SELECT master_id || '/' || slave_id AS replica, last_lsn, row_number() OVER (PARTITION BY master_id, slave_id ORDER BY msg_id DESC) AS rn FROM {_HANDSHAKE} WHERE accepted) WHERE rn = 1",
    "kv_registry_removal": f"""SELECT replica, last_lsn FROM (SELECT master_id || '/' || slave_id AS replica, last_lsn, msg_id, row_number() OVER (PARTITION BY master_id, slave_id ORDER BY msg_id DESC) AS rn
 FROM {_HANDSHAKE} WHERE accepted) WHERE rn = 1 AND msg_id % 5 <> 0""",
    "kv_reconnect_delays": "SELECT CAST(i AS INTEGER) AS attempt, CAST(CASE WHEN i BETWEEN 1 AND 4 THEN i * 1000 ELSE 0 END AS BIGINT) AS delay_ms FROM range(8) t(i)",
    "kv_retry_verdict": "SELECT CASE WHEN reply IS NULL THEN 'retry' WHEN reply = 'OK' THEN 'done' ELSE 'give up' END AS verdict, count(*) AS n FROM repl_batches GROUP BY 1",
    "kv_retryable_errors": "SELECT * FROM (VALUES ('connection', true), ('network', true), ('server', false), ('read only', false), ('key not found', false), ('invalid argument', false), ('cancelled', false), ('error', true)) t(kind, retryable)",
    "kv_parse_frames": f"""SELECT seq, error, CAST(CASE WHEN error <> 'ok' THEN 0 WHEN command = 'SET' THEN 1 WHEN command = 'GET' THEN 2 ELSE 3 END AS INTEGER) AS command_id,
 CASE WHEN error = 'ok' THEN key END AS key, CASE WHEN error = 'ok' AND value <> '' THEN value END AS value FROM (
 SELECT seq, command, key, coalesce(value, '') AS value, CASE WHEN command NOT IN ('SET', 'GET', 'DEL') THEN 'unknown command' WHEN seq % 11 = 0 THEN 'invalid protocol format'
  WHEN (command = 'SET') <> (coalesce(value, '') <> '') THEN 'invalid arguments number' ELSE 'ok' END AS error FROM {_COMMANDS})""",
    "kv_message_frames": """SELECT event_id AS seq, error, CASE WHEN error = 'ok' THEN coalesce(props, '') END AS payload FROM (SELECT *, CASE WHEN strlen(coalesce(props, '')) = 0 AND event_id % 13 = 0 THEN 'failed to read message header'
 WHEN strlen(coalesce(props, '')) > 60 THEN 'message too large' WHEN event_id % 13 = 0 THEN 'failed to read message data' ELSE 'ok' END AS error FROM events)""",
    "kv_serve_commands": f"""WITH c AS (SELECT *, {_COMMAND_ERROR} AS error FROM {_COMMANDS}),
 every AS (SELECT seq, command, key, value, error FROM c UNION ALL SELECT -1, 'SET', CAST(c_custkey AS VARCHAR), c_mktsegment, NULL FROM customer),
 told AS (SELECT *, last_value(CASE WHEN error IS NULL AND command IN ('SET', 'DEL') THEN {{'v': CASE WHEN command = 'SET' THEN value END}} END IGNORE NULLS)
  OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM every)
SELECT seq, coalesce(error, CASE WHEN command = 'GET' AND w.v IS NULL THEN 'key not found' END, 'OK') AS answer, CASE WHEN error IS NULL AND command = 'GET' THEN w.v END AS value FROM told WHERE seq >= 0""",
    "kv_handshake_roundtrip": f"SELECT replica, last_lsn, coalesce(last_lsn + 1, 0) AS start_lsn FROM {_POSITIONS}",
    "kv_handshake_reply": f"""SELECT msg_id, CASE WHEN accepted THEN '{{"status":"OK","slave_id":"' || slave_id || '"}}' ELSE 'ERROR: invalid message' END AS answer,
 CASE WHEN accepted THEN slave_id END AS slave_id FROM {_HANDSHAKE.replace("FROM sync_messages", "FROM (SELECT msg_id, master_id, message, 'OK' AS reply FROM sync_messages)")}""",
    "kv_oversize_records": f"""SELECT master_id, CAST(sum(CASE WHEN n > 256 THEN 1 ELSE 0 END) AS BIGINT) AS oversize, CAST(max(n) AS INTEGER) AS largest FROM (
 SELECT master_id, 10 + octet_length(arguments[1]) + coalesce(octet_length(arguments[2]), 0) AS n FROM wal_log WHERE {_OK}) GROUP BY 1""",
    "kv_next_lsn": f"SELECT master_id, CAST(max(lsn) AS BIGINT) + 1 AS next_lsn FROM wal_log WHERE {_OK} GROUP BY 1",
    "kv_last_segment": f"""SELECT master_id, segment, CAST(lsn_start AS BIGINT) AS lsn_start FROM (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY segment DESC) AS rn FROM (
 SELECT master_id, segment, arg_min(lsn, ordinal) AS lsn_start FROM wal_log WHERE {_OK} GROUP BY 1, 2)) WHERE rn = 1""",
    "kv_replica_apply": _fold(_LOG),
    "kv_retry_delays": "SELECT CAST(i AS INTEGER) AS attempt, CAST(least(100 * (1 << i), 5000) AS BIGINT) AS delay_ms FROM range(12) t(i)",
    "kv_stream_state": _fold(_LOG),
    "kv_stream_state_tws": _fold(_LOG),
    "kv_stream_replica": _fold(_LOG),
    "kv_stream_group_commit": f"SELECT lsn AS seq, place AS lsn, place // {BATCH} AS batch_id, key, count(*) OVER (PARTITION BY place // {BATCH}, key) AS n FROM {_NUMBERED}",
    "kv_ship_receive": _fold(_LOG),
    "kv_wal_roundtrip": _fold(_LOG),
    "kv_wal_damaged": f"SELECT greatest(count(*) - 1, 0) AS records, CASE WHEN count(*) > 0 THEN 'failed to decode argument' END AS error FROM {_LOG}",
    "kv_table_many": """SELECT 'c' || c_custkey AS key, c_custkey % 3 <> 0 AS found, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS value FROM customer
UNION ALL SELECT 's' || s_suppkey, false, NULL FROM supplier""",
    "kv_client_calls": "SELECT 'nation:' || n_nationkey AS key, n_name AS value, row_number() OVER (ORDER BY n_nationkey) - 1 AS lsn FROM nation QUALIFY n_regionkey <> 2",
    "kv_replica_ids": f"SELECT msg_id, CASE WHEN msg_id % 2 = 0 THEN slave_id ELSE 'slave-' || (epoch_ms(received_at) // 1000) || '-' || last_lsn END AS replica FROM {_HANDSHAKE} JOIN (SELECT msg_id, received_at FROM sync_messages) USING (msg_id) WHERE accepted",
    "kv_wal_scan_from_lsn": f"SELECT lsn, command, key FROM {_LOG} WHERE lsn >= 9000",
    "kv_wal_tail": f"SELECT lsn, command, key FROM {_LOG} WHERE lsn >= 2000",
    "kv_wal_segments": f"SELECT count(*) AS records, min(lsn) AS first_lsn, max(lsn) AS last_lsn, CAST(0 AS BIGINT) AS wrong FROM {_LOG}",
    "kv_replay_file_order": f"""SELECT master_id, hex(arguments[1]) AS key_hex, CAST(arg_max(lsn, (segment, ordinal, lsn)) AS BIGINT) AS by_file, CAST(max(lsn) AS BIGINT) AS by_lsn
FROM wal_log WHERE {_OK} GROUP BY 1, 2 HAVING by_file <> by_lsn""",
    "kv_as_of_lsn": _fold(f"(SELECT * FROM {_LOG} WHERE lsn <= 5000)"),
    "kv_history": f"SELECT key, value, since, until FROM (SELECT key, value, command, lsn AS since, lead(lsn) OVER (PARTITION BY key ORDER BY lsn) AS until FROM {_LOG}) WHERE command = 1",
    "kv_lsn_gaps": f"""SELECT master_id, after, before, before - after - 1 AS missing FROM (
 SELECT master_id, lag(lsn) OVER (PARTITION BY master_id ORDER BY lsn) AS after, lsn AS before FROM (SELECT DISTINCT master_id, CAST(lsn AS BIGINT) AS lsn FROM wal_log WHERE {_OK})) WHERE before - after > 1""",
    "kv_compaction_savings": f"""SELECT segment, count(*) AS records, CAST(sum(CASE WHEN lsn < live AND lsn <= 7500 THEN 1 ELSE 0 END) AS BIGINT) AS dead FROM (
 SELECT lsn // 1000 AS segment, lsn, max(lsn) OVER (PARTITION BY key) AS live FROM {_LOG}) GROUP BY 1""",
}
SQL["kv_table_many_wal"] = SQL["kv_table_many"]
