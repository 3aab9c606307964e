"""Queries p1 to p3, p5 and p6 over whole tables, and their defining SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import ConnectionFailed
from tidelog.functions.records import handshakes, log_changes, valid_batch
from tidelog.functions.u64 import pos_to_bigint, to_pos
from tidelog.operators.eager import eager_join_aggregate
from tidelog.operators.incremental import IntervalLedger, to_intervals, unprocessed
from tidelog.operators.multiset import apply_changes
from tidelog.operators.reconcile import compare_copies
from tidelog.operators.sizing import broadcast_if_small
from tidelog.schema import DEL, SET
from tidelog.session import shared_dir
from tidelog.streaming.dedup import Deduplicator

MASTERS_BROADCAST = 10_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _state(spark: SparkSession, d: str, payload: list[str]) -> DataFrame:
    log = table(spark, d, "wal_log")
    changes = log_changes(log)
    return apply_changes(changes, ["master_id", "key"], "pos", F.col("command") == DEL, payload, n_rows=log.count())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Live keys of every master with the LSN of their last SET."""
    s = _state(spark, d, [])
    return s.select("master_id", F.hex("key").alias("key_hex"), pos_to_bigint(F.col("pos")).alias("lsn"))


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt tables themselves: keys with their values."""
    s = _state(spark, d, ["value"])
    return s.select("master_id", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), pos_to_bigint(F.col("pos")).alias("lsn"))


def p1_with_base(spark: SparkSession, d: str) -> DataFrame:
    """A replica's tables, as its own log left them, brought up to date by the masters' logs; rows the masters never touched stay, without LSN."""
    replica = table(spark, d, "replica_log")
    held = apply_changes(log_changes(replica), ["master_id", "key"], "pos", F.col("command") == DEL, ["value"], n_rows=replica.count())
    log = table(spark, d, "wal_log")
    s = apply_changes(log_changes(log), ["master_id", "key"], "pos", F.col("command") == DEL, ["value"], base=held, n_rows=log.count())
    return s.select("master_id", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), pos_to_bigint(F.col("pos")).alias("lsn"))


def _dedup(spark: SparkSession, d: str) -> Deduplicator:
    return Deduplicator(spark).run(f"{d}/repl_batches.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Surplus copies of events delivered more than once."""
    return _dedup(spark, d).surplus().select("batch_id", "event_pos")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """The one copy of every event that stays."""
    return _dedup(spark, d).kept().select("master_id", "slave_id", pos_to_bigint(F.col("pos")).alias("lsn"), "batch_id", "event_pos")


def replica_positions(messages: DataFrame) -> DataFrame:
    """(master_id, slave_id, position) of each replica with an accepted handshake; null: nothing applied yet."""
    said = handshakes(messages).where("accepted")
    return said.groupBy("master_id", F.col("slave").alias("slave_id")).agg(F.max("pos").alias("position"))


def acknowledged(batches: DataFrame) -> DataFrame:
    """(master_id, slave_id, pos) of events in valid batches that were answered ``OK``."""
    ok = batches.where((F.col("reply") == "OK") & valid_batch(F.col("total"), F.col("events")))
    return ok.select("master_id", "slave_id", F.explode(F.transform("events", lambda e: to_pos(e["lsn"]))).alias("pos"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Log records that each replica still lacks."""
    log = log_changes(table(spark, d, "wal_log")).select("master_id", "pos")
    consumers = replica_positions(table(spark, d, "sync_messages"))
    processed = to_intervals(acknowledged(table(spark, d, "repl_batches")), ["master_id", "slave_id"])
    lacking = unprocessed(log, consumers, processed)
    return lacking.select("master_id", "slave_id", pos_to_bigint(F.col("pos")).alias("lsn"))


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What each replica lacks, shipped in two committed runs with a failed one between: first the SETs, then all that is left.

    The deletes are late commits, below and between what the first run has processed. No record is shipped twice or left out.
    """
    ledger = IntervalLedger(spark, shared_dir(spark, "ledger"))
    log = log_changes(table(spark, d, "wal_log"))
    consumers = replica_positions(table(spark, d, "sync_messages"))

    def lost(rows: DataFrame) -> DataFrame:
        raise ConnectionFailed("the replica went away")

    ledger.mark(acknowledged(table(spark, d, "repl_batches")))
    first = ledger.run(log.where(F.col("command") == SET), consumers)
    try:
        ledger.run(log, consumers, lost)
    except ConnectionFailed:
        pass
    second = ledger.run(log, consumers)
    shipped = ledger.output(first).withColumn("run", F.lit(1)).unionByName(ledger.output(second).withColumn("run", F.lit(2)))
    return shipped.select("master_id", "slave_id", pos_to_bigint(F.col("pos")).alias("lsn"), "run")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys on at least 1 % of all rows: those whose rows, joined with all rows of the same key, make at least (rows / 100)^2 pairs.

    The log joined with itself by key is the most uneven join there is: the hottest key alone makes a hundredth of the
    square of all rows. Both inputs are the same here, so their states are exchanged once.
    """
    log = table(spark, d, "wal_log")
    keys = log.select(F.get("arguments", F.lit(0)).alias("key")).where("key IS NOT NULL")
    total = F.lit(log.count()).cast("decimal(19,0)")
    pairs = eager_join_aggregate(keys, keys, ["key"], ["key"], null_keys=False)
    return pairs.where(F.col("n") * 10000 >= total * total).select(F.hex("key").alias("key_hex"))


def p5_replica_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per key: the row pairs of wal_log JOIN replica_log on master and key, and how many of wal_log's are SETs.

    The pairs of the hottest key alone exceed the rows of both tables by far; none is ever built.
    """
    sides = [table(spark, d, t).select("master_id", F.get("arguments", F.lit(0)).alias("key"), "command").where("key IS NOT NULL") for t in ("wal_log", "replica_log")]
    out = eager_join_aggregate(
        *sides, ["master_id", "key"], ["key"],
        left_sums={"left_sets": F.when(F.col("command") == SET, 1).otherwise(0)}, right_sums={"right_sets": F.when(F.col("command") == SET, 1).otherwise(0)}, null_keys=False,
    )
    return out.select(F.hex("key").alias("key_hex"), *(F.col(c).cast("bigint").alias(n) for c, n in (("n", "pairs"), ("left_sets", "left_sets"), ("right_sets", "right_sets"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Differences between the masters' log and a replica's, field by field."""
    replica = table(spark, d, "replica_log")
    wal = table(spark, d, "wal_log")
    masters = broadcast_if_small(replica.select("master_id").distinct(), MASTERS_BROADCAST)
    left = log_changes(wal.join(masters, "master_id", "left_semi"))
    out = compare_copies(left, log_changes(replica), "master_id", "pos", ["command", "key", "value"])
    return out.select("master_id", pos_to_bigint(F.col("pos")).alias("lsn"), "diff")


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p1_with_base, p2_found, p2_kept, p3_found, p3_ledger, p5_found, p5_replica_pairs, p6_found)}

_APPLICABLE = """lsn IS NOT NULL AND ((command = 1 AND len(arguments) = 2 AND octet_length(arguments[1]) > 0 AND octet_length(arguments[2]) > 0)
 OR (command = 3 AND len(arguments) = 1 AND octet_length(arguments[1]) > 0))"""
_LIVE = f"""SELECT * FROM (
 SELECT master_id, arguments, command, CAST(lsn AS BIGINT) AS lsn,
  row_number() OVER (PARTITION BY master_id, arguments[1] ORDER BY lsn DESC) AS rn
 FROM wal_log WHERE {_APPLICABLE}) WHERE rn = 1 AND command = 1"""
_VALID = """total >= 1 AND len(events) >= 1 AND len(events) <= total
 AND len(list_filter(events, lambda e: coalesce(len(e.args), 0) < 1 OR coalesce(e.cmdid, -1) < 0)) = 0"""
_COPIES = f"""SELECT *, row_number() OVER (PARTITION BY master_id, slave_id, lsn ORDER BY batch_id, event_pos) AS copy FROM (
 SELECT master_id, slave_id, batch_id, e.lsn AS lsn, event_pos FROM (
  SELECT master_id, slave_id, batch_id, unnest(events) AS e, CAST(unnest(range(len(events))) AS BIGINT) AS event_pos
  FROM repl_batches WHERE {_VALID})) WHERE lsn IS NOT NULL"""

_LACKING = f"""WITH j AS (
  SELECT master_id, CASE WHEN json_valid(message) THEN message END AS m, reply AS r0, CASE WHEN json_valid(reply) THEN reply END AS r FROM sync_messages),
 accepted AS (
  SELECT master_id, json_extract_string(m, '$.slave_id') AS slave_id, TRY_CAST(json_extract_string(m, '$.last_lsn') AS DECIMAL(38,0)) AS last_lsn
  FROM j WHERE json_type(m) = 'OBJECT' AND json_type(m, '$.type') = 'VARCHAR' AND json_extract_string(m, '$.type') = 'lsn_sync'
   AND json_type(m, '$.slave_id') = 'VARCHAR' AND json_extract_string(m, '$.slave_id') <> ''
   AND json_type(m, '$.last_lsn') IN ('UBIGINT', 'BIGINT') AND regexp_full_match(json_extract_string(m, '$.last_lsn'), '[0-9]+')
   AND (r0 = 'OK' OR (json_type(r) = 'OBJECT' AND json_extract_string(r, '$.status') = 'OK'))),
 replicas AS (
  SELECT master_id, slave_id, max(CASE WHEN last_lsn < 18446744073709551615 THEN last_lsn END) AS position FROM accepted GROUP BY ALL),
 acked AS (
  SELECT DISTINCT master_id, slave_id, e.lsn AS lsn FROM (
   SELECT master_id, slave_id, unnest(events) AS e FROM repl_batches WHERE reply = 'OK' AND {_VALID})),
 log AS (SELECT DISTINCT master_id, lsn, command FROM wal_log WHERE {_APPLICABLE})
SELECT l.master_id, s.slave_id, CAST(l.lsn AS BIGINT) AS lsn, CASE l.command WHEN 1 THEN 1 ELSE 2 END AS run FROM log l JOIN replicas s USING (master_id)
WHERE (s.position IS NULL OR l.lsn > s.position)
 AND NOT EXISTS (SELECT 1 FROM acked a WHERE a.master_id = l.master_id AND a.slave_id = s.slave_id AND a.lsn = l.lsn)"""

SQL = {
    "p1_found": f"SELECT master_id, hex(arguments[1]) AS key_hex, lsn FROM ({_LIVE})",
    "p1_state": f"SELECT master_id, hex(arguments[1]) AS key_hex, hex(arguments[2]) AS value_hex, lsn FROM ({_LIVE})",
    "p1_with_base": f"""WITH live AS ({_LIVE}), base AS ({_LIVE.replace("FROM wal_log", "FROM replica_log")})
SELECT master_id, hex(arguments[1]) AS key_hex, hex(arguments[2]) AS value_hex, lsn FROM live
UNION ALL SELECT master_id, hex(arguments[1]), hex(arguments[2]), NULL FROM base b
 WHERE NOT EXISTS (SELECT 1 FROM wal_log w WHERE w.master_id IS NOT DISTINCT FROM b.master_id AND w.arguments[1] = b.arguments[1] AND {_APPLICABLE.replace("lsn", "w.lsn").replace("command", "w.command").replace("arguments", "w.arguments")})""",
    "p2_found": f"SELECT batch_id, event_pos FROM ({_COPIES}) WHERE copy > 1",
    "p2_kept": f"SELECT master_id, slave_id, CAST(lsn AS BIGINT) AS lsn, batch_id, event_pos FROM ({_COPIES}) WHERE copy = 1",
    "p3_found": f"SELECT master_id, slave_id, lsn FROM ({_LACKING})",
    "p3_ledger": _LACKING,
    "p5_found": """SELECT hex(arguments[1]) AS key_hex FROM wal_log WHERE arguments[1] IS NOT NULL GROUP BY 1
HAVING count(*) * 100 >= (SELECT count(*) FROM wal_log)""",
    "p5_replica_pairs": """WITH l AS (SELECT master_id, hex(arguments[1]) AS k, count(*) AS n, count(*) FILTER (command = 1) AS s FROM wal_log WHERE arguments[1] IS NOT NULL GROUP BY ALL),
 r AS (SELECT master_id, hex(arguments[1]) AS k, count(*) AS n, count(*) FILTER (command = 1) AS s FROM replica_log WHERE arguments[1] IS NOT NULL GROUP BY ALL)
SELECT l.k AS key_hex, CAST(sum(l.n * r.n) AS BIGINT) AS pairs, CAST(sum(l.s * r.n) AS BIGINT) AS left_sets, CAST(sum(r.s * l.n) AS BIGINT) AS right_sets
FROM l JOIN r ON l.master_id = r.master_id AND l.k = r.k GROUP BY 1""",
    "p6_found": f"""WITH l AS (SELECT DISTINCT master_id, lsn, command, arguments[1] AS k, arguments[2] AS v FROM wal_log
  WHERE master_id IN (SELECT master_id FROM replica_log) AND {_APPLICABLE}),
 r AS (SELECT DISTINCT master_id, lsn, command, arguments[1] AS k, arguments[2] AS v FROM replica_log WHERE {_APPLICABLE}),
 j AS (SELECT coalesce(l.master_id, r.master_id) AS master_id, CAST(coalesce(l.lsn, r.lsn) AS BIGINT) AS lsn, l.command AS lc, r.command AS rc, l.k AS lk, r.k AS rk, l.v AS lv, r.v AS rv
  FROM l FULL JOIN r ON l.master_id = r.master_id AND l.lsn = r.lsn)
SELECT master_id, lsn, 'only_master' AS diff FROM j WHERE rc IS NULL
UNION ALL SELECT master_id, lsn, 'only_replica' FROM j WHERE lc IS NULL
UNION ALL SELECT master_id, lsn, 'command' FROM j WHERE lc <> rc
UNION ALL SELECT master_id, lsn, 'key' FROM j WHERE lk <> rk
UNION ALL SELECT master_id, lsn, 'value' FROM j WHERE lc IS NOT NULL AND rc IS NOT NULL AND lv IS DISTINCT FROM rv""",
}
