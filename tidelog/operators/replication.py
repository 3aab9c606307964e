"""Shipping a log to replicas: batches, envelopes, handshakes, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.records import batch_error
from tidelog.functions.u64 import dec
from tidelog.operators.batching import batches_by_size
from tidelog.operators.state import fold
from tidelog.schema import LOG_BATCH, MAX_U64

SHIP_EVENTS = 50


def ship_batches(log: DataFrame, size: int = SHIP_EVENTS) -> DataFrame:
    """``(batch_id, total, events)``: records in LSN order, ``size`` to a batch; events are ``lsn, cmdid, args``."""
    placed = batches_by_size(log, size).withColumn("event", F.struct("lsn", F.col("command").alias("cmdid"), F.col("arguments").alias("args")))
    return placed.groupBy("batch_id").agg(F.count("*").cast("int").alias("total"), F.sort_array(F.collect_list("event")).alias("events"))


def batch_json(batches: DataFrame) -> DataFrame:
    """Batches as JSON text; BINARY arguments must have been decoded or base64-encoded before."""
    return batches.select("batch_id", F.to_json(F.struct("total", "events")).alias("message"))


def batch_from_json(messages: DataFrame) -> DataFrame:
    """``(batch_id, total, events)`` again; both null where the text is no batch."""
    return messages.select("batch_id", F.from_json("message", LOG_BATCH).alias("b")).select("batch_id", "b.total", "b.events")


def events_of(batches: DataFrame) -> DataFrame:
    """Log records of the batches that pass validation: ``(batch_id, lsn, command, arguments)``."""
    good = batches.where(batch_error(F.col("total"), F.col("events")).isNull())
    return good.select("batch_id", F.inline("events")).withColumnsRenamed({"cmdid": "command", "args": "arguments"})


def advance_positions(positions: DataFrame, sent: DataFrame) -> DataFrame:
    """``(replica, last_lsn)`` after batches went out: that of the last event sent, never less than before.

    ``sent``: ``(replica, batch_id, events, ok)``; a batch that failed moves nothing.
    """
    last = sent.where("ok AND size(events) > 0").groupBy("replica").agg(F.max(F.element_at("events", -1)["lsn"]).alias("sent_lsn"))
    return positions.join(last, "replica", "left").select("replica", F.greatest("last_lsn", "sent_lsn").alias("last_lsn"))


def registry(registrations: DataFrame) -> DataFrame:
    """The last registration of each replica; one that ends with a removal is gone."""
    last = registrations.groupBy("replica").agg(F.max_by(F.struct("last_lsn", "removed"), "at").alias("r"))
    return last.where("NOT r.removed").select("replica", F.col("r.last_lsn").alias("last_lsn"))


def min_replica_lsn(positions: DataFrame) -> DataFrame:
    """One row: the least position of all replicas, 2^64-1 without any."""
    return positions.agg(F.coalesce(F.min("last_lsn").cast("decimal(20,0)"), dec(MAX_U64)).alias("min_lsn"))


def apply_batches(log: DataFrame, redelivered: DataFrame) -> DataFrame:
    """State of a replica that holds ``log`` and is sent more, some of it again: the fold does not mind repeats."""
    return fold(log.unionByName(redelivered))


def replica_id(given: Column, lsn: Column, at: Column) -> Column:
    """The id a replica gave, or one made of time and position for one that gave none."""
    made = F.concat(F.lit("slave-"), F.unix_timestamp(at).cast("string"), F.lit("-"), lsn.cast("string"))
    return F.coalesce(F.when(F.length(given) > 0, given), made)


def handshake_json(positions: DataFrame) -> DataFrame:
    """What each replica sends first: ``(replica, message)``. A replica without a position sends 2^64-1."""
    lsn = F.coalesce(F.col("last_lsn").cast("decimal(20,0)"), dec(MAX_U64))
    return positions.select("replica", F.to_json(F.struct(F.lit("lsn_sync").alias("type"), lsn.alias("last_lsn"), F.col("replica").alias("slave_id"))).alias("message"))


def handshake_reply(accepted: Column, replica: Column, why: Column) -> Column:
    """``{"status":"OK","slave_id":...}`` or ``ERROR: ...``."""
    return F.when(accepted, F.to_json(F.struct(F.lit("OK").alias("status"), replica.alias("slave_id")))).otherwise(F.concat(F.lit("ERROR: "), why))


def assigned_id(reply: Column) -> Column:
    """The id that a reply gives the replica; null for a bare ``OK`` or a refusal."""
    return F.get_json_object(reply, "$.slave_id")


def start_lsn(last_lsn: Column) -> Column:
    """First LSN to be shipped: the one after the position, 0 for 2^64-1 or none."""
    at = last_lsn.cast("decimal(20,0)")
    return F.when(at.isNull() | (at >= dec(MAX_U64)), F.lit(0)).otherwise(at + 1).cast("decimal(20,0)")
