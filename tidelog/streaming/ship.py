"""Shipping a log to a replica, batch by batch, and applying what arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.records import batch_error
from tidelog.operators.replication import SHIP_EVENTS, ship_batches
from tidelog.retry import LinearBackoff, connect
from tidelog.schema import SET
from tidelog.streaming.state import Replica

# JSON carries BINARY as base64, so that keys and values arrive byte by byte.
MESSAGE = "batch_id bigint, message string"
ENVELOPE = "struct<total:int, events:array<struct<lsn:bigint, cmdid:int, args:array<binary>>>>"


def ship(stream: DataFrame, inbox: str, checkpoint: str, last_lsn: int | None = None, size: int = SHIP_EVENTS) -> None:
    """Send what is new in a stream ``(lsn, command, key, value)`` to a replica's inbox, in messages of ``size`` events.

    The first run starts after ``last_lsn`` (None: from the beginning); later ones where the checkpoint stands, which
    moves on only when a batch's messages are complete. An attempt that is repeated replaces its own messages. An epoch
    without records sends nothing.
    """
    if last_lsn is not None:
        stream = stream.where(F.col("lsn") > last_lsn)
    key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
    args = F.when(F.col("command") == SET, F.array(key, value)).otherwise(F.array(key))

    def send(epoch: DataFrame, number: int) -> None:
        batches = ship_batches(epoch.select("lsn", "command", args.alias("arguments")), size)
        out = batches.select(F.lit(number << 32) + F.col("batch_id").alias("batch_id"), F.to_json(F.struct("total", "events")).alias("message"))
        out.toDF("batch_id", "message").write.mode("overwrite").parquet(f"{inbox.rstrip('/')}/epoch={number}")

    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def received(messages: DataFrame) -> DataFrame:
    """``(batch_id, error, lsn, command, key, value)``: the records of good messages; one row with ``error`` for a bad one.

    A message that cannot be parsed or breaks a rule is refused as a whole; what to do about it is the caller's choice.
    """
    parsed = messages.select("batch_id", F.from_json("message", ENVELOPE).alias("m"))
    error = F.when(F.col("m").isNull() | (F.col("m.total").isNull() & F.col("m.events").isNull()), F.lit("invalid message")).otherwise(
        batch_error(F.col("m.total"), F.col("m.events"))
    )
    checked = parsed.select("batch_id", error.alias("error"), "m")
    rows = checked.select("batch_id", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("m.events"))).alias("e"))
    key, value = F.get("e.args", F.lit(0)), F.get("e.args", F.lit(1))
    return rows.select("batch_id", "error", F.col("e.lsn").alias("lsn"), F.col("e.cmdid").alias("command"), key.alias("key"), value.alias("value"))


class Receiver:
    """A replica fed by its inbox. A refused message stops the stream before the epoch is applied: the next run meets it again, so that it
    cannot become a silent gap; ``skip_bad`` leaves it out instead."""

    def __init__(self, spark: SparkSession, inbox: str, path: str, skip_bad: bool = False):
        self.spark, self.inbox, self.skip_bad = spark, inbox.rstrip("/"), skip_bad
        self.replica = Replica(spark, path)

    def follow(self, reconnect: LinearBackoff | None = None) -> Receiver:
        """Take in what has arrived. ``reconnect``: go on from the checkpoint after a failure, waiting longer each time."""
        return connect(self._follow, reconnect) if reconnect else self._follow()

    def _follow(self) -> Receiver:
        stream = self.spark.readStream.schema(MESSAGE).parquet(f"{self.inbox}/epoch=*")
        rows = received(stream)
        if not self.skip_bad:
            why = F.concat(F.lit("refused message "), F.col("batch_id").cast("string"), F.lit(": "), F.col("error"))
            rows = rows.withColumn("lsn", F.when(F.col("error").isNotNull(), F.raise_error(why).cast("bigint")).otherwise(F.col("lsn")))
        self.replica.follow(rows.where("lsn IS NOT NULL"))
        return self

    def state(self) -> DataFrame:
        return self.replica.state()
