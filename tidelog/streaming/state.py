"""Keyed state kept up to date by a stream, and replicas fed by one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.schema import SET
from tidelog.session import child_dirs, delete_path, materialize, path_exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_changes(stream: DataFrame) -> DataFrame:
    """``(key, command, value, lsn)``, the latest change per key, deletes included, by native aggregation.

    A delete stays in the state with its LSN: without it a late, older SET would bring the key back. Correct for any
    lateness, as LSNs decide. Use in update mode (consumers upsert, or delete on command DEL) or complete mode.
    """
    return stream.groupBy("key").agg(F.max(F.struct("lsn", "command", "value")).alias("m")).select("key", "m.command", "m.value", "m.lsn")


class LatestChange(StatefulProcessor):
    """Emits a key's change whenever a later one than the last arrives; for consumers that want every step once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "lsn bigint, command int, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        old = best
        for f in rows:
            i = f["lsn"].idxmax()
            if best is None or int(f["lsn"][i]) > best[0]:
                best = (int(f["lsn"][i]), int(f["command"][i]), f["value"][i])
        if best is not old:
            self.last.update(best)
            yield pd.DataFrame({"key": [key[0]], "command": [best[1]], "value": [best[2]], "lsn": [best[0]]})

    def close(self) -> None:
        pass


def changes_as_they_come(stream: DataFrame) -> DataFrame:
    """``LatestChange`` over a stream; the session needs the RocksDB state store (``ROCKSDB``)."""
    return stream.groupBy("key").transformWithStateInPandas(
        LatestChange(), outputStructType="key string, command int, value string, lsn bigint", outputMode="Update", timeMode="None"
    )


class Replica:
    """A replica's table in a folder, fed by a stream of log records ``(lsn, command, key, value)``.

    An epoch writes only what it changes: the latest change per key among its records, named by the epoch; a repeated epoch
    replaces its own, so a failure in between neither skips nor repeats records. Every ``compact_every`` epochs all is folded into
    a base, after which what went into the base before it is deleted. The state is the fold of the last base and the
    epochs after it. Deletes are held too, as late older records must not undo them. Redelivered records change nothing.
    """

    def __init__(self, spark, path: str, compact_every: int = 8):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        self._empty = T.StructType().add("key", "string").add("value", "string")

    def _made(self, kind: str) -> list[int]:
        found = [int(n.partition("=")[2]) for n in child_dirs(self.spark, self.path) if n.startswith(f"{kind}=")]
        return sorted(n for n in found if path_exists(self.spark, f"{self.path}/{kind}={n}/_SUCCESS"))

    def _changes(self, before: int | None = None) -> DataFrame | None:
        """Folders that together hold the state as it was before an epoch, or now."""
        bases = [n for n in self._made("base") if before is None or n < before]
        since = bases[-1] if bases else -1
        paths = [f"{self.path}/base={since}"] * bool(bases) + [f"{self.path}/epoch={n}" for n in self._made("epoch") if n > since and (before is None or n < before)]
        return self.spark.read.parquet(*paths) if paths else None

    def _apply(self, epoch: DataFrame, number: int) -> None:
        rows = epoch.select(F.col("lsn").cast("bigint").alias("lsn"), F.col("command").cast("int").alias("command"), "key", "value")
        latest_changes(rows).write.mode("overwrite").parquet(f"{self.path}/epoch={number}")
        bases = self._made("base")
        if number - (bases[-1] if bases else -1) >= self.compact_every:
            latest_changes(self._changes()).write.mode("overwrite").parquet(f"{self.path}/base={number}")
            # A reader may still be at the last base and what followed it; what is older goes.
            for kind in ("base", "epoch"):
                for n in self._made(kind):
                    if bases and (n < bases[-1] or (n == bases[-1] and kind == "epoch")):
                        delete_path(self.spark, f"{self.path}/{kind}={n}")

    def follow(self, stream: DataFrame) -> "Replica":
        self._empty = stream.select("key", "value").schema
        q = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return self

    def state(self) -> DataFrame:
        changes = self._changes()
        if changes is None:
            return self.spark.createDataFrame([], T.StructType([*self._empty, T.StructField("lsn", T.LongType())]))
        return latest_changes(changes).where(F.col("command") == SET).select("key", "value", "lsn")


def run_once(result: DataFrame, checkpoint: str, mode: str) -> DataFrame:
    """What a streaming result comes to when everything available has been read, as a table."""
    out = []

    def keep(df: DataFrame, epoch: int) -> None:
        out.append(materialize(df.withColumn("epoch", F.lit(epoch)), "epoch"))

    q = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not out:
        return result.sparkSession.createDataFrame([], result.schema)
    if mode == "complete":
        return out[-1].drop("epoch")
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every
