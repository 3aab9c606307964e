"""Exactly one copy of each message out of at-least-once delivery."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.records import valid_batch
from tidelog.functions.u64 import to_pos
from tidelog.operators.sizing import broadcast_if_small
from tidelog.session import child_dirs, delete_path, make_dir, path_exists, rename_path, shared_dir, stream_path

BLOCK_BITS = 16
HORIZON = "6 hours"
BYTES_PER_TRIGGER, BYTES_PER_CORE = 512 << 20, 64 << 20
LATE_BROADCAST = 200_000
PRUNED_BLOCKS = 200
NO_BATCH_ID = 2**63 - 1
CHUNK_EVENTS = 1024
EMPTY_EPOCHS = "spark.sql.streaming.noDataMicroBatches.enabled"

NAME = ["master_id", "slave_id", "pos"]
LEDGER = "master_id string, slave_id string, pos bigint, batch_id bigint, event_pos bigint"
OUTCOME = "master_id string, slave_id string, block bigint, outcome string, pos array<bigint>, batch_id array<bigint>, event_pos array<bigint>"
STATE = "seen binary, expired boolean"


def _first_copies(held: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows are (pos, batch, place). The least copy of each pos; the new ones among them; all copies that lost now.

    A copy at the very place of another is that copy read again, not a second one.
    """
    both = np.concatenate([held, new])
    fresh = np.arange(len(both)) >= len(held)
    order = np.lexsort((fresh, both[:, 2], both[:, 1], both[:, 0]))
    both, fresh = both[order], fresh[order]
    again = np.zeros(len(both), bool)
    again[1:] = (both[1:] == both[:-1]).all(axis=1)
    both, fresh = both[~again], fresh[~again]
    first = np.ones(len(both), bool)
    first[1:] = both[1:, 0] != both[:-1, 0]
    # Of the copies held before, only the least is in the state; it was the kept one until now.
    return both[first], both[first & fresh], both[~first]


def _track(horizon_ms: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # The identifiers go, the mark stays: what comes to this block later is looked up in the ledger.
            state.update((None, True))
            return
        seen, expired = state.get if state.exists else (None, False)
        held = np.frombuffer(seen, np.int64).reshape(-1, 3) if seen else np.zeros((0, 3), np.int64)
        parts, latest = [], 0
        for f in frames:
            sizes = [len(x) for x in f["pos"]]
            parts.append(np.stack([np.concatenate(f["pos"].to_numpy()), np.repeat(f["batch_id"].to_numpy(np.int64), sizes), np.concatenate(f["event_pos"].to_numpy())], axis=1))
            latest = max(latest, int(f["at_ms"].to_numpy().max()))
        kept, new, lost = _first_copies(held, np.concatenate(parts))
        state.update((kept.tobytes(), bool(expired)))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + horizon_ms)
        outcomes = [(rows, o) for rows, o in ((new, "check" if expired else "kept"), (lost, "surplus")) if len(rows)]
        if outcomes:
            master, slave, block = key
            columns = {c: [rows[:, i] for rows, _ in outcomes] for i, c in enumerate(("pos", "batch_id", "event_pos"))}
            yield pd.DataFrame({"master_id": master, "slave_id": slave, "block": block, "outcome": [o for _, o in outcomes], **columns})

    return update


class Deduplicator:
    """A stream of ``LogBatch`` messages, of whose events ``(master, slave, lsn)`` each is kept once.

    Identifiers are held in the keyed state store, one state per 2^16 consecutive LSNs of a replica (so a busy
    replica is spread and a state stays small), and expire by event-time watermark: a state goes when the
    watermark has passed its last event by ``horizon``, leaving a one-bit mark. Copies that come to an
    expired block, however late, are checked against the ledger of what was kept before; the stream's filter for
    late rows is not used, so none is lost (``run`` fails if the engine ever reports one as dropped).

    Of all copies the one with the smallest ``(batch_id, event_pos)`` is the one kept, in whatever order files
    arrive: a smaller copy that comes later makes the earlier choice surplus. Every epoch writes its outcome to
    its own folders, replacing what an interrupted attempt left, and the state's checkpoint follows; so output
    and state agree after any failure.

    The ledger lies below ``ledger/outcome=.../slot=.../epoch=...``. A slot is a share of all (replica, block) pairs, the
    same share that one task of the stream holds the states of, so a task writes one file per epoch and outcome. The
    late lookup opens only the slots that late copies fall into, and skips row groups by ``pos``. ``compact`` merges the files of
    all epochs, slot by slot.

    Batches that are not valid, and events without an LSN in the unsigned 64-bit range, are left out. A null
    ``sent_at`` says nothing about time: such events take the watermark as it is. Null master or slave ids
    identify like other values. A null ``batch_id`` counts as greater than all others. The same place of the same batch
    read twice (a repeated row) is one copy. Extra columns are ignored. An empty input keeps nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, horizon: str = HORIZON, bits: int = BLOCK_BITS, files_per_trigger: int | None = None, bytes_per_trigger: int | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "dedup")
        self.horizon, self.bits = horizon, bits
        # An epoch takes so much of the input; more at once saves commits and files, less bounds what a failure repeats.
        bytes_per_trigger = bytes_per_trigger or max(BYTES_PER_TRIGGER, BYTES_PER_CORE * spark.sparkContext.defaultParallelism)
        self.pace = {"maxFilesPerTrigger": str(files_per_trigger)} if files_per_trigger else {"maxBytesPerTrigger": str(bytes_per_trigger)}
        self.horizon_ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
        self._repair()
        # How many slots and how wide a block: fixed by the first run, whatever the session says later.
        found = [n.split("-") for n in child_dirs(spark, self.path) if n.startswith("slots-")]
        if found:
            self.slots, self.bits = int(found[0][1]), int(found[0][2])
        else:
            self.slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
            make_dir(spark, f"{self.path}/slots-{self.slots}-{self.bits}")

    def _slot(self) -> Column:
        return F.pmod(F.hash("master_id", "slave_id", "block"), F.lit(self.slots)).alias("slot")

    def events(self, batches: DataFrame) -> DataFrame:
        """Usable events, those of one batch and block packed into arrays: a batch is a row or two on its way to the state.

        Of a batch with more than ``CHUNK_EVENTS`` events each so many are packed apart, so that no row grows large.
        """
        good = batches.where(valid_batch(F.col("total"), F.col("events")))
        chunks = good.select(
            "master_id", "slave_id", F.coalesce("batch_id", F.lit(NO_BATCH_ID)).alias("batch_id"), F.col("sent_at").cast("timestamp").alias("sent_at"), "events",
            F.explode(F.sequence(F.lit(0), F.size("events") - 1, F.lit(CHUNK_EVENTS))).alias("start"),
        )
        place = lambda e, i: F.struct(to_pos(e["lsn"]).alias("pos"), (i + F.col("start")).cast("bigint").alias("event_pos"))
        placed = F.filter(F.transform(F.slice("events", F.col("start") + 1, CHUNK_EVENTS), place), lambda e: e["pos"].isNotNull())
        placed = chunks.select("master_id", "slave_id", "batch_id", "sent_at", placed.alias("e"))
        block = lambda e: F.shiftright(e["pos"], self.bits)
        split = placed.select("*", F.explode(F.array_distinct(F.transform("e", block))).alias("block"))
        mine = split.select("master_id", "slave_id", "batch_id", "sent_at", "block", F.filter("e", lambda e: block(e) == F.col("block")).alias("e"))
        return mine.select("master_id", "slave_id", "batch_id", "sent_at", "block", F.col("e.pos").alias("pos"), F.col("e.event_pos").alias("event_pos"))

    def _write(self, rows: DataFrame, number: int, step: int) -> None:
        rows = rows.select("*", self._slot(), F.lit(number).alias("epoch"), F.lit(step).alias("step")).drop("block")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "slot", "epoch", "step").parquet(f"{self.path}/ledger")

    def _resolve(self, epoch: DataFrame, number: int) -> None:
        self._settle(epoch.select("master_id", "slave_id", "block", "outcome", F.inline(F.arrays_zip("pos", "batch_id", "event_pos"))), number)

    def _settle(self, outcomes: DataFrame, number: int) -> None:
        self._write(outcomes, number, 0)
        late = self._rows("check").where(F.col("epoch") == number)
        slots = [r.slot for r in late.select("slot").distinct().collect()]
        if not slots:
            return
        late = late.select(*NAME, "batch_id", "event_pos", F.shiftright("pos", self.bits).alias("block"))
        blocks = [r.block for r in late.select("block").distinct().limit(PRUNED_BLOCKS + 1).collect()]
        known = self._rows("kept", slots).where(F.col("epoch") < number)
        if len(blocks) <= PRUNED_BLOCKS:
            size = 1 << self.bits
            known = known.where(reduce(Column.__or__, (F.col("pos").between(b * size, b * size + size - 1) for b in blocks)))
        # Null ids are ids like others: every comparison here must be null-safe.
        wanted = broadcast_if_small(late.select(*(F.col(c).alias(f"late_{c}") for c in NAME)).distinct(), LATE_BROADCAST)
        known = known.join(wanted, [F.col(c).eqNullSafe(F.col(f"late_{c}")) for c in NAME], "left_semi")
        known = known.groupBy(*NAME).agg(F.min(F.struct("batch_id", "event_pos")).alias("known"))
        met = late.join(known, [late[c].eqNullSafe(known[c]) for c in NAME], "left").select(*(late[c] for c in [*NAME, "batch_id", "event_pos", "block"]), "known")
        mine = F.struct("batch_id", "event_pos")
        pick = lambda s, o: F.struct(s["batch_id"].alias("batch_id"), s["event_pos"].alias("event_pos"), F.lit(o).alias("outcome"))
        ruling = (
            F.when(F.col("known").isNull(), F.array(pick(mine, "kept")))
            .when(F.col("known") < mine, F.array(pick(mine, "surplus")))
            .when(F.col("known") > mine, F.array(pick(mine, "kept"), pick(F.col("known"), "surplus")))
        )
        self._write(met.select(*NAME, "block", F.inline(ruling)), number, 1)

    def _rows(self, outcome: str, slots: list[int] | None = None) -> DataFrame:
        """Ledger rows of an outcome, ``(LEDGER, slot, epoch)``, of the given slots or of all."""
        ledger = f"{self.path}/ledger"
        schema = f"{LEDGER}, slot int, epoch int"
        if f"outcome={outcome}" not in child_dirs(self.spark, ledger):
            return self.spark.createDataFrame([], schema)
        there = child_dirs(self.spark, at := f"{ledger}/outcome={outcome}")
        paths = [at] if slots is None else [f"{at}/slot={s}" for s in slots if f"slot={s}" in there]
        read = self.spark.read.schema(f"{schema}, outcome string, step int").option("basePath", ledger)
        return read.parquet(*paths).drop("outcome", "step") if paths else self.spark.createDataFrame([], schema)

    def run(self, source: str) -> "Deduplicator":
        """Take in what is new at ``source`` (a Parquet file or folder of batches) and stop; call again for more."""
        schema = self.spark.read.parquet(source).schema
        stream = self.spark.readStream.schema(schema).options(**self.pace).parquet(stream_path(self.spark, source))
        rows = self.events(stream).withWatermark("sent_at", "0 seconds")
        # Late rows must reach the state. The watermark has seen the true event times above; below, the column that
        # carries its mark is null, which the filter for late rows lets pass, and the time goes on as a number.
        rows = rows.select(
            "master_id", "slave_id", "batch_id", "event_pos", "pos", "block",
            F.coalesce(F.unix_millis("sent_at"), F.lit(0)).alias("at_ms"),
            F.lit(None).cast("timestamp").alias("clock", metadata={"spark.watermarkDelayMs": 0}),
        )
        tracked = rows.groupBy("master_id", "slave_id", "block").applyInPandasWithState(
            _track(self.horizon_ms), OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
        # States expire along with the next rows that come; an epoch of its own, without rows, would have to go through all of them.
        before = self.spark.conf.get(EMPTY_EPOCHS)
        self.spark.conf.set(EMPTY_EPOCHS, "false")
        try:
            query = (
                tracked.writeStream.foreachBatch(self._resolve)
                .option("checkpointLocation", f"{self.path}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
        finally:
            self.spark.conf.set(EMPTY_EPOCHS, before)
        dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
        if dropped:
            raise RuntimeError(f"the engine dropped {dropped} late rows, which must reach the state")
        return self

    def compact(self) -> "Deduplicator":
        """Merge the ledger's files, those of one slot into one or a few; between runs only. The old ledger goes when the new one is whole."""
        ledger, new, old = (f"{self.path}/{n}" for n in ("ledger", "ledger-new", "ledger-old"))
        if not path_exists(self.spark, ledger):
            return self
        rows = self.spark.read.parquet(ledger)
        last = rows.agg(F.max("epoch")).first()[0]
        rows = rows.where("outcome <> 'check'").withColumn("epoch", F.lit(last)).withColumn("step", F.lit(2)).repartition("outcome", "slot").sortWithinPartitions("outcome", "slot", *NAME)
        rows.write.mode("overwrite").partitionBy("outcome", "slot", "epoch", "step").parquet(new)
        rename_path(self.spark, ledger, old)
        self._repair()
        return self

    def _repair(self) -> None:
        """Finish a compaction that was interrupted between its renames."""
        ledger, new, old = (f"{self.path}/{n}" for n in ("ledger", "ledger-new", "ledger-old"))
        if path_exists(self.spark, old):
            if not path_exists(self.spark, ledger):
                rename_path(self.spark, new, ledger)
            delete_path(self.spark, old)

    def surplus(self) -> DataFrame:
        """``(master_id, slave_id, pos, batch_id, event_pos)`` of every copy but the first."""
        return self._given(self._rows("surplus").drop("slot", "epoch").distinct())

    def kept(self) -> DataFrame:
        """The one copy of each event, choices that a smaller copy overtook left out."""
        lost = self._rows("surplus").select("batch_id", "event_pos", *(F.col(c).alias(f"lost_{c}") for c in NAME))
        kept = self._rows("kept").drop("slot", "epoch")
        same = [kept["batch_id"] == lost["batch_id"], kept["event_pos"] == lost["event_pos"], *(kept[c].eqNullSafe(lost[f"lost_{c}"]) for c in NAME)]
        return self._given(kept.join(lost, same, "left_anti"))

    @staticmethod
    def _given(rows: DataFrame) -> DataFrame:
        return rows.withColumn("batch_id", F.nullif("batch_id", F.lit(NO_BATCH_ID)))
