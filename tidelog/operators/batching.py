"""Group commit, per-batch counts and segment layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import BLOCK_BITS, Bytes, SizeOrTime, consecutive_groups, numbered, with_last


def batches_by_size(log: DataFrame, size: int, order: str = "lsn") -> DataFrame:
    """``log`` with ``batch_id``: every ``size`` consecutive records of the order form a batch."""
    return numbered(log, order).withColumn("batch_id", F.floor(F.col("place") / size)).drop("place")


def batches_by_size_or_time(log: DataFrame, size: int, wait_ms: int, order: str = "lsn", at_ms: str = "at_ms", scope: tuple[str, ...] = (), bits: int = BLOCK_BITS) -> DataFrame:
    """``log`` with ``batch_id``: a batch closes at ``size`` records or when ``wait_ms`` have passed since its first.

    ``scope`` names the writers, whose batches are numbered from 0 each; see ``consecutive_groups`` for how a writer's log is walked by many tasks.
    A null time closes no batch and a batch that begins with one is closed by size only. An empty log has no batches.
    """
    return consecutive_groups(log, SizeOrTime(size, wait_ms), order, at_ms, scope, "batch_id", bits)


def key_counts(batched: DataFrame) -> DataFrame:
    """``(batch_id, key, n)``: operations per key in each batch, the number every one of them is told."""
    return batched.groupBy("batch_id", "key").agg(F.count("*").alias("n"))


def pack_segments(batches: DataFrame, max_bytes: int, scope: tuple[str, ...] = (), bits: int = BLOCK_BITS) -> DataFrame:
    """``(*scope, batch_id, bytes, segment)``: a batch opens a new segment if the current one would reach ``max_bytes``.

    A batch is never split; the very first goes to segment 0 even if it is too large. Input: one row per batch with
    ``batch_id`` and ``bytes`` (null counts as 0), far fewer than records; they are folded by many tasks (``consecutive_groups``).
    """
    rows = batches.select(*scope, F.col("batch_id").cast("bigint"), F.col("bytes").cast("bigint"))
    return consecutive_groups(rows, Bytes(max_bytes), "batch_id", "bytes", scope, "segment", bits)


def segment_for(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(lsn, segment)``: the last segment that starts at or before ``lsn``; below the first, the first.

    Wanted LSNs and segment starts are merged in one sorted pass, so this is no range join: the
    last start seen so far is carried forward, block by block (``with_last``).
    ``manifest``: ``(segment, lsn_start)``, one row per segment file. Without segments the result is null.
    """
    marks = manifest.select(F.col("lsn_start").cast("bigint").alias("lsn"), F.col("segment"), F.lit(0).alias("kind"))
    asks = wanted.select(F.col("lsn").cast("bigint").alias("lsn"), F.lit(None).cast(manifest.schema["segment"].dataType).alias("segment"), F.lit(1).alias("kind"))
    first = manifest.agg(F.min(F.struct("lsn_start", "segment"))["segment"]).first()[0]
    met = with_last(marks.unionByName(asks), ["lsn", "kind", "segment"], F.col("segment"), "found").where("kind = 1")
    return met.select("lsn", F.coalesce("found", F.lit(first)).alias("segment"))
