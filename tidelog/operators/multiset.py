"""Applying a change feed as a signed multiset of row images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN_ROWS = 500_000
BUCKETS = 1 << 16


def _images(changes: DataFrame, part: Sequence[str], pos: str, dead: str, payload: Sequence[str]) -> DataFrame:
    """Per change, its after-image (+1, at its own position) and before-image (-1, at its predecessor's), summed.

    Rows of the result: ``(*part, pos, dead, mult, closing, payload)``. Only images with a positive sum and the
    closing change of each chain remain, so a chain of any length becomes one row.
    """
    w = W.partitionBy(*part).orderBy(pos, dead)
    prev = F.lag(F.struct(pos, dead)).over(w)
    body = F.struct(*payload) if payload else F.lit(None).cast("boolean")
    chained = changes.select("*", prev.alias("__prev"), F.lead(F.lit(1)).over(w).isNull().alias("__last"))
    after = F.struct(F.col(pos), F.col(dead), F.col("__mult").alias("mult"), F.col("__last").alias("closing"), body.alias("payload"))
    before = F.struct(
        F.col(f"__prev.{pos}").alias(pos),
        F.lit(False).alias(dead),
        F.lit(-1).alias("mult"),
        F.lit(False).alias("closing"),
        F.when(F.lit(False), body).alias("payload"),
    )
    has_before = F.coalesce(~F.col(f"__prev.{dead}"), F.lit(False))
    images = chained.select(*part, F.inline(F.when(has_before, F.array(after, before)).otherwise(F.array(after))))
    summed = images.groupBy(*part, pos).agg(
        F.sum("mult").alias("__mult"),
        F.max("closing").alias("__closing"),
        F.coalesce(F.max(F.when(F.col("closing"), F.col(dead))), F.lit(False)).alias(dead),
        F.max("payload").alias("payload"),
    )
    return summed.where("__mult > 0 OR __closing")


def heavy_buckets(changes: DataFrame, keys: Sequence[str], n_rows: int, run_rows: int) -> tuple[Column, dict[int, int]]:
    """The bucket a key falls into, and the runs of each bucket that holds more changes than one task should.

    All changes are counted, map-side, into ``BUCKETS`` counters; a heavy key makes its bucket heavy. The threshold is
    ``run_rows``, or, where even a bucket of ordinary keys holds that many, four times the mean; so there are never more
    than a quarter as many heavy buckets as counters.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    most = max(run_rows, 4 * n_rows // BUCKETS)
    counts = changes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return bucket, {r.bucket: -(-r.n // run_rows) for r in counts.collect()}


def apply_changes(
    changes: DataFrame,
    keys: Sequence[str],
    pos: str,
    dead: Column,
    payload: Sequence[str] = (),
    base: DataFrame | None = None,
    n_rows: int | None = None,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Current rows after a feed of inserts, updates and deletes, given in any order and any number of copies.

    Every change contributes +1 for the row it leaves (none for a delete) and -1 for the row it finds, which is
    what the preceding change of its key left, or the key's row in ``base``. Multiplicities are summed with the
    base's (+1 each); rows above zero are the current state. Result: ``(*keys, pos, *payload)``.

    One exchange by key does for all keys but those with more than about ``run_rows`` changes (``heavy_buckets``, a count
    of every change; skipped if the feed has no more than that, as ``n_rows``, which need not be exact, says). Their changes
    are dealt to runs by position, summed within the run, and only what closes a run goes
    on to the key's own chain; so a key with a third of all changes never ends in one task. The sum does not depend on how
    changes fall to runs, since a run's closing image
    is cancelled by the before-image of the next closing change. Copies of one change share a position, hence a
    run, and are merged there.

    Edge cases: changes with a null key are applied to the key null; a null ``pos`` sorts first. Of different
    changes under one key and position a delete counts last, else the greater payload stays. ``base`` rows
    precede every change; several base rows of one key are reduced to the greatest payload. Extra columns of the
    inputs are ignored. Empty inputs give an empty result.
    """
    keys, payload = list(keys), list(payload)
    body = F.max(F.struct(*payload)).alias("__body") if payload else F.max(F.lit(None).cast("boolean")).alias("__body")
    carried = ["__body"] if payload else []
    rows = changes.select(*keys, pos, F.coalesce(dead, F.lit(False)).alias("__dead"), *payload)
    if n_rows is None:
        n_rows = rows.count()
    bucket, heavy = heavy_buckets(rows, keys, n_rows, run_rows) if n_rows > run_rows else (None, {})

    def images(df: DataFrame, part: list[str]) -> DataFrame:
        # One exchange: merging copies, chaining and summing all work on this partitioning.
        once = df.repartition(*part).groupBy(*part, pos, "__dead").agg(body)
        once = once.select(*part, pos, "__dead", F.when(F.col("__dead"), 0).otherwise(1).alias("__mult"), *carried)
        return _images(once, part, pos, "__dead", carried)

    def closing(df: DataFrame) -> DataFrame:
        return df.select(*keys, pos, "__dead", "__mult", *(F.col("payload.__body") for _ in carried))

    if heavy:
        is_heavy = bucket.isin(*heavy)
        dealt = rows.where(is_heavy).withColumn("__run", F.pmod(F.xxhash64(pos), F.lit(max(heavy.values()))).cast("int"))
        chained = _images(closing(images(dealt, [*keys, "__run"])), keys, pos, "__dead", carried)
        state = images(rows.where(~is_heavy), keys).unionByName(chained)
    else:
        state = images(rows, keys)
    if base is not None:
        b = base.select(*keys, *payload).groupBy(*keys).agg(body)
        b = b.select(*keys, F.lit(None).cast(rows.schema[pos].dataType).alias(pos), F.lit(False).alias("__dead"), F.lit(1).alias("__mult"), *carried)
        state = _images(b.unionByName(closing(state)), keys, pos, "__dead", carried)
    live = state.where("__mult > 0")
    return live.select(*keys, pos, *(F.col(f"payload.__body.{c}").alias(c) for c in payload))
