"""Processing only what is new: processed sequence numbers as disjoint intervals."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.sizing import broadcast_if_small
from tidelog.session import child_dirs, child_files, create_text, delete_path, read_text

BLOCK_BITS = 12
COMPACT_EVERY = 16
BLOCKS_BROADCAST = 100_000


def block_of(pos: Column, bits: int = BLOCK_BITS) -> Column:
    """The range of 2^bits consecutive positions in which ``pos`` lies: the unit of work, so none can grow hot."""
    return F.shiftright(pos, bits)


def to_intervals(points: DataFrame, scope: Sequence[str], pos: str = "pos", bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct positions as maximal intervals ``(*scope, block, lo, hi)``, disjoint and cut at block borders.

    One exchange. Positions that are null are ignored; copies count once; an empty input has no intervals.
    """
    part = [*scope, "block"]
    rows = points.where(F.col(pos).isNotNull()).select(*scope, F.col(pos).alias("pos"), block_of(F.col(pos), bits).alias("block"))
    rows = rows.repartition(*part).dropDuplicates([*part, "pos"])
    rank = F.row_number().over(W.partitionBy(*part).orderBy("pos"))
    islands = rows.select(*part, "pos", (F.col("pos") - rank).alias("island"))
    return islands.groupBy(*part, "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).drop("island")


def merge_intervals(intervals: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Union of intervals that may overlap or touch, as ``to_intervals`` gives them (cut at block borders)."""
    part = [*scope, "block"]
    w = W.partitionBy(*part).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    marked = intervals.select(*part, "lo", "hi", opens.alias("opens"))
    marked = marked.withColumn("island", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*part, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def unprocessed(
    available: DataFrame,
    consumers: DataFrame,
    processed: DataFrame,
    source: str = "master_id",
    consumer: str = "slave_id",
    bits: int = BLOCK_BITS,
    salts: int | None = None,
) -> DataFrame:
    """What each consumer still lacks of its source: ``(source, consumer, pos)``, each once.

    ``available``: (source, pos), in any order and with copies. ``consumers``: (source, consumer, position); all
    positions up to ``position`` are held to be processed, none if it is null. ``processed``: intervals
    (source, consumer, block, lo, hi) as of ``to_intervals``, which late commits may leave holes in.

    Available positions are grouped to blocks once and shuffled once, not once per consumer: consumers first meet
    the list of blocks (salted by as many numbers as the session has shuffle partitions, as one source may own most of them), then their intervals, and the block's
    positions join last. Within a block the intervals are expanded and subtracted as a set, in linear time.

    A null source or consumer matches nothing; null positions are ignored; a consumer of a source without records
    lacks nothing; extra columns are ignored.
    """
    salts = salts or max(16, int(available.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = (
        available.where(F.col("pos").isNotNull() & F.col(source).isNotNull())
        .select(source, F.col("pos"), block_of(F.col("pos"), bits).alias("block"))
        .groupBy(source, "block")
        .agg(F.collect_set("pos").alias("have"))
    )
    heads = blocks.select(source, "block", F.array_max("have").alias("top"), F.pmod("block", F.lit(salts)).cast("int").alias("salt"))
    held = consumers.groupBy(source, consumer).agg(F.max("position").alias("position"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    todo = heads.join(held, [source, "salt"]).where("position IS NULL OR top > position").select(source, consumer, "block", "position")
    done = processed.groupBy(source, consumer, "block").agg(F.collect_list(F.struct("lo", "hi")).alias("done"))
    todo = todo.join(done, [source, consumer, "block"], "left")
    gaps = todo.join(blocks, [source, "block"])
    ahead = F.when(F.col("position").isNull(), F.col("have")).otherwise(F.filter("have", lambda p: p > F.col("position")))
    expanded = F.flatten(F.transform("done", lambda i: F.sequence(i["lo"], i["hi"])))
    lacking = F.when(F.col("done").isNull(), ahead).otherwise(F.array_except(ahead, expanded))
    return gaps.select(source, consumer, F.explode(lacking).alias("pos"))


class IntervalLedger:
    """Committed runs in a shared folder: each holds its output and the intervals it has changed.

    A run works in a folder of its own and counts from the moment its commit file is there, which is written last and
    only if nobody else has committed that number: output and intervals appear together or not at all, a failed run leaves
    only a folder that nothing refers to (``vacuum``), and of two drivers at once one is told that it came too late.

    A run writes the intervals of the blocks it has touched, not those of all history; the latest run that wrote a block
    holds its intervals. Every ``compact_every`` runs all are written together, so that never more files than that are read.
    """

    def __init__(self, spark: SparkSession, path: str, scope: Sequence[str] = ("master_id", "slave_id"), compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.scope, self.compact_every = spark, path.rstrip("/"), list(scope), compact_every

    def _commits(self) -> dict[int, dict]:
        """Run number -> its folder and the run from which intervals have to be read."""
        out = {}
        for name in child_files(self.spark, f"{self.path}/commits"):
            text = read_text(self.spark, f"{self.path}/commits/{name}")
            if name.isdigit() and text.endswith("}"):
                out[int(name)] = json.loads(text)
        return out

    def last(self) -> int:
        """The number of the last committed run, -1 before the first."""
        return max(self._commits(), default=-1)

    def intervals(self, commits: dict[int, dict] | None = None) -> DataFrame:
        """All processed positions as intervals ``(*scope, block, lo, hi)``."""
        commits = self._commits() if commits is None else commits
        part = [*self.scope, "block"]
        if not commits:
            fields = ", ".join(f"{c} STRING" for c in self.scope)
            return self.spark.createDataFrame([], f"{fields}, block BIGINT, lo BIGINT, hi BIGINT")
        last = max(commits)
        read = [self.spark.read.parquet(f"{self.path}/runs/{commits[r]['run']}/intervals").withColumn("run", F.lit(r)) for r in range(commits[last]["since"], last + 1)]
        if len(read) == 1:
            return read[0].select(*part, "lo", "hi")
        rows = reduce(DataFrame.unionByName, read).groupBy(*part, "run").agg(F.collect_list(F.struct("lo", "hi")).alias("i"))
        return rows.groupBy(*part).agg(F.max_by("i", "run").alias("i")).select(*part, F.inline("i"))

    def output(self, run: int | None = None) -> DataFrame:
        """The rows of one committed run, by default the last."""
        commits = self._commits()
        return self.spark.read.parquet(f"{self.path}/runs/{commits[max(commits) if run is None else run]['run']}/output")

    def mark(self, points: DataFrame) -> int:
        """Commit positions ``(*scope, pos)`` that have been processed elsewhere; their output is empty."""
        return self._commit(points.select(*self.scope, "pos"), lambda df: df.where(F.lit(False)), self._commits())

    def run(self, available: DataFrame, consumers: DataFrame, work=lambda df: df) -> int:
        """Process what each consumer lacks, commit it with the merged intervals, and give the run's number."""
        commits = self._commits()
        source, consumer = self.scope
        here = available.where("pos IS NOT NULL").select(source, block_of(F.col("pos")).alias("block")).distinct()
        before = self.intervals(commits).join(broadcast_if_small(here, BLOCKS_BROADCAST), [source, "block"], "left_semi")
        return self._commit(unprocessed(available, consumers, before, source, consumer), work, commits)

    def _commit(self, positions: DataFrame, work, commits: dict[int, dict]) -> int:
        number, name = max(commits, default=-1) + 1, uuid.uuid4().hex
        at, part = f"{self.path}/runs/{name}", [*self.scope, "block"]
        positions.write.parquet(f"{at}/positions")
        new = self.spark.read.parquet(f"{at}/positions")
        work(new).write.parquet(f"{at}/output")
        fresh, before = to_intervals(new, self.scope), self.intervals(commits)
        since = commits[max(commits)]["since"] if commits else number
        if number - since >= self.compact_every:
            since = number
        if since < number:
            touched = new.select(*self.scope, block_of(F.col("pos")).alias("block")).distinct()
            touched = broadcast_if_small(touched.select(*(F.col(c).alias(f"t_{c}") for c in part)), BLOCKS_BROADCAST)
            before = before.join(touched, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in part], "left_semi")
        merge_intervals(before.unionByName(fresh), self.scope).write.parquet(f"{at}/intervals")
        try:
            create_text(self.spark, f"{self.path}/commits/{number}", json.dumps({"run": name, "since": since}))
        except FileExistsError:
            raise RuntimeError(f"run {number} has been committed by another driver meanwhile; what it processed is left alone, this run is void") from None
        return number

    def vacuum(self) -> int:
        """Delete what failed runs left behind, and the work files of runs whose intervals are no longer read; outputs stay.
        Only while no run is under way."""
        commits, gone = self._commits(), 0
        used = {c["run"]: n for n, c in commits.items()}
        since = commits[max(commits)]["since"] if commits else 0
        for name in child_dirs(self.spark, f"{self.path}/runs"):
            if name not in used:
                delete_path(self.spark, f"{self.path}/runs/{name}")
                gone += 1
            elif used[name] < since:
                for part in ("positions", "intervals"):
                    delete_path(self.spark, f"{self.path}/runs/{name}/{part}")
        return gone
