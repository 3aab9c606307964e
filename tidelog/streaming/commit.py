"""Group commit of a stream of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered
from tidelog.operators.state import command_error
from tidelog.schema import DEL, SET
from tidelog.session import child_dirs, path_exists
from tidelog.sources.wal import register

BATCH_RECORDS = 100


class GroupCommit:
    """Writes a stream of commands ``(seq, command, key, value)`` to a binary log, in batches, and tells each command its batch's outcome.

    What an epoch brings is put in the order of ``seq``, numbered with LSNs after the last and cut into batches of ``size`` commands,
    of which only the last may be smaller: it closes with the epoch, as a batch closes with its timer (the trigger's interval).
    Every command is told its LSN, its batch and how many commands of that batch had its key.

    The numbered commands of an epoch are settled in a table first and then go to the log. An epoch that is repeated after a
    failure finds them there and writes the same records under the same LSNs again, which a replay does not mind; so no command
    is lost, and none gets two LSNs. Refused commands and GETs are not logged; refused ones are in ``refused``.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = BATCH_RECORDS):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size
        register(spark)

    def _settled(self) -> list[int]:
        found = [int(n[6:]) for n in child_dirs(self.spark, f"{self.path}/settled") if n.startswith("epoch=")]
        return sorted(n for n in found if path_exists(self.spark, f"{self.path}/settled/epoch={n}/_SUCCESS"))

    def _commit(self, epoch: DataFrame, number: int) -> None:
        at = f"{self.path}/settled/epoch={number}"
        if number not in (known := self._settled()):
            last, batch = -1, -1
            if before := [n for n in known if n < number]:
                top = self.spark.read.parquet(*(f"{self.path}/settled/epoch={n}" for n in before)).agg(F.max("lsn"), F.max("batch_id")).first()
                last, batch = (-1 if x is None else x for x in top)
            error = command_error(F.col("command"), F.col("key"), F.col("value"))
            checked = epoch.select("seq", "command", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), error.alias("error"))
            checked.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{self.path}/refused/epoch={number}")
            good = numbered(checked.where("error IS NULL AND command IN ('SET', 'DEL')").drop("error"), "seq", "place")
            batches = F.lit(batch + 1) + F.floor(F.col("place") / self.size)
            good.select("seq", (F.col("place") + last + 1).alias("lsn"), batches.cast("bigint").alias("batch_id"), "command", "key", "value").write.mode("overwrite").parquet(at)
        rows = self.spark.read.parquet(at)
        key, value = F.col("key"), F.col("value")
        kind = F.when(F.col("command") == "SET", SET).otherwise(DEL).alias("command")
        args = F.when(F.col("command") == "SET", F.array(key, value)).otherwise(F.array(key))
        log = rows.select(F.col("lsn").cast("decimal(20,0)").alias("lsn"), kind, args.alias("arguments"))
        log.repartitionByRange("lsn").sortWithinPartitions("lsn").write.format("wal").mode("append").option("batchRecords", self.size).save(f"{self.path}/log")

    def follow(self, stream: DataFrame) -> GroupCommit:
        """Commit what is new in the stream and stop."""
        q = stream.writeStream.foreachBatch(self._commit).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return self

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in child_dirs(self.spark, f"{self.path}/{kind}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def told(self) -> DataFrame:
        """``(seq, lsn, batch_id, key, n)``: what each logged command is told; ``n`` is the number of its batch's commands with its key."""
        rows = self._read("settled", "seq bigint, lsn bigint, batch_id bigint, command string, key binary, value binary")
        counts = rows.groupBy("batch_id", "key").agg(F.count("*").alias("n"))
        return rows.join(counts, ["batch_id", "key"]).select("seq", "lsn", "batch_id", "key", "n")

    def refused(self) -> DataFrame:
        """``(seq, error)`` of the commands that were not accepted."""
        return self._read("refused", "seq bigint, command string, key binary, value binary, error string").select("seq", "error")
