"""A keyed table over a log in a folder: get, set, delete, one at a time or in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import Config
from tidelog.errors import InvalidArgument, KeyNotFound, ReadOnly
from tidelog.functions.layout import shard_of
from tidelog.operators.state import assign_lsn, command_error, fold, multi_get, serve
from tidelog.schema import DEL, SET
from tidelog.session import materialize, path_exists
from tidelog.sources.manifest import greatest_lsn
from tidelog.sources.wal import SEGMENT_BYTES, LogAppender, register

COMMANDS = "seq bigint, command string, key binary, value binary"


class KvTable:
    """The log lies in the folder ``log``: as Parquet, one folder per append, partitioned by shard so that a lookup reads one
    shard's files; or, with ``log_format: wal``, in the binary segment format, where single sets and deletes are appended by the driver
    without a job.

    An append is visible when its write has committed; one writer at a time. The state is the fold of the log and is
    never stored unless ``compact`` is called. A lookup is a Spark job: look up many keys at once where it matters.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config.check()
        self._appender: LogAppender | None = None
        if self._wal:
            register(spark)

    @property
    def _wal(self) -> bool:
        return self.config.log_format == "wal"

    def log(self) -> DataFrame:
        """``(lsn, command, key, value, shard)`` of everything applied."""
        schema = "lsn bigint, command int, key binary, value binary, shard int"
        if not path_exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], schema)
        if not self._wal:
            return self.spark.read.schema(schema).parquet(f"{self.path}/log")
        rows = self.spark.read.format("wal").load(f"{self.path}/log")
        rows = rows.select(F.col("lsn").cast("bigint").alias("lsn"), "command", F.get("arguments", F.lit(0)).alias("key"), F.get("arguments", F.lit(1)).alias("value"))
        return rows.withColumn("shard", shard_of(F.col("key"), self.config.shards))

    def state(self) -> DataFrame:
        return fold(self.log())

    def last_lsn(self) -> int | None:
        """The greatest LSN, None for an empty log."""
        if self._wal:
            last = greatest_lsn(f"{self.path}/log")
            return None if last < 0 else last
        return self.log().agg(F.max("lsn")).first()[0]

    def apply(self, commands: DataFrame) -> DataFrame:
        """Append commands ``(seq, command, key, value)`` in the order of ``seq``; returns the refused ones with ``error``.

        Commands are checked before anything is written. SETs and DELs of the batch are applied or, if the write fails,
        none of them is. GETs are not logged (``serve`` answers them). A command whose frame would exceed the network's
        ``max_message_size`` is refused.
        """
        self._writable()
        size = F.octet_length("command") + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)) + 7
        long = F.when(size > self.config.network.max_message_size, F.lit("message too large"))
        checked = commands.withColumn("error", F.coalesce(command_error(F.col("command"), F.col("key"), F.col("value")), long))
        good = checked.where("error IS NULL AND command IN ('SET', 'DEL')")
        last = self.last_lsn()
        logged = assign_lsn(good, -1 if last is None else last)
        rows = logged.select(
            F.col("lsn").cast("bigint"),
            F.when(F.col("command") == "SET", SET).otherwise(DEL).alias("command"),
            F.col("key").cast("binary").alias("key"),
            F.when(F.col("command") == "SET", F.col("value").cast("binary")).alias("value"),
        )
        self._write(rows, self.path)
        return checked.where("error IS NOT NULL")

    def serve(self, commands: DataFrame) -> DataFrame:
        """Apply a batch and answer every command of it: ``(seq, command, key, error, value)``, as if they came one after the other."""
        commands = materialize(commands.select("seq", "command", "key", "value"), "commands")
        answers = materialize(serve(commands, self.state().select("key", "value"), self.config.refuses_writes), "answers")
        if not self.config.refuses_writes:
            refused = answers.where("error IS NOT NULL").select("seq")
            self.apply(commands.join(refused, "seq", "left_anti"))
        return answers

    def _write(self, rows: DataFrame, path: str) -> None:
        if self._wal:
            self._release()
            args = F.when(F.col("command") == SET, F.array("key", "value")).otherwise(F.array("key"))
            rows = rows.select(F.col("lsn").cast("decimal(20,0)").alias("lsn"), "command", args.alias("arguments"))
            c = self.config.wal
            options = {"segmentBytes": c.max_segment_size, "batchRecords": c.flush_batch_size} if c else {}
            rows.repartitionByRange("lsn").sortWithinPartitions("lsn").write.format("wal").mode("append").options(**options).save(f"{path}/log")
        else:
            rows = rows.withColumn("shard", shard_of(F.col("key"), self.config.shards))
            rows.repartition("shard").sortWithinPartitions("key", "lsn").write.mode("append").partitionBy("shard").parquet(f"{path}/log")

    def _writable(self) -> None:
        if self.config.refuses_writes:
            raise ReadOnly("This instance is in read-only mode")

    def _release(self) -> None:
        if self._appender:
            self._appender.close()
            self._appender = None

    def close(self) -> None:
        """Let go of the segment that single sets and deletes are appended to."""
        self._release()

    def _one(self, command: str, key: bytes, value: bytes | None) -> None:
        if not key:
            raise InvalidArgument("key cannot be empty")
        if command == "SET" and not value:
            raise InvalidArgument("value cannot be empty")
        if len(key) + len(value or b"") + len(command) + 7 > self.config.network.max_message_size:
            raise InvalidArgument("message too large")
        if not self._wal:
            self.apply(self.spark.createDataFrame([(0, command, bytearray(key), bytearray(value) if value else None)], COMMANDS))
            return
        self._writable()
        if self._appender is None:
            self._appender = LogAppender(f"{self.path}/log", self.config.wal.max_segment_size if self.config.wal else SEGMENT_BYTES)
        self._appender.append([(self._appender.next_lsn, SET, [key, value]) if command == "SET" else (self._appender.next_lsn, DEL, [key])])

    def set(self, key: bytes, value: bytes) -> None:
        self._one("SET", key, value)

    def delete(self, key: bytes) -> None:
        """Deleting a key that is not there succeeds."""
        self._one("DEL", key, None)

    def set_many(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Set ``(key, value)`` rows in one write; returns the refused ones with ``error``. Of several rows of one key the last by ``order`` stays
        (without one, any)."""
        return self._many("SET", rows, order)

    def delete_many(self, rows: DataFrame) -> DataFrame:
        """Delete the keys of a DataFrame in one write; returns the refused rows with ``error``."""
        return self._many("DEL", rows.select("key", F.lit(None).cast("binary").alias("value")), None)

    def _many(self, command: str, rows: DataFrame, order: str | None) -> DataFrame:
        seq = F.col(order) if order else F.monotonically_increasing_id()
        commands = rows.select(seq.alias("seq"), F.lit(command).alias("command"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        # An empty key is refused for deletes too, as it is one at a time.
        commands = materialize(commands, "commands")
        empty = commands.where("coalesce(octet_length(key), 0) = 0")
        refused = self.apply(commands.where("octet_length(key) > 0"))
        return refused.unionByName(empty.withColumn("error", F.lit("key cannot be empty"))).select("key", "value", "error")

    def get(self, key: bytes) -> bytes:
        if not key:
            raise InvalidArgument("key cannot be empty")
        wanted = F.lit(bytearray(key))
        found = fold(self.log().where((F.col("shard") == shard_of(wanted, self.config.shards)) & (F.col("key") == wanted))).first()
        if found is None:
            raise KeyNotFound(key)
        return bytes(found.value)

    def get_many(self, keys: DataFrame) -> DataFrame:
        """``(key, found, value)`` for every distinct key of a DataFrame."""
        return multi_get(self.log(), keys)

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    def compact(self, to: str) -> "KvTable":
        """A new table whose log is this one's live records alone, with their LSNs (extension).

        The very last record stays even if it is a DEL, so that no LSN is given out twice.
        """
        rows = self.state().select("lsn", F.lit(SET).alias("command"), "key", "value")
        last = self.log().where((F.col("command") == DEL) & (F.col("lsn") == F.lit(self.last_lsn())))
        rows = rows.unionByName(last.select(*rows.columns))
        out = KvTable(self.spark, to, self.config)
        out._write(rows, out.path)
        return out
