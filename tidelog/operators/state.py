"""Keyed state as a fold of the log: lookups, validation, time travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered, with_last, with_next
from tidelog.schema import DEL, GET, SET


def fold(log: DataFrame, order: str | list[str] = "lsn", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Latest value per key ``(*keys, value, lsn)``: the change greatest by ``order`` wins, a DEL drops the key.

    One exchange on the keys after map-side combining, so arrival order, repeats and a hot key do no harm. Ties in
    ``order`` go to the greater (command, value). Rows with a null key form the key null; an empty log has no state.
    """
    order = [order] if isinstance(order, str) else list(order)
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, "command", "value", F.col("lsn").alias("at"))).alias("last"))
    return last.where(F.col("last.command") == SET).select(*keys, F.col("last.value").alias("value"), F.col("last.at").alias("lsn"))


def point_get(log: DataFrame, key) -> DataFrame:
    """The state of one key; the equality reaches the scan below the fold."""
    return fold(log.where(F.col("key") == F.lit(key)))


def multi_get(log: DataFrame, requested: DataFrame) -> DataFrame:
    """``(key, found, value)`` for each distinct requested key; a missing key is a row with ``found`` false."""
    wanted = requested.select("key").distinct()
    state = fold(log.join(wanted, "key", "left_semi"))
    return wanted.join(state, "key", "left").select("key", F.col("lsn").isNotNull().alias("found"), "value")


def command_error(command: Column, key: Column, value: Column) -> Column:
    """Why a command is refused, null if it is not: names are case-sensitive, GET and DEL take no value."""
    has_value = F.coalesce(F.octet_length(value) > 0, F.lit(False))
    return (
        F.when(F.coalesce(F.octet_length(command), F.lit(0)) == 0, F.lit("empty command"))
        .when(~command.isin("SET", "GET", "DEL"), F.lit("unknown command"))
        .when((command == "SET") & ~has_value, F.lit("invalid arguments number"))
        .when((command != "SET") & has_value, F.lit("invalid arguments number"))
        .when((command == "SET") & (F.coalesce(F.octet_length(key), F.lit(0)) == 0), F.lit("key cannot be empty"))
    )


def command_id(command: Column) -> Column:
    return F.when(command == "SET", SET).when(command == "GET", GET).when(command == "DEL", DEL).otherwise(0)


def gate(commands: DataFrame, read_only: bool) -> DataFrame:
    """Commands with ``error``: the parser's, or that of a replica to which something was to be written."""
    refused = F.when(F.lit(read_only) & F.col("command").isin("SET", "DEL"), F.lit("This instance is in read-only mode"))
    return commands.withColumn("error", F.coalesce(command_error(F.col("command"), F.col("key"), F.col("value")), refused))


def serve(commands: DataFrame, held: DataFrame, read_only: bool = False) -> DataFrame:
    """``(seq, command, key, error, value)``: the answer to every command of a batch ``(seq, command, key, value)``, as if served one after the other.

    ``held`` is the state before, ``(key, value)``. A GET sees what the batch wrote before it: refused commands write nothing, a
    missing key is ``key not found``. SET and DEL have neither error nor value if they are done. Commands on one key are
    followed along blocks of the order (``with_last``), so a hot key is not one task. ``seq`` is not null and unique.
    """
    names = ["seq", "command", "key", "value", "error"]
    checked = gate(commands, read_only).select(*names)
    kinds = {f.name: f.dataType for f in checked.schema}
    before = held.select(F.lit(None).cast(kinds["seq"]).alias("seq"), F.lit("SET").alias("command"), F.col("key").cast(kinds["key"]), F.col("value").cast(kinds["value"]), F.lit(None).cast("string").alias("error"))
    every = before.unionByName(checked)
    wrote = F.when(F.col("error").isNull() & F.col("command").isin("SET", "DEL"), F.struct("key", F.when(F.col("command") == "SET", F.col("value")).alias("value")))
    told = with_last(every, ["key", "seq"], wrote).where("seq IS NOT NULL")
    mine = F.when(F.col("last.key").eqNullSafe(F.col("key")), F.col("last.value"))
    asks = F.col("error").isNull() & (F.col("command") == "GET")
    error = F.coalesce("error", F.when(asks & mine.isNull(), F.lit("key not found")))
    return told.select("seq", "command", "key", error.alias("error"), F.when(asks, mine).alias("value"))


def assign_lsn(commands: DataFrame, last: int, order: str = "seq") -> DataFrame:
    """Dense LSNs after ``last`` in the order of ``order``, without sorting everything in one task."""
    return numbered(commands, order, "lsn", last + 1)


def as_of(log: DataFrame, lsn: int) -> DataFrame:
    """The state as it was when ``lsn`` had been applied (extension)."""
    return fold(log.where(F.col("lsn") <= lsn))


def history(log: DataFrame) -> DataFrame:
    """Every value with the LSNs from which and until which it held (extension); one row per SET. A hot key's records are spread over tasks."""
    placed = with_next(log, ["key", "lsn", "command"], ["key", "lsn"])
    until = F.when(F.col("next.key").eqNullSafe(F.col("key")), F.col("next.lsn"))
    return placed.where(F.col("command") == SET).select("key", "value", F.col("lsn").alias("since"), until.alias("until"))


def lsn_gaps(log: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Missing stretches ``(*scope, after, before, missing)`` of a log (extension). Null LSNs are ignored; repeats count once."""
    seen = log.where("lsn IS NOT NULL").select(*scope, "lsn").distinct()
    placed = with_next(seen, [*scope, "lsn"], [*scope, "lsn"])
    same = F.lit(True)
    for c in scope:
        same = same & F.col(f"next.{c}").eqNullSafe(F.col(c))
    gaps = placed.where(same & (F.col("next.lsn") - F.col("lsn") > 1))
    return gaps.select(*scope, F.col("lsn").alias("after"), F.col("next.lsn").alias("before"), (F.col("next.lsn") - F.col("lsn") - 1).alias("missing"))


def last_lsn_in(log: DataFrame) -> DataFrame:
    """``(segment, records, first_lsn, last_lsn)``: LSN of the first and of the last record of each segment as it lies in the
    file, by ``ordinal``; not the least and the greatest."""
    return log.groupBy("segment").agg(F.count("lsn").alias("records"), F.min_by("lsn", "ordinal").alias("first_lsn"), F.max_by("lsn", "ordinal").alias("last_lsn"))


def dead_records(log: DataFrame, min_replica_lsn: int) -> DataFrame:
    """Per segment, records that compaction could drop: overwritten, and at or below every replica's position (extension).

    Records are first reduced to one state per key and segment; only states meet under a key, so a hot key costs no
    more than it has segments. LSNs are unique.
    """
    low = F.count_if(F.col("lsn") <= min_replica_lsn)
    states = log.groupBy("key", "segment").agg(F.count("*").alias("records"), low.alias("low"), F.max("lsn").alias("top"))
    live = F.max("top").over(W.partitionBy("key"))
    kept = ((F.col("top") == live) & (F.col("top") <= min_replica_lsn)).cast("bigint")
    dead = states.withColumn("dead", F.col("low") - kept)
    return dead.groupBy("segment").agg(F.sum("records").alias("records"), F.sum("dead").alias("dead"))
