"""What makes a log record, a batch or a handshake acceptable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.u64 import dec, to_pos
from tidelog.schema import DEL, MAX_U64, SET


def argument(arguments: Column, i: int) -> Column:
    return F.get(arguments, F.lit(i))


def applicable(lsn: Column, command: Column, arguments: Column) -> Column:
    """True for a SET with key and value or a DEL with a key, none null or empty; otherwise false, never null."""
    n = F.size(arguments)
    key, value = (F.octet_length(argument(arguments, i)) > 0 for i in (0, 1))
    ok = lsn.isNotNull() & (((command == SET) & (n == 2) & key & value) | ((command == DEL) & (n == 1) & key))
    return F.coalesce(ok, F.lit(False))


def record_error(lsn: Column, command: Column, arguments: Column) -> Column:
    """Why a record cannot be applied; null when it can."""
    n = F.size(arguments)
    empty_key = F.coalesce(F.octet_length(argument(arguments, 0)) == 0, F.lit(True))
    empty_value = F.coalesce(F.octet_length(argument(arguments, 1)) == 0, F.lit(True))
    return (
        F.when(lsn.isNull() | command.isNull(), F.lit("log entry is nil"))
        .when(F.coalesce(n, F.lit(-1)) <= 0, F.lit("log entry has no arguments"))
        .when((command == SET) & (n != 2), F.lit("invalid SET arguments"))
        .when((command == DEL) & (n != 1), F.lit("invalid DEL arguments"))
        .when(~command.isin(SET, DEL), F.lit("unknown command"))
        .when(empty_key, F.lit("key cannot be empty"))
        .when((command == SET) & empty_value, F.lit("value cannot be empty"))
    )


def log_changes(log: DataFrame, *, scope: tuple[str, ...] = ("master_id",)) -> DataFrame:
    """Applicable records as ``(*scope, pos, command, key, value)``; ``pos`` is the shifted LSN."""
    pos = to_pos(F.col("lsn"))
    return log.where(applicable(F.col("lsn"), F.col("command"), F.col("arguments"))).select(
        *scope,
        pos.alias("pos"),
        "command",
        argument(F.col("arguments"), 0).alias("key"),
        argument(F.col("arguments"), 1).alias("value"),
    ).where("pos IS NOT NULL")


def batch_error(total: Column, events: Column) -> Column:
    """First broken rule of a batch in the receiver's order of checks; null for a valid batch."""
    bad_args = F.exists(events, lambda e: F.coalesce(F.size(e["args"]), F.lit(0)) < 1)
    bad_cmd = F.exists(events, lambda e: F.coalesce(e["cmdid"], F.lit(-1)) < 0)
    return (
        F.when(F.coalesce(total, F.lit(0)) <= 0, F.lit("invalid total"))
        .when(F.coalesce(F.size(events), F.lit(0)) <= 0, F.lit("no events"))
        .when(F.size(events) > total, F.lit("more events than total"))
        .when(bad_args, F.lit("event without arguments"))
        .when(bad_cmd, F.lit("invalid command id"))
    )


def valid_batch(total: Column, events: Column) -> Column:
    return batch_error(total, events).isNull()


def _one_value(column: str) -> Column:
    """The column's text as VARIANT if it is exactly one JSON value, else null.

    The parser stops after the first value and ignores what follows. A text that also parses as the only
    element of an array and as the only member of an object has nothing following.
    """
    c = F.col(column)
    element = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    single = F.try_variant_get(element, "$[1]", "variant").isNull() & member.isNotNull()
    return F.when(single, F.try_variant_get(element, "$[0]", "variant"))


def handshakes(messages: DataFrame) -> DataFrame:
    """Parsed sync messages: input columns plus ``accepted``, ``slave``, ``pos`` (null: nothing applied yet), which replace any of these names.

    The whole text must be one JSON object. ``last_lsn`` is taken as the raw text of its JSON value, so quoted
    numbers, fractions and exponents are refused; so are anything beyond 2^64-1 and an object that names a member twice.
    """
    m = F.from_json("message", "last_lsn STRING, bad STRING", {"columnNameOfCorruptRecord": "bad"})
    v, r = _one_value("message"), _one_value("reply")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    digits = F.when(kind("$.last_lsn").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), m["last_lsn"])
    number = F.when(digits.rlike("^[0-9]{1,40}$"), F.regexp_replace(digits, "^0+(?=.)", ""))
    number = F.when(F.length(number) <= 20, number.try_cast("decimal(20,0)"))
    number = F.when(number <= dec(MAX_U64), number)
    status = F.try_variant_get(r, "$.status", "string")
    ok = (F.col("reply") == "OK") | ((F.schema_of_variant(r).startswith("OBJECT")) & (status == "OK"))
    whole = F.schema_of_variant(v).startswith("OBJECT") & m["bad"].isNull()
    good = whole & (text("$.type") == "lsn_sync") & (F.length(text("$.slave_id")) > 0) & number.isNotNull() & ok
    return messages.select(
        *(F.col(c) for c in messages.columns if c not in ("accepted", "slave", "pos")),
        F.coalesce(good, F.lit(False)).alias("accepted"),
        text("$.slave_id").alias("slave"),
        F.when(number < dec(MAX_U64), to_pos(number)).alias("pos"),
    )
