"""Sizes, hashes and wire layouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(key: Column) -> Column:
    """FNV-1a (32 bits) of a BINARY column as BIGINT; null for null, the offset basis for an empty key."""
    digits = F.hex(key)
    steps = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key) * 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")
    mix = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(key.isNotNull(), F.aggregate(steps, F.lit(FNV_OFFSET).cast("bigint"), mix))


def shard_of(key: Column, shards: int) -> Column:
    """The shard in which a key lies: FNV-1a modulo the number of shards, which is a property of the table."""
    return (fnv1a(key) % shards).cast("int")


def uvarint_length(n: Column) -> Column:
    """Bytes of a non-negative number as LEB128 varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n.cast("bigint"))) / 7)).cast("int")


def record_length(lsn: Column, command: Column, arguments: Column) -> Column:
    """Bytes of a log record in a segment file."""
    sizes = F.transform(arguments, lambda a: uvarint_length(F.octet_length(a)) + F.octet_length(a))
    body = F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    return uvarint_length(lsn) + uvarint_length(command) + uvarint_length(F.size(arguments)) + body


def _be(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * width, "0"))


def command_frame(command: Column, key: Column, value: Column) -> Column:
    """A command as it goes over the wire: u8 length, name, u16 length, key, u32 length, value.

    A name or key too long for its length field is an error, as it is in ``codec.encode_command``. A null value is an empty one;
    a null name or key gives null.
    """
    value = F.coalesce(value, F.unhex(F.lit("")))
    frame = F.concat(
        _be(F.octet_length(command), 1), command.cast("binary"), _be(F.octet_length(key), 2), key, _be(F.octet_length(value), 4), value
    )
    long = F.when(F.octet_length(command) >= 2**8, F.raise_error("command too long").cast("binary")).when(F.octet_length(key) >= 2**16, F.raise_error("key too long").cast("binary"))
    return F.coalesce(long, frame)


def _u(data: Column, at: Column, width: int) -> Column:
    """The big-endian number of ``width`` bytes at 1-based ``at``."""
    return F.conv(F.hex(F.substring(data, at, F.lit(width))), 16, 10).cast("bigint")


def parse_frame(data: Column) -> Column:
    """A command frame as ``struct(error, command, key, value)``; what follows the value is ignored.

    ``error``, null for a good frame, is the first of: empty command, invalid protocol format (lengths that do not fit, no
    name), unknown command, invalid arguments number (SET without a value, or another command with one). ``value`` is null
    for commands without; key and value are null in a frame with an error. A null frame is an empty one.
    """
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint")
    n_name = F.when(size >= 1, _u(data, F.lit(1), 1))
    name = F.substring(data, F.lit(2), n_name.cast("int")).cast("string")
    key_at = n_name + 2
    n_key = F.when(size >= key_at + 1, _u(data, key_at.cast("int"), 2))
    value_at = key_at + 2 + n_key
    n_value = F.when(size >= value_at + 3, _u(data, value_at.cast("int"), 4))
    fits = F.coalesce(value_at + 3 + n_value <= size, F.lit(False))
    error = (
        F.when(size == 0, F.lit("empty command"))
        .when((n_name == 0) | (n_name + 1 > size), F.lit("invalid protocol format"))
        .when(~name.isin("SET", "GET", "DEL"), F.lit("unknown command"))
        .when(~fits, F.lit("invalid protocol format"))
        .when((name == "SET") != (n_value > 0), F.lit("invalid arguments number"))
    )
    good = error.isNull()
    key = F.when(good, F.substring(data, (key_at + 2).cast("int"), n_key.cast("int")))
    value = F.when(good & (n_value > 0), F.substring(data, (value_at + 4).cast("int"), n_value.cast("int")))
    return F.struct(error.alias("error"), F.when(good, name).alias("command"), key.alias("key"), value.alias("value"))


def message_frame(payload: Column) -> Column:
    """A payload behind its length as u32."""
    return F.concat(_be(F.octet_length(payload), 4), payload)


def read_message_frame(data: Column, max_bytes: int = 2**32 - 1) -> Column:
    """``struct(error, payload)`` of one framed message; bytes behind it are ignored. A null frame has no header."""
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint")
    n = F.when(size >= 4, _u(data, F.lit(1), 4))
    error = (
        F.when(size < 4, F.lit("failed to read message header"))
        .when(n > max_bytes, F.lit("message too large"))
        .when(n + 4 > size, F.lit("failed to read message data"))
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), F.substring(data, F.lit(5), n.cast("int"))).alias("payload"))
