"""Broadcast joins only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes: what it holds, and 16 for each field."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("bigint")
        return F.lit(0).cast("bigint")

    total = F.lit(16 * max(1, len(schema))).cast("bigint")
    for f in schema:
        total = total + of(F.col(f"`{f.name}`"), f.dataType)
    return total


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of ``max_bytes`` together; else the join shuffles.

    The check stops after ``max_rows + 1`` rows. It evaluates ``df`` once more than the join does, so give it a table
    (``materialize``) or something as cheap.
    """
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen.n <= max_rows and seen.b <= max_bytes else df
