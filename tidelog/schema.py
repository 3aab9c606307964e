"""Shapes and constants of the change log."""

from __future__ import annotations

from pyspark.sql import types as T

# Command ids of the log and of the wire protocol.
UNKNOWN, SET, GET, DEL = 0, 1, 2, 3
COMMAND_IDS = {"SET": SET, "GET": GET, "DEL": DEL}
MAX_U64 = 2**64 - 1

LSN = T.DecimalType(20, 0)
LOG_RECORD = T.StructType(
    [
        T.StructField("lsn", LSN),
        T.StructField("command", T.IntegerType()),
        T.StructField("arguments", T.ArrayType(T.BinaryType())),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("lsn", LSN),
        T.StructField("cmdid", T.IntegerType()),
        T.StructField("args", T.ArrayType(T.StringType())),
    ]
)
LOG_BATCH = T.StructType([T.StructField("total", T.IntegerType()), T.StructField("events", T.ArrayType(EVENT))])
