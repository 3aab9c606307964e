"""Unsigned 64-bit numbers in BIGINT columns.

Spark has no unsigned type, and DECIMAL(20,0) does not fit its 64-bit decimal fast path. ``to_pos`` shifts a
value by 2^63, so the whole unsigned range keeps its order in a BIGINT and joins, sorts and hashes stay cheap.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 2**63


def dec(n: int) -> Column:
    """A literal beyond BIGINT."""
    return F.lit(Decimal(n))


def to_pos(u: Column) -> Column:
    """DECIMAL/BIGINT in [0, 2^64) to an order-preserving BIGINT; null for null and anything outside."""
    wide = u.cast("decimal(21,0)")
    return F.when((wide >= 0) & (wide < dec(2**64)), (wide - dec(OFFSET)).try_cast("bigint"))


def from_pos(p: Column) -> Column:
    """The DECIMAL(20,0) that ``to_pos`` turned into ``p``."""
    return (p.cast("decimal(20,0)") + dec(OFFSET)).cast("decimal(20,0)")


def pos_to_bigint(p: Column) -> Column:
    """``p`` as a signed BIGINT of the original value; null where that exceeds 2^63 - 1."""
    return F.when(p < 0, p.bitwiseXOR(F.lit(-(2**63))))
