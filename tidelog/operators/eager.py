"""Per-key results over a join, aggregated before the join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = "decimal(38,0)"
_COUNT = "decimal(19,0)"


def _summed(df: DataFrame, c: Column) -> Column:
    """A sum that its input's rows cannot overflow: BIGINT and decimals in 38 digits, smaller integers in BIGINT."""
    kind = df.select(c.alias("x")).schema["x"].dataType
    if isinstance(kind, (T.LongType, T.DecimalType)):
        return F.try_sum(c.cast("decimal(38,0)" if isinstance(kind, T.LongType) else f"decimal(38,{kind.scale})"))
    return F.sum(c)


def _times(df: DataFrame, sum_: str, count: str) -> Column:
    """``sum * count`` summed up: integers and decimals exactly in 38 digits (null beyond), floats as floats."""
    kind = df.schema[sum_].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.sum(F.col(sum_) * F.col(count))
    if isinstance(kind, T.DecimalType):
        return F.try_sum(F.try_multiply(F.col(sum_), F.col(count).cast(_COUNT)))
    return F.try_sum(F.try_multiply(F.col(sum_).cast(_COUNT), F.col(count).cast(_COUNT)))


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    left_max: dict[str, Column] | None = None,
    null_keys: bool = True,
) -> DataFrame:
    """``SELECT by, count(*), sums FROM left JOIN right USING (on) GROUP BY by`` without ever building the join.

    ``by`` are columns of ``left``. Each input is first reduced to one compact state per join key (and, on the
    left, group key): its row count, sums and maxima (``key_states``). States are joined and rolled up (``roll_up``): a
    joined pair stands for ``n_left * n_right`` rows, a left sum counts ``n_right`` times and a right sum ``n_left``
    times. A key with a third of all rows is one state per map task before anything is
    shuffled, and neither the exchange nor the join ever sees its rows. Under one join key
    there are as many states as group keys; a join key with very many is split by AQE's skew join, which the roll-up's own
    exchange leaves free to act.

    Result: ``(*by, n, *left_sums, *right_sums, *left_max)``. ``n`` is DECIMAL(38,0), as the pairs of one key soon pass
    2^63; so are sums of integers. What passes 38 digits is null. Join keys that are null match each other, as rows
    would otherwise get lost from per-key results; ``null_keys=False`` says that there are none to be matched (they are
    dropped), and the join then works on the states' own partitioning, without an exchange of its own; null group keys form a group; null values add nothing to sums;
    an empty side gives an empty result. Columns of the two sides may have clashing names: only those named
    in the arguments are looked at, each on its own side.
    """
    on, by = list(on), list(by)
    group = [c for c in by if c not in on]
    l = key_states(left, [*on, *group], left_sums, left_max)
    r = key_states(right, on, right_sums)
    return roll_up(l, r, on, by, list(left_sums or {}), list(right_sums or {}), list(left_max or {}), null_keys)


def key_states(df: DataFrame, keys: Sequence[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """One state per key: ``(*keys, __n, __s_<sum>..., __m_<max>...)``."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        *(_summed(df, c).alias(f"__s_{k}") for k, c in (sums or {}).items()),
        *(F.max(c).alias(f"__m_{k}") for k, c in (maxima or {}).items()),
    )


def roll_up(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], left_sums: Sequence[str] = (), right_sums: Sequence[str] = (), left_max: Sequence[str] = (), null_keys: bool = True) -> DataFrame:
    """Joined states of two sides, multiplied and summed per ``by``."""
    r = right.select(*(F.col(c).alias(f"__on_{c}") for c in on), F.col("__n").alias("__nr"), *(F.col(f"__s_{k}").alias(f"__r_{k}") for k in right_sums))
    joined = left.join(r, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) if null_keys else F.col(c) == F.col(f"__on_{c}") for c in on])
    return joined.groupBy(*by).agg(
        F.try_sum(F.try_multiply(F.col("__n").cast(_COUNT), F.col("__nr").cast(_COUNT))).alias("n"),
        *(_times(joined, f"__s_{k}", "__nr").alias(k) for k in left_sums),
        *(_times(joined, f"__r_{k}", "__n").alias(k) for k in right_sums),
        *(F.max(f"__m_{k}").alias(k) for k in left_max),
    )
