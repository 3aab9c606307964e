"""Work that follows one global order, without a task that sees all of it and without a task per key.

Rows are range-partitioned by the order and numbered (``numbered``); blocks of the numbers, all of one size, are then worked on
side by side, and only what one block must know of the one before it passes through a small table, a row per block. A key or
writer with most of the rows is many blocks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.sizing import broadcast_if_small
from tidelog.session import materialize

BLOCK_BITS = 18
EDGES_BROADCAST = 200_000
NO_VALUE = -(2**63)


def numbered(df: DataFrame, by: Sequence[str] | str, name: str = "place", first: int = 0) -> DataFrame:
    """``df`` with its dense rank ``name`` by ``by``, from ``first`` on; ties in no particular order.

    Rows are range-partitioned and counted per partition; each row's number is its place within its partition plus the
    counts before it. Only the counts, one row per shuffle partition, reach the driver.
    """
    by = [by] if isinstance(by, str) else list(by)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = materialize(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    starts, before = [], first
    for r in sorted(placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("least")).collect()):
        starts.append((r["__part"], before - r.least))
        before += r.n
    # One row per partition of the shuffle above.
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __shift bigint"))
    return placed.join(known, "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def with_next(df: DataFrame, by: Sequence[str], carry: Sequence[str], name: str = "next", bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with a struct of the ``carry`` columns of the row that follows it by ``by``; null after the last."""
    placed = numbered(df, by, "__place")
    block = F.shiftright("__place", bits)
    inner = F.lead(F.struct(*carry)).over(W.partitionBy(block).orderBy("__place"))
    edges = placed.where(F.col("__place") % (1 << bits) == 0).select((F.col("__place") - 1).alias("__place"), F.struct(*carry).alias("__over"))
    out = placed.withColumn("__inner", inner).join(broadcast_if_small(edges, EDGES_BROADCAST), "__place", "left")
    return out.withColumn(name, F.coalesce("__inner", "__over")).drop("__place", "__inner", "__over")


def with_last(df: DataFrame, by: Sequence[str], value: Column, name: str = "last", bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with the last ``value`` that is not null up to and with each row by ``by``."""
    placed = numbered(df.withColumn("__value", value), by, "__place").withColumn("__block", F.shiftright("__place", bits))
    inner = F.last("__value", ignorenulls=True).over(W.partitionBy("__block").orderBy("__place").rowsBetween(W.unboundedPreceding, 0))
    tops = placed.where("__value IS NOT NULL").groupBy("__block").agg(F.max_by("__value", "__place").alias("__top"))
    blocks = placed.select("__block").distinct().join(tops, "__block", "left")
    # A row for each 2^bits rows: few enough for one task to run through.
    carried = F.last("__top", ignorenulls=True).over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    carried = materialize(blocks.select("__block", carried.alias("__carried")), "carried")
    out = placed.withColumn("__inner", inner).join(broadcast_if_small(carried, EDGES_BROADCAST), "__block", "left")
    return out.withColumn(name, F.coalesce("__inner", "__carried")).drop("__place", "__block", "__value", "__inner", "__carried")


@dataclass(frozen=True)
class SizeOrTime:
    """A group closes at ``size`` rows, or before the row that comes ``wait`` or more after its first. State: (rows held, time of the first).

    A null time neither closes a group nor, as a first time, lets one be closed by time.
    """

    size: int
    wait: int

    def following(self, v: np.ndarray) -> np.ndarray:
        """For a group that begins at each row, where the next one begins."""
        n = len(v)
        at = np.arange(n)
        out = at + self.size
        if n and (v != NO_VALUE).all() and (np.diff(v) >= 0).all():
            return np.minimum(out, np.maximum(np.searchsorted(v, v + self.wait), at + 1))
        for k in range(min(self.size, n) - 1, 0, -1):
            late = (v[:-k] != NO_VALUE) & (v[k:] != NO_VALUE) & (v[k:] - v[:-k] >= self.wait)
            out[:-k][late] = at[:-k][late] + k
        return out

    def head(self, v: np.ndarray) -> np.ndarray:
        """What ``entry`` needs of a block's first rows."""
        return v[: self.size]

    def entry(self, head: np.ndarray, state: tuple[int, int]) -> int:
        """Where the first new group begins after an open one; the head's length or more if nowhere in it."""
        held, first = state
        late = np.flatnonzero((head != NO_VALUE) & (head - first >= self.wait)) if first != NO_VALUE else ()
        return min(max(0, self.size - held), int(late[0]) if len(late) else 2**62)

    def state(self, v: np.ndarray, start: int, end: int) -> tuple[int, int]:
        return end - start, int(v[start])

    def longer(self, state: tuple[int, int], total: int) -> tuple[int, int]:
        return state[0] + total, state[1]

    def total(self, v: np.ndarray) -> int:
        return len(v)


@dataclass(frozen=True)
class Bytes:
    """A group closes before the row with which it would reach ``most``; one row alone may exceed it. State: (bytes held, 0)."""

    most: int

    @staticmethod
    def _sums(v: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.where(v == NO_VALUE, 0, v))])

    def following(self, v: np.ndarray) -> np.ndarray:
        p = self._sums(v)
        reach = np.searchsorted(p[1:], p[:-1] + self.most)
        return np.maximum(np.maximum(reach, np.searchsorted(p, p[:-1], side="right")), np.arange(len(v)) + 1)

    def head(self, v: np.ndarray) -> np.ndarray:
        p = self._sums(v)
        enough = np.flatnonzero((p[1:] >= self.most) & (p[:-1] > 0))
        return p[: enough[0] + 2] if len(enough) else p

    def entry(self, head: np.ndarray, state: tuple[int, int]) -> int:
        opens = np.flatnonzero((state[0] + head[1:] >= self.most) & (state[0] + head[:-1] > 0))
        return int(opens[0]) if len(opens) else 2**62

    def state(self, v: np.ndarray, start: int, end: int) -> tuple[int, int]:
        return int(np.where(v[start:end] == NO_VALUE, 0, v[start:end]).sum()), 0

    def longer(self, state: tuple[int, int], total: int) -> tuple[int, int]:
        return state[0] + total, 0

    def total(self, v: np.ndarray) -> int:
        return int(np.where(v == NO_VALUE, 0, v).sum())


def _block(frame: pd.DataFrame, value: str, scope: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A block in order, its values, and where each run of one writer begins, the end included."""
    frame = frame.sort_values("__place", kind="stable")
    v = frame[value].fillna(NO_VALUE).to_numpy(np.int64)
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for c in scope:
        now, last = frame[c].to_numpy(object)[1:], frame[c].to_numpy(object)[:-1]
        gone, was = pd.isna(now), pd.isna(last)
        new[1:] |= (gone != was) | (~gone & ~was & (now != last))
    return frame, v, np.append(np.flatnonzero(new), len(frame))


def _follow(rule, v: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For a group that begins at each row, where the next begins: at the latest with the next writer."""
    out = np.empty(len(v), np.int64)
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
        out[a:b] = np.minimum(rule.following(v[a:b]) + a, b)
    return out


def consecutive_groups(df: DataFrame, rule: SizeOrTime | Bytes, order: str, value: str, scope: Sequence[str] = (), name: str = "group", bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with the number, from 0 in each ``scope``, of the group each row falls into when groups are filled in ``order``.

    Where a group begins depends on every group before it, but a block's effect on what follows does not have to be
    walked through to be known: for each row at which its first group may begin, and those are the few that an open group may still take,
    a table says how many groups begin in the block and what the last one holds. Tables are made side by side, the driver
    strings them together one at a time, and each block is then numbered from its true beginning, again side by side.
    A writer with most of the rows is many blocks.
    """
    scope = list(scope)
    placed = numbered(df, [*scope, order], "__place").withColumn("__block", F.shiftright("__place", bits))
    arrays = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("head", "a", "b", "begun")]
    plain = [T.StructField(c, T.LongType()) for c in ("__block", "length", "total", "tail_a", "tail_b", "tail_begun")]
    owners = [T.StructField(f"{side}_{c}", df.schema[c].dataType) for side in ("first", "last") for c in scope]

    def table(frame: pd.DataFrame) -> pd.DataFrame:
        frame, v, runs = _block(frame, value, scope)
        m = int(runs[1])
        head = rule.head(v[:m])
        following = np.minimum(rule.following(v[:m]), m).tolist()
        last, begun = [0] * m, [0] * m
        for i in range(m - 1, -1, -1):
            j = following[i]
            last[i], begun[i] = (i, 1) if j >= m else (last[j], begun[j] + 1)
        top = min(m, len(head))
        ends = [rule.state(v[:m], last[i], m) for i in range(top)]
        tail = (0, 0, 0)
        if len(runs) > 2:
            a, at, n = int(runs[-2]), 0, 0
            mine = v[a:]
            hops = np.minimum(rule.following(mine), len(mine)).tolist()
            while True:
                n += 1
                if hops[at] >= len(mine):
                    break
                at = hops[at]
            tail = (*rule.state(mine, at, len(mine)), n)
        row = {
            "__block": int(frame["__block"].iloc[0]), "length": m, "total": rule.total(v[:m]), "tail_a": tail[0], "tail_b": tail[1], "tail_begun": tail[2],
            "head": head, "a": [e[0] for e in ends], "b": [e[1] for e in ends], "begun": begun[:top],
            **{f"first_{c}": frame[c].iloc[0] for c in scope}, **{f"last_{c}": frame[c].iloc[-1] for c in scope},
        }
        return pd.DataFrame([row])

    narrow = placed.select("__block", "__place", value, *scope)
    tables = materialize(narrow.groupBy("__block").applyInPandas(table, T.StructType([*plain, *arrays, *owners])), "tables")
    carries, owner, state, begun = [], None, None, 0
    for r in tables.orderBy("__block").toLocalIterator():
        first, last = (tuple(r[f"{side}_{c}"] for c in scope) for side in ("first", "last"))
        if state is not None and owner == first:
            carries.append((r["__block"], *state, begun))
            at = rule.entry(np.array(r.head, np.int64), state)
            if at < min(r.length, len(r.a)):
                state, begun = (r.a[at], r.b[at]), begun + r.begun[at]
            else:
                state = rule.longer(state, r.total)
        else:
            state, begun = (r.a[0], r.b[0]), r.begun[0]
        if r.tail_begun:
            state, begun = (r.tail_a, r.tail_b), r.tail_begun
        owner = last
    carry = df.sparkSession.createDataFrame(carries, "__block bigint, __a bigint, __b bigint, __begun bigint")
    names, schema = df.columns, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame, v, runs = _block(frame, value, scope)
        hops = _follow(rule, v, runs).tolist()
        ids, at, begun = np.zeros(len(v), np.int64), 0, frame["__begun"].iloc[0]
        base = 0
        if not pd.isna(begun):
            base = int(begun)
            at = min(rule.entry(rule.head(v[: runs[1]]), (int(frame["__a"].iloc[0]), int(frame["__b"].iloc[0]))), int(runs[1]))
        while at < len(v):
            ids[at] = 1
            at = hops[at]
        ids = np.cumsum(ids)
        sizes = np.diff(runs)
        before = np.concatenate([[0], ids[runs[1:-1] - 1]])
        before[0] -= base
        ids = ids - np.repeat(before, sizes) - 1
        return frame[names].assign(**{name: ids})

    ready = placed.join(broadcast_if_small(carry, EDGES_BROADCAST), "__block", "left")
    return ready.groupBy("__block").applyInPandas(number, schema)
