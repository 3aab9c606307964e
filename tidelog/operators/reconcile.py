"""Differences between two copies of a keyed dataset, by invertible Bloom lookup tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.sizing import broadcast_if_small
from tidelog.session import materialize

BUCKET_ROWS = 8192
STRATUM = 32
BROADCAST_ROWS = 100_000
BUFFER_ROWS = 1_000_000

TABLES = "kid bigint, block bigint, cell array<int>, n array<int>, at array<int>, high array<int>, low array<int>, check array<int>"
_SUMS = ("at", "high", "low", "check")
_WORD = np.uint64(0xFFFFFFFF)

# The multipliers of the splitmix64 finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _hashes(at: np.ndarray, row: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element its three cells, one in each third of the table, and its 32 bits of check."""
    h = _mix(row ^ _mix(at + np.uint64(0x9E3779B97F4A7C15)))
    cells = [((h >> np.uint64(20 * j)) & np.uint64(0xFFFFF)).astype(np.int64) % third + j * third for j in range(3)]
    return np.stack(cells), _mix(h) & _WORD


def _signed(x: np.ndarray) -> np.ndarray:
    """Numbers modulo 2^32 as INT holds them."""
    return (x.astype(np.uint64) & _WORD).astype(np.uint32).view(np.int32)


def build_tables(side: np.ndarray, kid: np.ndarray, pos: np.ndarray, row: np.ndarray, bits: int, third: int) -> pa.RecordBatch:
    """Tables of the rows of one task, signed by side: one per bucket ``(kid, pos >> bits)``, of which only cells that are not empty.

    A cell sums, over the elements that fall into it, their signs and, modulo 2^32, the position within the bucket, both
    halves of the row hash and the check. Sums, unlike XORs, do not lose a row that lies there twice. Rows that are
    repeated within the task are dropped before.
    """
    order = np.lexsort((side, row, pos, kid))
    side, kid, pos, row = (x[order] for x in (side, kid, pos, row))
    new = np.ones(len(side), bool)
    new[1:] = (side[1:] != side[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1]) | (kid[1:] != kid[:-1])
    side, kid, pos, row = (x[new] for x in (side, kid, pos, row))
    block, at = pos >> bits, (pos & ((1 << bits) - 1)).astype(np.uint64)
    opens = np.ones(len(side), bool)
    opens[1:] = (kid[1:] != kid[:-1]) | (block[1:] != block[:-1])
    bucket = np.cumsum(opens) - 1
    hashed = row.view(np.uint64)
    cells, check = _hashes(at, hashed, third)
    where, local = np.unique((bucket * (3 * third) + cells).ravel(), return_inverse=True)
    sums = {}
    for name, v in (("n", np.ones(len(side))), ("at", at), ("high", hashed >> np.uint64(32)), ("low", hashed & _WORD), ("check", check)):
        # Below 2^53, as a task buffers at most 2^20 rows or so of 32 bits.
        sums[name] = np.bincount(local, np.tile(side * v.astype(np.float64), 3), len(where)).astype(np.int64)
    filled = np.flatnonzero(np.any([s != 0 for s in sums.values()], axis=0))
    where = where[filled]
    owner, first = np.unique(where // (3 * third), return_index=True)
    offsets = pa.array(np.append(first, len(where)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array((where % (3 * third)).astype(np.int32)))]
    lists += [pa.ListArray.from_arrays(offsets, pa.array(_signed(s[filled].view(np.uint64)))) for s in sums.values()]
    starts = np.flatnonzero(opens)[owner]
    return pa.RecordBatch.from_arrays([pa.array(kid[starts]), pa.array(block[starts]), *lists], names=["kid", "block", "cell", "n", *_SUMS])


def peel(n: np.ndarray, sums: np.ndarray, third: int) -> tuple[np.ndarray, bool]:
    """Positions within the bucket of a table's elements, by repeatedly taking cells that hold but one; whether all came out.

    ``n``: signed counts, ``sums``: (4, cells) modulo 2^32. A row that one side has twice more than the other counts 2;
    half of a sum modulo 2^32 is one of two numbers, of which the check says which.
    """
    n, sums = n.copy(), sums.astype(np.uint64)
    found: list[np.ndarray] = []
    for _ in range(len(n) + 1):
        taken = 0
        for times in (1, 2):
            one = np.flatnonzero(np.abs(n) == times)
            if not len(one):
                continue
            sign = np.sign(n[one])
            v = np.where(sign > 0, sums[:, one], (~sums[:, one] + np.uint64(1)) & _WORD)
            half = np.uint64(1 << 31)
            for high, low in [(0, 0)] if times == 1 else [(0, 0), (0, 1), (1, 0), (1, 1)]:
                at = v[0] // np.uint64(times)
                row = ((v[1] // np.uint64(times) + half * np.uint64(high)) << np.uint64(32)) | (v[2] // np.uint64(times) + half * np.uint64(low))
                cells, check = _hashes(at, row, third)
                pure = ((check * np.uint64(times)) & _WORD == v[3]) & (cells == one).any(axis=0)
                if times == 2:
                    pure &= (v[:3] % np.uint64(2) == 0).all(axis=0)
                # An element may be alone in up to three cells at once: it must be taken once.
                elements, keep = np.unique(np.stack([at[pure], row[pure]]), axis=1, return_index=True)
                if not len(keep):
                    continue
                taken += len(keep)
                signs, check = sign[pure][keep], check[pure][keep]
                found.append(elements[0])
                m = (signs * times).astype(np.int64)
                parts = np.stack([elements[0], elements[1] >> np.uint64(32), elements[1] & _WORD, check]).astype(np.int64) * m
                for c in cells[:, pure][:, keep]:
                    np.subtract.at(n, c, m)
                    for i in range(4):
                        np.subtract.at(sums[i], c, parts[i].view(np.uint64))
                sums &= _WORD
                break
            if taken:
                break
        if not taken:
            break
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return at.astype(np.int64), not (n.any() or sums.any())


def differing_keys(elements: DataFrame, bucket_rows: int = BUCKET_ROWS, cells_per_difference: float = 1.5, stratum: int = STRATUM) -> DataFrame:
    """``(kid, pos)`` of every element that the two sides do not have equally often, and of none that they have.

    ``elements``: ``(side, kid, pos, rowhash)``, side +1 or -1. A bucket is a stretch of positions of one ``kid`` that
    holds about ``bucket_rows`` rows. Logs lie in their files in about the order of their positions, so nearly all rows of a
    bucket are met by one or two tasks of each side, which build its table where the rows lie: what is exchanged are
    tables, whose size goes with the differences, not rows. (Rows in no order at all would cost up to three cells a row.)

    One of ``stratum`` rows, chosen by name, is counted through beforehand; from these come the density of positions, which sets
    the buckets' width, and the number of differences, which sets the tables' size. A bucket that does not peel to nothing
    is not guessed at: its elements are compared one by one.
    """
    chosen = elements.where(F.pmod(F.xxhash64("pos", "kid"), F.lit(stratum)) == 0)
    counted = materialize(chosen.groupBy("kid", "pos", "rowhash").agg(F.sum("side").alias("s"), F.count("*").alias("n")), "stratum")
    spread = counted.groupBy("kid").agg(F.sum("n").alias("n"), F.percentile_approx("pos", [0.05, 0.95]).alias("p"))
    span = F.sum((F.element_at("p", 2).cast("double") - F.element_at("p", 1)) / 0.9 + 1)
    seen = spread.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(span, F.lit(1.0)).alias("span")).first()
    rows = max(1, seen.n * stratum)
    bits = min(31, max(4, round(math.log2(max(1.0, bucket_rows * seen.span / rows)))))
    mean = counted.where("s <> 0").count() * stratum * min(1.0, bucket_rows / rows)
    third = max(8, math.ceil((mean + 5 * math.sqrt(mean) + 8) * cells_per_difference / 3))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def built() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            columns = [t.column(c).to_numpy() for c in ("side", "kid", "pos", "rowhash")]
            return build_tables(columns[0].astype(np.float64), *columns[1:], bits, third)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUFFER_ROWS:
                yield built()
                held.clear()
        if held:
            yield built()

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        n, sums = np.zeros(3 * third, np.int64), np.zeros((4, 3 * third), np.uint64)
        for row in frame.itertuples(index=False):
            cell = np.asarray(row.cell)
            n[cell] += row.n
            for i, c in enumerate(_SUMS):
                sums[i, cell] += np.asarray(getattr(row, c)).astype(np.int64).view(np.uint64)
        at, whole = peel(n, sums & _WORD, third)
        kid, block = int(frame["kid"].iloc[0]), int(frame["block"].iloc[0])
        if not whole:
            at = np.zeros(1, np.int64)
        return pd.DataFrame({"kid": kid, "block": block, "pos": (block << bits) + at, "whole": whole})

    made = elements.select("side", "kid", "pos", "rowhash").mapInArrow(tables, TABLES)
    peeled = materialize(made.groupBy("kid", "block").applyInPandas(decode, "kid bigint, block bigint, pos bigint, whole boolean"), "peeled")
    names = peeled.where("whole").select("kid", "pos")
    stuck = peeled.where("NOT whole").select("kid", "block").distinct()
    if stuck.isEmpty():
        return names
    direct = elements.withColumn("block", F.shiftright("pos", bits)).join(broadcast_if_small(stuck, BROADCAST_ROWS), ["kid", "block"], "left_semi")
    direct = direct.groupBy("kid", "pos", "rowhash").agg(F.sum("side").alias("s")).where("s <> 0")
    return names.unionByName(direct.select("kid", "pos")).distinct()


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    scope: str,
    pos: str,
    fields: Sequence[str],
    only_left: str = "only_master",
    only_right: str = "only_replica",
    **sizes,
) -> DataFrame:
    """Rows missing on either side and fields that differ: ``(scope, pos, diff)``.

    Both inputs have ``(scope, pos, *fields)``; a row is named by scope and pos. ``diff`` is ``only_left``,
    ``only_right`` or the name of a differing field, one row each; nulls equal nulls only. Repeated rows count
    once; if one side holds different rows under one name, the one greatest by its fields stands for it. Extra
    columns are ignored; two empty inputs give an empty result. A null scope is a scope; rows with a null pos have no name and are left out.
    Two different rows with equal 64-bit hashes under
    one name would be missed (2^-64 per pair); every reported difference has been compared byte by byte.
    """
    body = F.struct(*fields)
    kid = F.xxhash64(scope)
    sides = [s.where(F.col(pos).isNotNull()).select(F.lit(sign).alias("side"), scope, kid.alias("kid"), F.col(pos).alias("pos"), *fields) for sign, s in ((1, left), (-1, right))]
    both = sides[0].unionByName(sides[1])
    # The hash covers nulls too: without the mask, (null, x) and (x, null) would hash alike.
    mask: Column = F.concat_ws("", *(F.col(f).isNull().cast("int").cast("string") for f in fields))
    elements = both.select("side", "kid", "pos", F.xxhash64(mask, *fields).alias("rowhash"))
    named = materialize(differing_keys(elements, **sizes).distinct(), "differing")
    fetched = both.join(broadcast_if_small(named, BROADCAST_ROWS), ["kid", "pos"], "left_semi")
    pairs = fetched.groupBy("kid", "pos", scope).agg(F.max(F.when(F.col("side") == 1, body)).alias("l"), F.max(F.when(F.col("side") == -1, body)).alias("r"))
    unequal = [F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]
    diff = (
        F.when(F.col("r").isNull(), F.array(F.lit(only_left)))
        .when(F.col("l").isNull(), F.array(F.lit(only_right)))
        .otherwise(F.array_compact(F.array(*unequal)))
    )
    return pairs.select(scope, "pos", F.explode(diff).alias("diff"))
