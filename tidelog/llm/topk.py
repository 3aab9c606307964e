"""Most frequent items by three-phase threshold counting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.sizing import broadcast_if_small
from tidelog.session import materialize

NODE_ITEMS = 1_000_000
NODE_BYTES = 64_000_000
CANDIDATES_BROADCAST = 50_000
LEADERS = 10_000


def _counter(columns: list[str], schema: pa.Schema, node_items: int, node_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, node, held, fresh = TaskContext.get().partitionId(), 0, None, []

        def fold():
            nonlocal held, fresh
            fresh = [t.append_column("n", pa.repeat(pa.scalar(1, pa.int64()), len(t))) for t in fresh]
            table = pa.concat_tables([*([held] if held is not None else []), *fresh])
            held, fresh = table.group_by(columns, use_threads=False).aggregate([("n", "sum")]).rename_columns([*columns, "n"]), []

        def flush():
            nonlocal held, node
            table = held.sort_by([("n", "descending")])
            size = len(table)
            table = table.append_column("node", pa.repeat(pa.scalar((part << 24) + node, pa.int64()), size))
            table = table.append_column("place", pa.array(range(1, size + 1), pa.int64())).select(schema.names).cast(schema)
            held, node = None, node + 1
            return table.to_batches(max_chunksize=20_000)

        rows = 0
        for b in batches:
            fresh.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= 200_000 or sum(t.nbytes for t in fresh) > 8_000_000:
                fold()
                rows = 0
                if len(held) >= node_items or held.nbytes >= node_bytes:
                    yield from flush()
        if fresh:
            fold()
        if held is not None and len(held):
            yield from flush()

    return count


def local_counts(items: DataFrame, columns: Sequence[str], node_items: int = NODE_ITEMS, node_bytes: int = NODE_BYTES) -> DataFrame:
    """Counts as each node holds them: ``(node, place, *columns, n)``, place 1 being the node's most frequent item.

    A node is a stretch of one input partition with at most about ``node_items`` distinct items or ``node_bytes``
    of them, so memory is bounded whatever the partition holds. Nothing is shuffled.
    """
    columns = list(columns)
    fields = [T.StructField("node", T.LongType()), T.StructField("place", T.LongType()), *(items.schema[c] for c in columns), T.StructField("n", T.LongType())]
    out = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return items.select(*columns).mapInArrow(_counter(columns, to_arrow_schema(out), node_items, node_bytes), out)


def frequent_items(
    items: DataFrame,
    columns: Sequence[str],
    k: int | None = None,
    at_least: int | None = None,
    node_items: int = NODE_ITEMS,
    node_bytes: int = NODE_BYTES,
) -> DataFrame:
    """The ``k`` most frequent items, those on at least ``at_least`` rows, or both, with exact counts.

    1. Each node holds its local counts; the leaders' partial sums give a lower bound of the k-th count
       (``at_least`` is one as it stands). A node's leaders are its first ``LEADERS`` items, or k if that is more.
    2. Of m nodes, one that alone accounts for at least bound/m of an item must exist for every item at or above
       the bound. Items above that share somewhere are fetched; their sums raise the bound; what the silent nodes may add
       caps each one, and those that cannot reach the bound are dropped.
    3. The candidates left are counted exactly over all nodes.

    Local counts lie in a table in the shared folder, so that the phases read the same numbers if executors are
    lost. Only leaders and candidates are ever shuffled, unless there are so many candidates (rows and bytes are checked)
    that they are not broadcast to the nodes; a node gives at most (its rows)/(bound/m) of them. Where the share is so low
    that most local counts would be fetched in phase 2 and again in phase 3, as when the k-th item is hardly more
    frequent than the rest, local counts are summed at once instead: the same rows, each exchanged once.
    Result ``(*columns, n)``. Ties with the k-th item are all kept. Null is an item like any other (filter it
    before if it is not wanted); repeated rows count as often as they lie; extra columns are ignored; an empty input gives
    an empty result.
    """
    if k is None and at_least is None:
        raise ValueError("give k, at_least or both")
    columns = list(columns)
    local = materialize(local_counts(items, columns, node_items, node_bytes), "topk")
    nodes = local.where("place = 1").count()
    bound = max(1, at_least or 1)
    if k is not None and nodes:
        leaders = local.where(F.col("place") <= max(k, LEADERS)).groupBy(*columns).agg(F.sum("n").alias("n"))
        kth = leaders.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count("*").alias("c")).first()
        if kth.c == k:
            bound = max(bound, kth.n)
    share = -(-bound // max(nodes, 1))
    told = local.agg(F.count("*").alias("all"), F.count_if(F.col("n") >= share).alias("told")).first()
    summed = lambda df: df.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= bound)
    if 2 * told.told > told.all:
        exact = summed(local)
    else:
        known = materialize(local.where(F.col("n") >= share).groupBy(*columns).agg(F.sum("n").alias("n"), F.count("*").alias("speaking")), "known")
        if k is not None:
            # What has been told so far is a better bound than the leaders gave.
            kth = known.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n"), F.count("*").alias("c")).first()
            bound = max(bound, kth.n) if kth.c == k else bound
        candidates = known.where(F.col("n") + (nodes - F.col("speaking")) * (share - 1) >= bound).select(*columns)
        candidates = broadcast_if_small(materialize(candidates, "candidates"), CANDIDATES_BROADCAST)
        same = [F.col(f"held.{c}").eqNullSafe(F.col(f"cand.{c}")) for c in columns]
        exact = summed(local.alias("held").join(candidates.alias("cand"), same, "left_semi"))
    if k is None:
        return exact
    exact = materialize(exact, "frequent")
    kth = exact.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("n")).first().n
    return exact.where(F.col("n") >= F.lit(kth))
