"""Buckets of candidates, dealt so that no bucket has to fit into one task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldspar.storage import stage

#: Members of a bucket that one group compares; larger buckets are cut into tiles of about this size.
TILE = 2048
#: One member in so many is counted to find the large buckets. That only steers the cutting, not the result.
COUNTED = 32


def dealt(members: DataFrame, key: str, member: str) -> DataFrame:
    """``members`` with column ``group``: all members of a bucket share a group, or each two share one.

    A bucket that looks larger than some tiles is cut by a hash of the member into t tiles; each pair of tiles
    is a group, so a group's size is bounded and the groups of a hot bucket spread over all tasks.
    """
    hot = (
        members.where(F.pmod(F.xxhash64(member, F.lit(7)), F.lit(COUNTED)) == 0)
        .groupBy(F.col(key).alias("_hot"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") * COUNTED > 4 * TILE)
        .select("_hot", F.ceil(F.col("_n") * COUNTED / TILE).cast("int").alias("_tiles"))
    )
    hot = stage(hot, "hot")
    if hot.isEmpty():
        return members.withColumn("group", F.col(key))
    cold = members.join(hot, F.col(key) == F.col("_hot"), "left_anti").withColumn("group", F.col(key))
    out = members.join(hot, F.col(key) == F.col("_hot")).withColumn("_tile", F.pmod(F.xxhash64(member, F.lit(11)), F.col("_tiles")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    pair = F.xxhash64(key, F.least("_tile", "_other"), F.greatest("_tile", "_other"))
    return cold.unionByName(out.select(*members.columns, pair.alias("group")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links (a, b) connect: each node with the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        for side in (u, v):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def sorted_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[pa.Table]:
    """Whole groups, some at a time, from batches sorted by column ``group``."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        group = table.column("group").to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield table.slice(0, cut)
        kept, rows = table.slice(cut).to_batches(), 0 if cut else rows
        rows = sum(x.num_rows for x in kept) if cut else 0
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        if table.num_rows:
            yield table


def neighbours(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, i + lag) within groups, lag by lag."""
    at, lag = np.arange(len(group)), 1
    while True:
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        yield at, at + lag
        lag += 1


#: What a worker remembers from task to task, by the module that learns it.
_MEMORIES: dict[str, dict] = {}


def memory(module: str) -> dict:
    """The worker's memory for the tasks of ``module``; it lasts until a task of another module begins."""
    return _MEMORIES.setdefault(module, {})


def forget_others(module: str) -> None:
    """Empty what the tasks of other modules have remembered: a worker may serve any operator's next."""
    for name, known in _MEMORIES.items():
        if name != module:
            known.clear()


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow; a worker, which later tasks and stages use again, first forgets what other operators
    remember there and then hands freed memory back."""
    module = run.__module__

    def then(batches):
        forget_others(module)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return then


def by_group(df: DataFrame, order: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` over the rows of ``df`` shuffled by ``group`` and sorted, group after group."""
    return df.repartition("group").sortWithinPartitions("group", *order).mapInArrow(released(run), schema)
