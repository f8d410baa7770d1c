"""Greedy byte sharding of a whole corpus, computed in parallel.

The rule is sequential: a shard takes rows as long as it stays within the limit. What a range of rows
does to it is a function from the bytes that the open shard brings along to the bytes that it
leaves with, and to the shards begun on the way. Such a function is a table of steps: beyond a threshold the first cut falls
on an earlier row, and from a cut on everything inside the range is settled. Thresholds below zero can't be met, so a
table has no more steps than rows fit into the first shard of its range.

Ranges of ids are turned into tables in tasks. Neighbouring tables are composed pair by pair, level by level, up to the whole
corpus (the logarithm of the ranges in rounds); then the bytes brought along are handed down the same tree to
every range, which lists its shards. Nothing is restarted at a range's edge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.numbering import ID_BUCKET_BITS
from feedloom.session import settle, ship_package

#: What the first row of the corpus meets: no shard can be continued.
_NOTHING_OPEN = (1 << 62) - 1
_TABLE = "node long, total long, above array<long>, leaves array<long>, cuts array<long>"


class Steps:
    """What a range does to the bytes of an open shard.

    Up to the first threshold they grow by ``total``; beyond ``above[i]`` (ascending, the last
    one below them counts) a shard with ``leaves[i]`` bytes is open at the end and ``cuts[i]`` were begun.
    """

    def __init__(self, total: int, above: np.ndarray, leaves: np.ndarray, cuts: np.ndarray) -> None:
        self.total, self.above, self.leaves, self.cuts = total, above, leaves, cuts

    def __call__(self, brought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        brought = np.asarray(brought, np.int64)
        at = np.searchsorted(self.above, brought, side="left") - 1
        held = np.maximum(at, 0)
        return np.where(at >= 0, self.leaves[held], brought + self.total), np.where(at >= 0, self.cuts[held], 0)

    def then(self, after: Steps) -> Steps:
        leaves, more = after(self.leaves)
        # Without a cut here the thresholds of the next range hold, less what is added here.
        moved = after.above - self.total
        some = np.flatnonzero(moved < self.above[0]) if self.above[0] >= 0 else np.zeros(0, np.int64)
        # One threshold below zero is enough: no shard brings less.
        some = some[max(0, int((moved[some] < 0).sum()) - 1) :]
        return Steps(
            self.total + after.total, np.concatenate([moved[some], self.above]),
            np.concatenate([after.leaves[some], leaves]), np.concatenate([after.cuts[some], self.cuts + more]),
        )


def _jumps(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each row, and for a shard that begins at a row the row that begins the next one (the length where none does)."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    after = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1
    return sums, np.minimum(np.maximum(after, np.arange(n) + 1), n)


def steps_of(sizes: np.ndarray, limit: int) -> Steps:
    """The steps of one range of rows."""
    n = len(sizes)
    sums, jump = _jumps(sizes, limit)
    # Doubling: the last shard begun from each row on, and how many were begun.
    last, cuts, to = np.arange(n + 1), np.append(np.ones(n, np.int64), 0), np.append(jump, n)
    while (to < n).any():
        last = np.where(to < n, last[to], last)
        cuts = cuts + cuts[to] * (to < n)
        to = to[to]
    thresholds = limit - sums[1:]
    used = min(n, int((thresholds >= 0).sum()) + 1)
    # Equal thresholds (rows without bytes) cut at the first of their rows.
    rows = np.arange(used)
    keep = np.r_[True, thresholds[1:used] < thresholds[: used - 1]]
    rows = rows[keep][::-1]
    return Steps(int(sums[-1]), thresholds[rows], sums[-1] - sums[last[rows]], cuts[rows])


def cuts_from(sizes: np.ndarray, limit: int, brought: int) -> list[int]:
    """The rows of a range at which shards begin."""
    sums, jump = _jumps(sizes, limit)
    over = np.flatnonzero(brought + sums[1:] > limit)
    found, at = [], int(over[0]) if len(over) else len(sizes)
    while at < len(sizes):
        found.append(at)
        at = int(jump[at])
    return found


def _table_row(node: int, steps: Steps) -> pa.RecordBatch:
    lists = [pa.array([a.tolist()], pa.list_(pa.int64())) for a in (steps.above, steps.leaves, steps.cuts)]
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([steps.total], pa.int64()), *lists], names=["node", "total", "above", "leaves", "cuts"])


def _runs(batches, key: int = 0):
    """The rows of each value of the first column, which comes sorted, as lists of NumPy columns."""
    held, current = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True):
            if a == b:
                continue
            if held and keys[a] != current:
                yield current, held
                held = []
            current = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, held


def _column(parts: list[pa.RecordBatch], i: int) -> np.ndarray:
    return np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts])


def _steps_in(part: pa.RecordBatch, row: int, first: int) -> Steps:
    arrays = [np.array(part.column(first + 1 + i)[row].as_py(), np.int64) for i in range(3)]
    return Steps(part.column(first)[row].as_py(), *arrays)


def greedy_manifest(sizes: DataFrame, ident: str, size: str, limit: int, bits: int = ID_BUCKET_BITS) -> DataFrame:
    """Shards that never exceed ``limit`` unless a single row does, each as full as the rule allows, as a manifest.

    ``sizes`` (id, bytes) is scanned several times: hand in a settled table with unique integer ids. A null size counts as
    no bytes, rows with a null id take no part, and an empty table gives no shards. Rows of 2 ** ``bits`` ids are one task's range.
    """
    ship_package(sizes.sparkSession)
    limit = int(limit)
    if limit < 0:
        raise ValueError("the limit is a number of bytes")
    edges = sizes.agg(F.min(ident).cast("long"), F.max(ident).cast("long")).first()
    if edges[0] is None:
        return sizes.sparkSession.createDataFrame([], "shard_id long, n_rows long, bytes long, first_id long, last_id long")
    rows = sizes.where(F.col(ident).isNotNull()).select(
        F.shiftright(F.col(ident).cast("long") - F.lit(edges[0]), bits).alias("node"), F.col(ident).cast("long").alias("id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")
    )
    ranged = settle(rows, "ranges")

    def tables(batches):
        for node, parts in _runs(batches):
            yield _table_row(node, steps_of(_column(parts, 2), limit))

    def composed(batches):
        for parent, parts in _runs(batches):
            steps = [_steps_in(p, r, 2) for p in parts for r in range(p.num_rows)]
            yield _table_row(parent, steps[0] if len(steps) == 1 else steps[0].then(steps[1]))

    in_order = ranged.repartition("node").sortWithinPartitions("node", "id")
    levels, high = [settle(in_order.mapInArrow(tables, _TABLE), "steps")], (edges[1] - edges[0]) >> bits
    while high:
        pairs = levels[-1].select(F.shiftright("node", 1).alias("parent"), "*").repartition("parent").sortWithinPartitions("parent", "node")
        levels.append(settle(pairs.mapInArrow(composed, _TABLE), "steps"))
        high >>= 1

    # Down again: each node's left half meets what the node meets, its right half what the left one leaves.
    start = levels.pop().select("node", F.lit(_NOTHING_OPEN).alias("brought"), F.lit(0).cast("long").alias("begun"))
    while levels:
        children = levels.pop().withColumn("parent", F.shiftright("node", 1)).join(start.withColumnRenamed("node", "parent"), "parent")
        children = children.select("parent", "node", "total", "above", "leaves", "cuts", "brought", "begun").repartition("parent").sortWithinPartitions("parent", "node")
        start = settle(children.mapInArrow(_halves, "node long, brought long, begun long"), "brought")

    def shards(batches):
        for _, parts in _runs(batches):
            ids, n = _column(parts, 1), _column(parts, 2)
            brought, begun = (parts[0].column(i)[0].as_py() for i in (3, 4))
            cuts = cuts_from(n, limit, brought)
            edges = np.array(([] if cuts and cuts[0] == 0 else [0]) + cuts + [len(n)])
            sums = np.concatenate([[0], np.cumsum(n)])
            number = begun - 1 + np.arange(len(edges) - 1) + (1 if cuts and cuts[0] == 0 else 0)
            columns = [number, np.diff(edges), np.diff(sums[edges]), ids[edges[:-1]], ids[edges[1:] - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["shard_id", "n_rows", "bytes", "first_id", "last_id"])

    met = ranged.join(start, "node").select("node", "id", "n", "brought", "begun").repartition("node").sortWithinPartitions("node", "id")
    parts = met.mapInArrow(shards, "shard_id long, n_rows long, bytes long, first_id long, last_id long")
    return parts.groupBy("shard_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")
    )


def _halves(batches):
    """What each child of a node meets: the left one what the node does, the right one what the left one leaves."""
    for _, parts in _runs(batches):
        nodes, brought, begun = [], [], []
        for p in parts:
            for r in range(p.num_rows):
                if not nodes:
                    met, count = p.column(6)[r].as_py(), p.column(7)[r].as_py()
                nodes.append(p.column(1)[r].as_py())
                brought.append(met)
                begun.append(count)
                left, cuts = _steps_in(p, r, 2)(np.array([met]))
                met, count = int(left[0]), count + int(cuts[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (nodes, brought, begun)], names=["node", "brought", "begun"])
