"""Epoch orders: global, index-only, bounded-buffer, shard and block shuffles.

Every order comes from md5(seed:epoch:id), so it is the same under any
partitioning, after a lost executor, and in any other SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.numbering import bucketed_window, hash_bucket, number_by_hash

# A block or shard table of up to this many rows (a few MB) is broadcast.
BROADCAST_BLOCKS = 65_536


def shuffle_key(ident: Column | str, seed: int, epoch: Column | int = 0) -> Column:
    ident = F.col(ident) if isinstance(ident, str) else ident
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    text = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), ident.cast("string"))
    return F.md5(text.cast("binary"))


def global_shuffle(df: DataFrame, ident: str, seed: int = 42, epoch: int = 0, into: str = "pos") -> DataFrame:
    """Add each row's position in the epoch's random order (rows are not sorted)."""
    keyed = df.withColumn("_key", shuffle_key(ident, seed, epoch))
    return number_by_hash(keyed, "_key", ident, into).drop("_key")


def shuffled_partitions(df: DataFrame, ident: str, seed: int = 42, epoch: int = 0, partitions: int | None = None) -> DataFrame:
    """The rows themselves in random order: range partitions by key, sorted inside."""
    keyed = df.withColumn("_key", shuffle_key(ident, seed, epoch))
    parts = [partitions] if partitions else []
    return keyed.repartitionByRange(*parts, "_key", ident).sortWithinPartitions("_key", ident).drop("_key")


def index_shuffle(df: DataFrame, ident: str, workers: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(id, pos, worker): only ids are shuffled; an even contiguous cut goes to each worker."""
    ids = df.select(ident)
    total = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = global_shuffle(ids, ident, seed, epoch)
    return placed.withColumn("_total", total).select(ident, "pos", F.expr(f"pos * {int(workers)} div _total").alias("worker"))


def fetch(index: DataFrame, payload: DataFrame, ident: str) -> DataFrame:
    """Payload for an index order, by equi-join on the id."""
    return index.join(payload, ident)


def epoch_orders(df: DataFrame, ident: str, epochs: int, seed: int = 42) -> DataFrame:
    """A fresh order for every epoch, as rows (epoch, id, pos)."""
    grown = df.select(ident, F.explode(F.expr(f"sequence(0L, {int(epochs) - 1}L)")).alias("epoch"))
    keyed = grown.withColumn("_key", shuffle_key(ident, seed, F.col("epoch")))
    return bucketed_window(keyed, ["epoch"], hash_bucket(df, "_key"), ["_key", ident], number="pos").drop("_key")


def shard_order(shards: DataFrame, shard: str, seed: int = 42, epoch: int = 0, into: str = "rank") -> DataFrame:
    """Random rank of each shard (one row per shard in)."""
    return global_shuffle(shards, shard, seed, epoch, into)


def window_shuffle(df: DataFrame, shard: Column, pos: str, ident: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Shuffle inside consecutive windows of ``size`` rows of a shard.

    ``pos`` is the row's 0-based place inside its shard.  A group holds at most
    ``size`` rows, so no task depends on how large a shard is.  The rows handed
    in are moved: give ids, and fetch the payload afterwards.
    """
    keyed = df.withColumns(
        {"_shard": shard, "_window": F.floor(F.col(pos) / F.lit(size)).cast("long"), "_key": shuffle_key(ident, seed, epoch)}
    )
    inside = Window.partitionBy("_shard", "_window").orderBy("_key", ident)
    out = F.col("_window") * F.lit(size) + F.row_number().over(inside).cast("long") - 1
    return keyed.withColumn("out_pos", out).drop("_shard", "_window", "_key")


def window_shuffle_in_place(
    df: DataFrame, shard: str, place: str, ident: str, size: int, seed: int = 42, epoch: int = 0, into: str = "out_pos"
) -> DataFrame:
    """``window_shuffle`` for rows scanned one shard per partition: sorted where they are, no exchange.

    A tar scan is such a source.  The new place is the row's place in its sorted
    partition, the low 33 bits of Spark's increasing id.
    """
    window = F.floor(F.col(place) / F.lit(size)).cast("long")
    keyed = df.withColumns({"_window": window, "_key": shuffle_key(ident, seed, epoch)})
    ordered = keyed.sortWithinPartitions(shard, "_window", "_key", ident)
    seat = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(into, seat).drop("_window", "_key")


def buffer_order(
    df: DataFrame, shard: Column, pos: str, ident: str, size: int, seed: int = 42, epoch: int = 0, into: str = "out_pos"
) -> DataFrame:
    """Bounded-buffer order of a shard's rows, without window edges.

    Every row is held back by a random number of places below ``size`` and rows leave in
    the order of (place + delay), so each comes out fewer than ``size`` places early or
    late: a buffer of ``size`` rows can produce the order.  A group is one shard, which is one
    file of bounded size.  The rows handed in are moved: give ids, and fetch the payload afterwards.
    """
    keyed = df.withColumns({"_shard": shard, "_key": shuffle_key(ident, seed, epoch)})
    delay = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.lit(int(size))
    leaving = Window.partitionBy("_shard").orderBy(F.col(pos) + delay, "_key", ident)
    return keyed.withColumn(into, F.row_number().over(leaving).cast("long") - 1).drop("_shard", "_key")


def block_shuffle(df: DataFrame, block: str, ident: str, seed: int = 42, epoch: int = 0, blocks: int | None = None) -> DataFrame:
    """Reorder whole blocks; rows inside a block keep their order.

    Needs dense ids and blocks of consecutive ids.  Only one row per block is
    ordered; data rows get their new position by arithmetic.  Given the number of
    ``blocks``, a small enough block table is broadcast and no data row moves.
    """
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("_rows"), F.min(ident).alias("_first"))
    keyed = sizes.withColumn("_key", shuffle_key(block, seed, epoch))
    ranked = bucketed_window(
        keyed, [], hash_bucket(sizes, "_key"), ["_key", block], number="block_rank", running={"_upto": "_rows"}
    )
    moved = ranked.select(block, "block_rank", (F.col("_upto") - F.col("_rows") - F.col("_first")).alias("_shift"))
    if blocks is not None and blocks <= BROADCAST_BLOCKS:
        moved = F.broadcast(moved)
    return df.join(moved, block).withColumn("pos", F.col(ident) + F.col("_shift")).drop("_shift")
