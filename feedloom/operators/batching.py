"""Cutting an order into batches, collating them and counting their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.numbering import bucketed_window, id_bucket
from feedloom.operators.shuffle import BROADCAST_BLOCKS
from feedloom.schemas import IMAGE_SIDE, SEQUENCE_LENGTH


def global_batches(df: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batches over the whole order, across block edges; the last may be short."""
    return df.withColumn("batch_id", F.expr(f"{pos} div {int(batch_size)}"))


def full_batches(df: DataFrame, batch_size: int, pos: str = "pos") -> DataFrame:
    """As ``global_batches``, with ``full`` false for the rows of a short last batch.

    Positions are dense, so which rows these are follows from the total alone and no
    grouping is needed to tell them.
    """
    size = int(batch_size)
    total = df.agg(F.max(pos).alias("n")).scalar()
    return global_batches(df, size, pos).withColumn("_end", (total + 1).cast("long")).withColumn("full", F.expr(f"{pos} < _end div {size} * {size}")).drop("_end")


def worker_batches(df: DataFrame, shards: DataFrame, batch_size: int, shard: str, place: str, n_shards: int | None = None) -> DataFrame:
    """Batches formed inside each worker over its shards in rank order.

    ``shards`` has (shard, rank, worker, n_rows).  A row's number within its
    worker is (rows of the worker's earlier shards) + place in the shard, so only
    the shard table is ordered and a worker's rows are never gathered.  When the
    caller knows ``n_shards`` and it is small enough, no row moves either.
    """
    upto = bucketed_window(shards, ["worker"], F.shiftright("rank", 12), ["rank"], running={"_upto": "n_rows"})
    seats = upto.select(shard, "worker", "rank", (F.col("_upto") - F.col("n_rows")).alias("_before"))
    if n_shards is not None and n_shards <= BROADCAST_BLOCKS:
        seats = F.broadcast(seats)
    seated = df.join(seats, shard).withColumn("seat", F.col("_before") + F.col(place))
    return seated.withColumn("batch_id", F.expr(f"seat div {int(batch_size)}")).drop("_before")


def block_batches(df: DataFrame, block: str, batch_size: int) -> DataFrame:
    """Per block: how many batches, and the rows of the last one."""
    size = int(batch_size)
    return (
        df.groupBy(block)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("n_batches", F.expr(f"(n_rows + {size - 1}) div {size}"))
        .withColumn("last_rows", F.expr(f"n_rows - (n_batches - 1) * {size}"))
    )


def smoke_runs(df: DataFrame, max_batches: int) -> DataFrame:
    """Each batch's smoke run: runs of ``max_batches`` batches that together are the whole epoch."""
    return df.withColumn("smoke_run", F.expr(f"batch_id div {int(max_batches)}"))


def collate(df: DataFrame, keys: list[str], pos: str, fields: list[str]) -> DataFrame:
    """One row per batch: each field as an array in sample order.

    A batch holds at most the batch size in rows, so the arrays are bounded.
    """
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, *fields))).alias("_rows"))
    return packed.select(
        *keys, F.size("_rows").cast("long").alias("n_rows"), *[F.col("_rows").getField(f).alias(f) for f in fields]
    )


def batch_tokens(df: DataFrame, tokens: Column, sequences: Column, width: int = SEQUENCE_LENGTH) -> DataFrame:
    """Rows, sequences, real tokens and padding share per batch at a fixed width.

    ``tokens`` and ``sequences`` are counts of a sample; take them before a shuffle, so
    that numbers travel and not the text.
    """
    counted = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(sequences).alias("n_sequences"), F.sum(tokens).alias("n_tokens"))
    share = 1 - F.col("n_tokens") / (F.lit(width) * F.col("n_sequences"))
    return counted.withColumn("pad_share", F.round(share, 4))


def shape_check(df: DataFrame, keys: list[str], shape: Column) -> DataFrame:
    """Whether the samples of a batch share one shape and so can be stacked."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct(shape).alias("n_shapes"),
            F.min(shape).alias("min_shape"),
            F.max(shape).alias("max_shape"),
        )
        .withColumn("stackable", (F.col("n_shapes") == 1).cast("long"))
    )


def inflight_bytes(blocks: DataFrame, in_flight: int = 3, channels: int = 3, height: int = IMAGE_SIDE, width: int = IMAGE_SIDE) -> DataFrame:
    """Decoded bytes per block, and the peak with the largest blocks in flight."""
    sized = blocks.withColumn("decoded_bytes", F.col("n_rows") * F.lit(channels * height * width).cast("long"))
    top = sized.orderBy(F.desc("decoded_bytes")).limit(in_flight).agg(F.sum("decoded_bytes").alias("peak"))
    return sized.withColumn("peak_bytes", top.scalar())


def shape_batches(df: DataFrame, shape: str, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batches of one shape along an order: ``batch_id``, and ``resize`` for those that must be brought to one shape first.

    A sample joins the batch that is being filled for its shape, whichever worker or shard it comes from; full batches are
    numbered as their last sample comes. What a shape has left over at the end (fewer than a batch) is batched in
    the order of ``pos`` across shapes, numbered behind the rest, and marked. Every sample is in exactly one batch.
    ``pos`` is unique; a null shape is a shape. Samples are counted in stretches of positions, so a shape
    that most samples have is not gathered; hand in ids and shapes, and fetch pictures afterwards.
    """
    size, names = int(batch_size), df.columns
    seated = bucketed_window(df.withColumn("_shape", F.struct(shape)), ["_shape"], id_bucket(pos), [pos], number="_seat")
    totals = df.groupBy(F.struct(shape).alias("_shape")).agg(F.count(F.lit(1)).alias("_total"))
    cut = seated.join(totals, "_shape").withColumn("_turn", F.expr(f"_seat div {size}")).withColumn("_full", F.expr(f"_seat < _total div {size} * {size}"))
    # A full batch's last sample has the batch's last seat, so its number needs no grouping of the samples.
    ready = cut.where(f"_full AND _seat % {size} = {size - 1}").select("_shape", "_turn", F.col(pos).alias("_ready"))
    numbered = bucketed_window(ready, [], id_bucket("_ready"), ["_ready"], number="batch_id")
    whole = cut.where("_full").join(numbered, ["_shape", "_turn"]).select(*names, "batch_id", F.lit(False).alias("resize"))
    rest = bucketed_window(cut.where("NOT _full"), [], id_bucket(pos), [pos], number="_left")
    before = ready.agg(F.count(F.lit(1)).alias("n")).scalar()
    left = rest.withColumn("_before", before).select(*names, F.expr(f"_before + _left div {size}").alias("batch_id"), F.lit(True).alias("resize"))
    return whole.unionByName(left)


def nonempty(grid: DataFrame, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every cell of the grid, with 0 where no samples arrived."""
    return grid.join(counts, keys, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def stack_vectors(df: DataFrame, ident: str, vector: str, batch_size: int) -> DataFrame:
    """Equal-length vectors of a batch stacked row-major into one array with its shape."""
    batched = df.withColumn("batch_id", F.expr(f"{ident} div {int(batch_size)}"))
    rows = collate(batched.select("batch_id", ident, vector), ["batch_id"], ident, [vector])
    return rows.select(
        "batch_id",
        F.array(F.col("n_rows"), F.size(F.col(vector)[0]).cast("long")).alias("shape"),
        F.flatten(vector).alias("data"),
    )
