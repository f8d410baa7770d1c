"""Shard layouts as columns, manifests, and finding a sample in its shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.numbering import bucketed_window, id_bucket, number_by_id


def row_count(df: DataFrame) -> Column:
    """The row count as a scalar subquery, so no driver round trip is needed."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def count_shards(df: DataFrame, ident: str, shard_size: int) -> DataFrame:
    """Row-count sharding: equal shards, the last one takes the remainder."""
    size = int(shard_size)
    return (
        df.withColumn("_total", row_count(df.select(ident)))
        .withColumn("n_shards", F.expr(f"greatest(1L, _total div {size})"))
        .withColumn("shard_id", F.expr(f"least({ident} div nullif(_total div n_shards, 0), n_shards - 1)"))
        .drop("_total")
    )


def fixed_shards(df: DataFrame, ident: str, max_rows: int) -> DataFrame:
    """Rolling sharding: a new shard after every ``max_rows`` samples."""
    return df.withColumn("shard_id", F.expr(f"{ident} div {int(max_rows)}"))


def byte_manifest(sizes: DataFrame, ident: str, size: str, limit: int) -> DataFrame:
    """Byte sharding on a grid of ``limit`` bytes over the running total, as a manifest.

    A shard ends with the row that crosses a grid line, so it may exceed the
    limit by that row.  A row longer than several limits leaves gaps in the
    numbers; they are closed by numbering the shards that exist.  ``sizes``
    (id, bytes) is scanned several times: hand in a settled table, not texts.
    """
    running = bucketed_window(sizes.select(ident, size), [], id_bucket(ident), [ident], running={"_upto": size})
    gridded = running.withColumn("_grid", F.expr(f"(_upto - {size}) div {int(limit)}"))
    shards = gridded.groupBy("_grid").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(size).alias("bytes"),
        F.min(ident).alias("first_id"),
        F.max(ident).alias("last_id"),
    )
    return number_by_id(shards, "_grid", "shard_id").select("shard_id", "n_rows", "bytes", "first_id", "last_id")


def tag_shards(df: DataFrame, ident: str, shards: DataFrame, grain_bits: int = 14) -> DataFrame:
    """Add ``shard_id`` to payload rows from a manifest of id ranges.

    An equi-join on id >> grain_bits with the range as a further condition: the
    planner broadcasts the manifest when it is small enough and shuffles
    otherwise; either way each row meets only the shards that share its grain.
    """
    piece = F.explode(F.sequence(F.shiftright("first_id", grain_bits), F.shiftright("last_id", grain_bits)))
    pieces = shards.select("shard_id", "first_id", "last_id", piece.alias("_piece"))
    rows = df.withColumn("_grain", F.shiftright(ident, grain_bits))
    inside = (F.col("_grain") == F.col("_piece")) & F.col(ident).between(F.col("first_id"), F.col("last_id"))
    return rows.join(pieces, inside).select(*df.columns, "shard_id")


def id_blocks(df: DataFrame, ident: str, blocks: int, into: str = "block") -> DataFrame:
    """Cut dense ids into ``blocks`` equal ranges."""
    return (
        df.withColumn("_total", row_count(df.select(ident)))
        .withColumn(into, F.expr(f"{ident} * {int(blocks)} div _total"))
        .drop("_total")
    )


def id_slice(df: DataFrame, ident: str, start: int, end: int) -> DataFrame:
    """Rows with start <= id < end; both bounds reach the Parquet scan."""
    return df.where((F.col(ident) >= start) & (F.col(ident) < end))


def slices(df: DataFrame, ident: str, width: int) -> DataFrame:
    """Name the [start, end) slice each row falls in."""
    return df.withColumn("slice_start", F.expr(f"{ident} div {int(width)} * {int(width)}")).withColumn(
        "slice_end", F.col("slice_start") + F.lit(int(width)).cast("long")
    )


def row_caps(df: DataFrame, ident: str, cap: int) -> DataFrame:
    """Which portion of ``cap`` rows in source order every row is in, from its dense id."""
    return df.withColumn("portion", F.expr(f"{ident} div {int(cap)}"))


def manifest(df: DataFrame, ident: str, size: Column) -> DataFrame:
    """One row per shard: rows, payload bytes, first and last id."""
    return df.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(size).alias("bytes"),
        F.min(ident).alias("first_id"),
        F.max(ident).alias("last_id"),
    )


def locate(ids: DataFrame, ident: str, shards: DataFrame, grain_bits: int = 16) -> DataFrame:
    """(id) -> (shard_id, place) through a manifest with first_id and last_id, once per distinct id.

    Ids and shard starts are laid on one line and each id takes the last start
    before it.  The line is cut every 2**grain_bits ids; a shard that spans cuts
    is entered once per piece.  Nothing is broadcast and no candidate pairs are
    formed, however uneven the shards are.
    """
    piece = F.explode(F.sequence(F.shiftright("first_id", grain_bits), F.shiftright("last_id", grain_bits)))
    starts = (
        shards.select("shard_id", "first_id", "last_id", piece.alias("_piece"))
        .select(
            F.greatest(F.col("first_id"), F.shiftleft("_piece", grain_bits)).alias("_at"),
            "_piece",
            F.struct("shard_id", "first_id", "last_id").alias("_shard"),
            F.lit(0).alias("_kind"),
        )
    )
    wanted = ids.select(F.col(ident).alias("_at")).distinct()
    asked = wanted.select(
        "_at", F.shiftright("_at", grain_bits).alias("_piece"), F.lit(None).cast(starts.schema["_shard"].dataType).alias("_shard"),
        F.lit(1).alias("_kind"),
    )
    line = Window.partitionBy("_piece").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        starts.unionByName(asked)
        .withColumn("_hit", F.last("_shard", ignorenulls=True).over(line))
        .where("_kind = 1 AND _at <= _hit.last_id")
    )
    return found.select(
        F.col("_at").alias(ident),
        F.col("_hit.shard_id").alias("shard_id"),
        (F.col("_at") - F.col("_hit.first_id")).alias("place"),
    )


def locate_fixed(ident: str, shard_rows: int) -> dict[str, Column]:
    """Shard and place by arithmetic, for shards of one size."""
    return {
        "shard_id": F.expr(f"{ident} div {int(shard_rows)}"),
        "place": F.expr(f"{ident} % {int(shard_rows)}"),
    }


def assign_workers(ranked: DataFrame, rank: str, workers: int) -> DataFrame:
    """Round robin of ranked shards over workers."""
    return ranked.withColumn("worker", F.expr(f"{rank} % {int(workers)}"))


def starved_workers(shards: DataFrame, worker_counts: list[int]) -> DataFrame:
    """Workers that get no shard, for each worker count asked about."""
    asked = F.array(*[F.lit(int(w)).cast("long") for w in worker_counts])
    total = shards.agg(F.countDistinct("shard_id").alias("n_shards"))
    grid = total.withColumn("num_workers", F.explode(asked)).withColumn("worker", F.explode(F.expr("sequence(0L, num_workers - 1)")))
    return grid.where("worker >= n_shards").select("num_workers", "worker", "n_shards")


def require_feasible(shards: DataFrame, workers: int) -> int:
    """Fail when there are more workers than shards; returns the number of shards."""
    found = shards.select("shard_id").distinct().count()
    if workers > found:
        raise ValueError(f"{workers} workers but only {found} shards")
    return found


def balance(shards: DataFrame) -> DataFrame:
    """Spread of rows and bytes over shards (manifest in, one row out)."""
    return shards.agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.min("n_rows").alias("min_rows"),
        F.max("n_rows").alias("max_rows"),
        F.round(F.avg("n_rows"), 3).alias("avg_rows"),
        F.min("bytes").alias("min_bytes"),
        F.max("bytes").alias("max_bytes"),
        F.round(F.avg("bytes"), 3).alias("avg_bytes"),
    )
