"""Names built from run and shard attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.schemas import INDEXED_SHARD_FORMAT, PARQUET_SHARD_FORMAT, RUN_FORMAT, TAR_SHARD_FORMAT


def parquet_shard_name(shard: Column, total: Column) -> Column:
    return F.format_string(PARQUET_SHARD_FORMAT, shard.cast("long"), total.cast("long"))


def tar_shard_name(shard: Column) -> Column:
    return F.format_string(TAR_SHARD_FORMAT, shard.cast("long"))


def indexed_shard_name(shard: Column) -> Column:
    return F.format_string(INDEXED_SHARD_FORMAT, shard.cast("long"))


def run_name(loader: Column, dataset: Column, batch_size: Column, workers: Column, epoch: Column) -> Column:
    return F.format_string(
        RUN_FORMAT, loader, dataset, batch_size.cast("long"), workers.cast("long"), epoch.cast("long")
    )


def series_label(loader: Column, dataset: Column, batch_size: Column) -> Column:
    return F.format_string("%s / %s / bs=%d", loader, dataset, batch_size.cast("long"))


def short_label(loader: Column, batch_size: Column) -> Column:
    return F.format_string("%s/bs=%d", loader, batch_size.cast("long"))


def band(value: Column, steps: list[float]) -> Column:
    """Index of the highest threshold the value reaches; below the first it is -1."""
    out = F.lit(-1)
    for i, step in enumerate(steps):
        out = F.when(value >= F.lit(step), F.lit(i)).otherwise(out)
    return F.when(value.isNotNull() & ~F.isnan(value), out).cast("long")
