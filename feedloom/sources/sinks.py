"""Writers for the three layouts, manifests, results, and the storage report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.labels import parquet_shard_name, run_name
from feedloom.functions.text import meta_text, utf8_bytes
from feedloom.operators.sharding import byte_manifest, count_shards, fixed_shards, tag_shards
from feedloom.schemas import (
    FORMAT_FOLDERS,
    INDEXED_BYTES_PER_SAMPLE,
    INDEXED_COLUMNS,
    MODALITIES,
    PARQUET_SHARD_ROWS,
    TAR_SHARD_ROWS,
    require,
)
from feedloom.session import settle
from feedloom.sources.corpus import register_sources
from feedloom.sources.indexed import spark_schema
from feedloom.sources.shardfiles import SHARD_LIST


def layout_path(out: str, modality: str, fmt: str) -> str:
    """<out>/<modality>/<format folder>"""
    require(modality, MODALITIES, "modality")
    return f"{out.rstrip('/')}/{modality}/{FORMAT_FOLDERS[require(fmt, FORMAT_FOLDERS, 'format')]}"


def by_shard(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Whole shards per task, samples in id order inside each.

    ``tasks`` defaults to the session's shuffle partitions; size it so that a
    task sorts a few GB (100 TB wants tens of thousands).
    """
    spread = [tasks] if tasks else []
    return df.repartition(*spread, "shard_id").sortWithinPartitions("shard_id", "__id__")


def write_parquet_shards(
    df: DataFrame, path: str, shard_rows: int = PARQUET_SHARD_ROWS, size: str | None = None, tasks: int | None = None
) -> None:
    """Row-count shards, one file in each ``shard_id=`` folder, and their manifest.

    Spark picks the file names; the manifest carries the logical shard names.
    """
    laid = count_shards(df, "__id__", shard_rows)
    by_shard(laid.drop("n_shards"), tasks).write.partitionBy("shard_id").parquet(f"{path}/data")
    payload = F.sum(utf8_bytes(size)) if size else F.lit(0).cast("long")
    rows = laid.groupBy("shard_id", "n_shards").agg(
        F.count(F.lit(1)).alias("n_rows"),
        payload.alias("bytes"),
        F.min("__id__").alias("first_id"),
        F.max("__id__").alias("last_id"),
    )
    named = rows.withColumn("file", parquet_shard_name(F.col("shard_id"), F.col("n_shards")))
    named.select("shard_id", "file", "n_rows", "bytes", "first_id", "last_id").write.json(f"{path}/{SHARD_LIST}")


def write_tar(df: DataFrame, path: str, fields: list[str], shard_rows: int = TAR_SHARD_ROWS, tasks: int | None = None) -> None:
    """Tar shards of a fixed sample count with ``manifest.txt``.

    Further columns become further entries of the sample, e.g. a ``json`` column.
    """
    register_sources(df.sparkSession)
    laid = fixed_shards(df.select("__id__", *fields), "__id__", shard_rows)
    by_shard(laid, tasks).write.format("tar_shards").option("path", path).mode("append").save()


def write_indexed(
    df: DataFrame, path: str, limit: int, payload: str, greedy: bool = False, range_rows: int = 100_000, tasks: int | None = None
) -> None:
    """Byte-bounded indexed shards.

    ``greedy=False`` cuts the running byte total on a grid (a shard may exceed the
    limit by its last row); ``greedy=True`` closes a shard before the row that
    would exceed the limit, starting anew every ``range_rows`` ids.
    """
    register_sources(df.sparkSession)
    if greedy:
        laid = fixed_shards(df, "__id__", range_rows)
    else:
        sizes = settle(df.select("__id__", F.octet_length(payload).cast("long").alias("_bytes")), "sizes")
        shards = settle(byte_manifest(sizes, "__id__", "_bytes", limit), "shards")
        laid = tag_shards(df, "__id__", shards)
    writer = by_shard(laid, tasks).write.format("indexed_shards").option("path", path).option("size_limit", limit)
    writer.option("greedy", str(greedy).lower()).mode("append").save()


def indexed_rows(df: DataFrame, modality: str) -> DataFrame:
    """The columns an indexed layout of the modality declares, metadata as JSON text."""
    columns = INDEXED_COLUMNS[require(modality, INDEXED_COLUMNS, "modality")]
    types = spark_schema(columns)
    picked = [
        meta_text(name, df.schema[name].dataType).alias(name) if name == "meta" else F.col(name).cast(types[name].dataType).alias(name)
        for name in columns
    ]
    return df.select(*picked)


def write_formats(
    df: DataFrame,
    out: str,
    modality: str = "text",
    formats: tuple[str, ...] = ("parquet", "tar", "indexed"),
    parquet_rows: int = PARQUET_SHARD_ROWS,
    tar_rows: int = TAR_SHARD_ROWS,
    limit: int = TAR_SHARD_ROWS * INDEXED_BYTES_PER_SAMPLE,
    tasks: int | None = None,
    written_once: bool = True,
) -> dict[str, str]:
    """Any subset of the three layouts from one read of an id-stamped source.

    With several formats the stamped rows are first written once to the shared folder, so
    a lost executor costs no second read of the source.  ``written_once=False`` reads the
    source once per format instead.
    """
    paths = {fmt: layout_path(out, modality, fmt) for fmt in formats}
    payload = {"text": "text", "images": "image", "image+text": "jpg"}[modality]
    stamped = settle(df, "stamped") if written_once and len(paths) > 1 else df
    if "parquet" in paths:
        write_parquet_shards(stamped, paths["parquet"], parquet_rows, "text" if modality == "text" else None, tasks)
    if "tar" in paths:
        if modality == "text":
            write_tar(stamped.withColumnRenamed("text", "txt"), paths["tar"], ["txt"], tar_rows, tasks)
        elif modality == "images":
            write_tar(stamped.withColumnRenamed("image", "jpg"), paths["tar"], ["jpg"], tar_rows, tasks)
        else:
            write_tar(stamped, paths["tar"], ["jpg", "txt"], tar_rows, tasks)
    if "indexed" in paths:
        write_indexed(indexed_rows(stamped, modality), paths["indexed"], limit, payload, tasks=tasks)
    return paths


def write_results(results: DataFrame, path: str) -> None:
    """Epoch records by loader and dataset, each row with its run name."""
    named = results.withColumn("run", run_name(*[F.col(c) for c in ("loader", "dataset", "batch_size", "num_workers", "epoch")]))
    named.write.mode("append").partitionBy("loader", "dataset").json(path)


def storage_footprint(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File count and total size under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"),
    ).withColumn("gb", F.round(F.col("bytes") / 1e9, 6))
