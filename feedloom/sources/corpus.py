"""Readers for corpora, images, shards, manifests and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.schemas import EPOCH_RECORD, FORMAT_FOLDERS, MANIFEST, TEXT_SOURCE, modality_schema, require
from feedloom.session import ship_package
from feedloom.sources.shardfiles import SHARD_LIST, exists, open_fs


def register_sources(spark: SparkSession) -> None:
    """Make ``tar_shards`` and ``indexed_shards`` known to the session."""
    from feedloom.sources.indexed import IndexedShards
    from feedloom.sources.tar import TarShards

    ship_package(spark)
    spark.dataSource.register(TarShards)
    spark.dataSource.register(IndexedShards)


def read_text_corpus(spark: SparkSession, path: str, meta: T.DataType | None = None, strict: bool = False) -> DataFrame:
    """Line-delimited JSON with ``text`` and ``meta`` (JSON text unless a type is given).

    Broken lines land in ``_corrupt_record``, or fail the job when ``strict``.
    """
    fields = [T.StructField("text", T.StringType()), T.StructField("meta", meta or TEXT_SOURCE["meta"].dataType)]
    if strict:
        return spark.read.schema(T.StructType(fields)).option("mode", "FAILFAST").json(path)
    fields.append(T.StructField("_corrupt_record", T.StringType()))
    return spark.read.schema(T.StructType(fields)).option("mode", "PERMISSIVE").json(path)


def read_labelled_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under ``label=<n>/`` folders, decoded by Spark's ``image`` source."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select("image", F.col("label").cast("int").alias("label"))


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Encoded image files as (image struct of bytes and path, label)."""
    files = spark.read.format("binaryFile").load(path)
    label = F.col("label").cast("int") if "label" in files.columns else F.lit(None).cast("int")
    return files.select(F.struct(F.col("content").alias("bytes"), F.col("path")).alias("image"), label.alias("label"))


def read_tar(spark: SparkSession, path: str, fields: str = "txt string", shard: bool = False, ids: tuple[int | None, int | None] = (None, None), apart: bool = False) -> DataFrame:
    """Tar shards as rows: ``__key__``, the fields asked for, optionally shard name and place in it; of a range of ids only its shards are opened.

    Small shards share a task unless they shall be ``apart``, one in each partition.
    """
    register_sources(spark)
    extra = "`__shard__` string, `__place__` long, " if shard else ""
    schema = f"`__key__` string, {extra}{fields}".rstrip(", ")
    reader = spark.read.format("tar_shards").schema(schema).option("path", path)
    return _between(reader if apart else _together(spark, reader), ids).load()


def read_indexed(spark: SparkSession, path: str, ids: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Indexed shards; of an id range (both ends inside) only its shards are opened, and read from its first sample on."""
    register_sources(spark)
    return _between(_together(spark, spark.read.format("indexed_shards").option("path", path)), ids).load()


def _together(spark: SparkSession, reader):
    return reader.option("cores", spark.sparkContext.defaultParallelism)


def _between(reader, ids: tuple[int | None, int | None]):
    for name, value in zip(("first_id", "last_id"), ids, strict=True):
        reader = reader if value is None else reader.option(name, int(value))
    return reader


def read_parquet_shards(spark: SparkSession, path: str, blocks: int | None = None) -> DataFrame:
    """Parquet shards; ``blocks`` fixes the number of partitions (one shuffle)."""
    df = spark.read.parquet(f"{path}/data")
    return df.repartition(blocks) if blocks else df


def read_corpus(spark: SparkSession, modality: str, path: str) -> DataFrame:
    """The raw source of a modality; an unknown one fails before any job."""
    modality_schema(modality)
    if modality == "text":
        return read_text_corpus(spark, path)
    if modality == "images":
        return read_image_files(spark, path)
    return read_tar(spark, path, "jpg binary, txt string")


def read_layout(spark: SparkSession, fmt: str, path: str, modality: str = "text") -> DataFrame:
    """Any of the three training layouts as rows."""
    require(fmt, FORMAT_FOLDERS, "format")
    if fmt == "parquet":
        return read_parquet_shards(spark, path)
    if fmt == "indexed":
        return read_indexed(spark, path)
    fields = {"text": "txt string", "images": "jpg binary", "image+text": "jpg binary, txt string"}[modality]
    return read_tar(spark, path, fields)


def list_shards(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Shard files with sizes, in name order; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").cast("long").alias("bytes")).orderBy("path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: rows, bytes, first and last sample id.

    Layouts written elsewhere lack our shard list; it is then derived from
    ``index.json`` (indexed) or by counting the tars' samples.
    """
    files, root = open_fs(path)
    if exists(files, f"{root}/{SHARD_LIST}"):
        return spark.read.schema(MANIFEST).json(f"{path}/{SHARD_LIST}")
    if exists(files, f"{root}/index.json"):
        shard = "struct<raw_data: struct<basename: string, bytes: bigint>, samples: bigint>"
        index = spark.read.schema(f"shards array<{shard}>").option("multiLine", "true").json(f"{path}/index.json")
        listed = index.select(F.posexplode("shards").alias("at", "s"))
        listed = listed.select(
            F.col("at").cast("long").alias("shard_id"), F.col("s.raw_data.basename").alias("file"),
            F.col("s.samples").alias("n_rows"), F.col("s.raw_data.bytes").alias("bytes"),
        )
    else:
        counted = read_tar(spark, path, "", shard=True).groupBy(F.col("__shard__").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
        number = F.row_number().over(Window.orderBy("file")).cast("long") - 1
        listed = counted.select(number.alias("shard_id"), "file", "n_rows", F.lit(None).cast("long").alias("bytes"))
    # One row per shard file is ordered here.
    upto = F.sum("n_rows").over(Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return listed.withColumn("last_id", upto - 1).withColumn("first_id", F.col("last_id") - F.col("n_rows") + 1).select(*MANIFEST.names)


def read_shard_list(spark: SparkSession, path: str) -> DataFrame:
    """Shard names in order from a tar layout's ``manifest.txt``."""
    return spark.read.text(f"{path}/manifest.txt").select(F.col("value").alias("file")).orderBy("file")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Epoch records, one (indented) JSON object per file."""
    return spark.read.schema(EPOCH_RECORD).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def read_written_results(spark: SparkSession, path: str) -> DataFrame:
    """Epoch records as ``write_results`` leaves them: a line each, in folders by loader and dataset."""
    return spark.read.schema(T.StructType([*EPOCH_RECORD.fields, T.StructField("run", T.StringType())])).json(path)
