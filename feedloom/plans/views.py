"""The given tables seen as corpora, batch logs, gauges and result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.schemas import BATCH_SIZES
from feedloom.streaming.gauges import read_stream

SEED = 42
BATCH = 64
WORKERS = 4
BLOCKS = 8
PARQUET_ROWS = 300
TAR_ROWS = 128
TAR_SLICE = 1 << 20
BYTE_LIMIT = 262_144
BUFFER = 100
DAY_US = 86_400_000_000
GAP_US = 600_000_000
LOADERS = ["tar", "indexed", "parquet"]
EXTRA_LOADER = "parquet_materialised"
STAGES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    # A file can't be the folder a stream starts at, but what a pattern finds may be either.
    return read_stream(spark, f"{sf_dir.rstrip('/')}/{name}[.]parquet", table(spark, sf_dir, name).schema, "*")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text corpus; doc_id is dense from 0 in file order."""
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "__id__")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("__id__")


def micros(ts: str = "ts") -> Column:
    """Microseconds since the epoch of a zone-less timestamp, in any session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts))


def as_batches(events: DataFrame) -> DataFrame:
    """Each event is one batch: it arrives at ``ts``, takes ``floor(value)`` ms, has 1-128 samples."""
    got = events.withColumn("got_us", micros())
    epoch = F.floor(F.col("got_us") / F.lit(DAY_US)).cast("long")
    return got.select(
        "event_id",
        F.col("event_type").alias("run"),
        epoch.alias("epoch"),
        "got_us",
        (F.col("got_us") + F.floor("value") * 1000).cast("long").alias("done_us"),
        (epoch * F.lit(DAY_US)).alias("start_us"),
        (F.col("user_id") % 128 + 1).alias("n"),
    )


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_batches(table(spark, sf_dir, "events"))


def label_sets(events: DataFrame) -> DataFrame:
    """Loader, dataset and batch size of every event; slot 3 is the extra series at 128 only."""
    slot = F.col("user_id") % 4
    loader = F.when(slot == 3, F.lit(EXTRA_LOADER))
    for i, name in enumerate(LOADERS):
        loader = loader.when(F.col("user_id") % 3 == i, F.lit(name))
    size = F.when(slot == 0, BATCH_SIZES[0]).when(slot == 1, BATCH_SIZES[1]).otherwise(BATCH_SIZES[2])
    return events.withColumns({"loader": loader, "dataset": F.col("event_type"), "batch_size": size.cast("long")})


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge readings with their label set."""
    return label_sets(table(spark, sf_dir, "events")).select("event_id", "ts", "loader", "dataset", "batch_size", "value")


def epoch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result record per loader, dataset, batch size and epoch (day)."""
    events = label_sets(table(spark, sf_dir, "events"))
    facts = events.select(
        "loader", "dataset", "batch_size",
        F.floor(micros() / F.lit(DAY_US)).cast("long").alias("epoch"),
        (F.col("user_id") % 128 + 1).alias("n"),
        F.floor("value").cast("long").alias("ms"),
        "value",
    )
    rate = F.when(F.col("busy_ms") > 0, F.round(F.col("total_samples") * 1000.0 / F.col("busy_ms"), 2)).otherwise(F.lit(0.0))
    return (
        facts.groupBy("loader", "dataset", "batch_size", "epoch")
        .agg(
            F.count(F.lit(1)).alias("batches"), F.sum("n").alias("total_samples"),
            F.sum("ms").alias("busy_ms"), F.max("value").alias("peak_value"),
        )
        .withColumn("samples_per_sec", rate)
    )


def pixel_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-element embedding as an 8 x 8 gray picture of bytes."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", level).alias("pixels"))
