"""Live gauges and counters with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.metrics import finite, time_order
from feedloom.session import fresh_dir

LATENESS = "10 seconds"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Telemetry files as a stream, in order of arrival."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class End:
    """The end of a finite stream: one row, far in the future, that closes every window before it."""

    TIME = "9999-01-01 00:00:00"

    def __init__(self, spark: SparkSession, schema: T.StructType, ts: str) -> None:
        self.spark, self.schema, self.ts = spark, schema, ts
        self.path = fresh_dir(spark, "end")
        spark.createDataFrame([], schema).write.parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def come(self) -> None:
        columns = [F.lit(self.TIME if f.name == self.ts else None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1, numPartitions=1).select(*columns).write.mode("append").parquet(self.path)


def with_end(stream: DataFrame, ts: str) -> tuple[DataFrame, End]:
    """A stream and its end; the end's own window never closes, so it adds no row to a windowed result."""
    end = End(stream.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema]), ts)
    return stream.unionByName(end.stream()), end


def window_stats(readings: DataFrame, keys: list[str], value: Column, seconds: int, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Mean, peak and count per label set and tumbling window; batch or stream."""
    value = finite(value)
    stats = readings.withWatermark(ts, lateness).groupBy(F.window(ts, f"{seconds} seconds"), *keys).agg(
        F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.count(value).alias("readings")
    )
    return stats.select(F.unix_micros("window.start").alias("window_us"), *keys, "mean_value", "max_value", "readings")


def window_latest(readings: DataFrame, keys: list[str], value: str, ident: str, seconds: int, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Last value per label set and refresh window; equal times go by id."""
    last = readings.withWatermark(ts, lateness).groupBy(F.window(ts, f"{seconds} seconds"), *keys).agg(
        F.max_by(value, time_order(F.unix_micros(ts), F.col(ident))).alias("last_value")
    )
    return last.select(F.unix_micros("window.start").alias("window_us"), *keys, "last_value")


def session_spans(readings: DataFrame, keys: list[str], gap: str, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Stretches of readings per series; a silence of ``gap`` ends one.

    Sessions are merged inside each task before the shuffle, so a busy series
    sends its sessions and not its readings to one place.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    spans = readings.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *keys).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("readings")
    )
    return spans.select(
        *keys, F.unix_micros("_from").alias("start_us"), F.unix_micros("_to").alias("last_us"), "readings"
    )


def live_counters(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Batches and samples so far per run (update mode); counts are combined before the shuffle."""
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("n").alias("total_samples"),
        F.min("start_us").alias("start_us"),
        F.max("done_us").alias("done_us"),
    )


def latest_readings(batch: DataFrame, keys: list[str], value: str, ident: str, ts: str = "ts") -> DataFrame:
    """The newest reading per label set of a batch."""
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(ts, ident, value), F.struct(ts, ident)).alias("_n"))
    return newest.select(*keys, f"_n.{ts}", f"_n.{ident}", f"_n.{value}")


class Snapshots:
    """A table of current values, replaced per micro-batch.

    Every micro-batch writes ``v=<batch id>`` from the snapshot before it, so a
    micro-batch that is replayed writes the same version again.  The table has
    one row per key, whatever the length of the stream; the last few versions stay.
    """

    KEPT = 5

    def __init__(self, path: str):
        self.path = path

    def _versions(self) -> list[int]:
        from pyarrow import fs

        from feedloom.sources.shardfiles import exists, open_fs

        files, root = open_fs(self.path)
        listed = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = [f.base_name for f in listed if f.base_name.startswith("v=")]
        return sorted(int(n[2:]) for n in names if exists(files, f"{root}/{n}/_SUCCESS"))

    def _version(self, before: int | None = None) -> int | None:
        return max((v for v in self._versions() if before is None or v < before), default=None)

    def _forget_old(self) -> None:
        from feedloom.sources.shardfiles import open_fs

        files, root = open_fs(self.path)
        for version in self._versions()[: -self.KEPT]:
            files.delete_dir(f"{root}/v={version}")

    def read(self, spark: SparkSession) -> DataFrame | None:
        version = self._version()
        return None if version is None else spark.read.parquet(f"{self.path}/v={version}")

    def upsert(self, merge):
        """A foreachBatch function; ``merge(union of old and new rows)`` keeps one row per key."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            old = self._version(before=batch_id)
            rows = batch.withColumn("_batch", F.lit(batch_id))
            if old is not None:
                rows = rows.unionByName(spark.read.parquet(f"{self.path}/v={old}").withColumn("_batch", F.lit(old)))
            merge(rows).drop("_batch").write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
            self._forget_old()

        return apply


def newest_batch(keys: list[str]):
    """Merge rule: the row of the latest micro-batch wins."""

    def merge(rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c not in keys and c != "_batch"]
        picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "_batch").alias("_r"))
        return picked.select(*keys, "_r.*", F.lit(0).alias("_batch"))

    return merge


def newest_reading(keys: list[str], value: str, ident: str, ts: str = "ts"):
    """Merge rule: the reading with the latest time wins, ties by id."""

    def merge(rows: DataFrame) -> DataFrame:
        return latest_readings(rows, keys, value, ident, ts).withColumn("_batch", F.lit(0))

    return merge


def finish(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append stream over what is there now into a Parquet table."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def finish_upserts(stream: DataFrame, snapshots: Snapshots, merge, checkpoint: str, mode: str = "update") -> None:
    """Run a stream over what is there now into a snapshot table."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(snapshots.upsert(merge))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_table(spark: SparkSession, stream: DataFrame, label: str, end: End | None = None) -> DataFrame:
    """The finished table of an append stream, under the shared folder.

    Without an end, windows that the watermark hasn't passed stay open and are not in the table.
    """
    where = fresh_dir(spark, label)
    finish(stream, f"{where}/table", f"{where}/checkpoint")
    if end is not None:
        end.come()
        finish(stream, f"{where}/table", f"{where}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{where}/table")


def snapshot_table(spark: SparkSession, stream: DataFrame, merge, label: str, mode: str = "update") -> DataFrame:
    """The last snapshot of an upsert stream, under the shared folder."""
    where = fresh_dir(spark, label)
    snapshots = Snapshots(f"{where}/table")
    finish_upserts(stream, snapshots, merge, f"{where}/checkpoint", mode)
    return snapshots.read(spark)
