"""The three training feeds, and timing them.

Each feed reads one layout and returns sample rows with ``worker``, ``batch_id``
and ``seat`` (the sample's place in its worker's order).  Decoding always sits
after the shuffle, so encoded bytes are moved and pictures are not.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.fields import first_field, image_bytes
from feedloom.functions.images import decode_resize_images
from feedloom.operators import batching, shuffle
from feedloom.operators.numbering import number_shard_rows, number_source_rows
from feedloom.operators.sharding import assign_workers, require_feasible
from feedloom.schemas import BUFFER_ROWS, EPOCH_RECORD, FORMAT_FOLDERS, TAR_IMAGE_FIELDS, check_run
from feedloom.session import spread
from feedloom.sources import corpus, sinks
from feedloom.sources.indexed import fetch_samples

FEED_IMAGES = ["jpeg_bytes", "image", "img", *TAR_IMAGE_FIELDS]


def _decoded(df: DataFrame) -> DataFrame:
    """Image field decoded, resized and channels first; a failed sample stays, with a null picture and its ``decode_error``."""
    field = first_field(df, FEED_IMAGES, lambda t: isinstance(t, T.BinaryType))
    if field is None:
        return df
    out = decode_resize_images(df, field, "_picture")
    return out.drop(field).withColumnRenamed("_picture_error", "decode_error").withColumnRenamed("_picture", field)


def _capped(df: DataFrame, max_batches: int | None, workers: int) -> DataFrame:
    """The first ``max_batches`` batches, workers taking turns; applied before payload is fetched or decoded."""
    if max_batches is None:
        return df
    return df.where(F.col("batch_id") * workers + F.col("worker") < max_batches)


def tar_feed(
    spark: SparkSession, path: str, modality: str, batch_size: int, workers: int, seed: int = 42, epoch: int = 0,
    max_batches: int | None = None, buffer: int | None = None,
) -> DataFrame:
    """Shards in random order dealt to workers, windows shuffled inside shards, short last batches kept."""
    check_run("tar", modality, batch_size, workers)
    fields = {"text": "txt string", "images": "jpg binary", "image+text": "jpg binary, txt string"}[modality]
    rows = corpus.read_tar(spark, path, fields, shard=True, apart=True)
    sizes = corpus.read_manifest(spark, path).select(F.col("file").alias("__shard__"), "n_rows")
    n_shards = require_feasible(sizes.withColumnRenamed("__shard__", "shard_id"), workers)
    ranked = assign_workers(shuffle.shard_order(sizes, "__shard__", seed, epoch), "rank", workers)
    mixed = shuffle.window_shuffle_in_place(rows, "__shard__", "__place__", "__key__", buffer or BUFFER_ROWS[modality], seed, epoch)
    seated = batching.worker_batches(mixed, ranked, batch_size, "__shard__", "out_pos", n_shards)
    return _decoded(_capped(seated.drop("__shard__", "__place__", "out_pos", "rank"), max_batches, workers))


def indexed_feed(
    spark: SparkSession, path: str, modality: str, batch_size: int, workers: int, seed: int = 42, epoch: int = 0,
    max_batches: int | None = None,
) -> DataFrame:
    """Ids shuffled and cut evenly to workers, samples fetched by seeking; ``full`` is false in a worker's short last batch."""
    check_run("indexed", modality, batch_size, workers)
    shards = corpus.read_manifest(spark, path)
    ids = spread(shards.where("n_rows > 0"), "shard_id").select(F.explode(F.sequence("first_id", "last_id")).alias("__id__"))
    order = shuffle.index_shuffle(ids, "__id__", workers, seed, epoch)
    total = shards.agg(F.sum("n_rows").alias("n")).scalar()
    size, w = int(batch_size), int(workers)
    # A worker's slice of the order starts at ceil(worker * total / workers).
    bounds = order.withColumn("_total", total).selectExpr(
        "*", f"(worker * _total + {w - 1}) div {w} AS _first", f"((worker + 1) * _total + {w - 1}) div {w} AS _end"
    )
    seated = bounds.selectExpr("__id__", "worker", "pos - _first AS seat", f"(pos - _first) div {size} AS batch_id", f"(_end - _first) div {size} AS _full")
    seated = _capped(seated.withColumn("full", F.col("batch_id") < F.col("_full")).drop("_full"), max_batches, workers)
    return _decoded(fetch_samples(spark, path, seated, carry=["worker", "seat", "batch_id", "full"]))


def parquet_feed(
    spark: SparkSession, path: str, modality: str, batch_size: int, workers: int = 1, seed: int = 42, epoch: int = 0,
    max_batches: int | None = None,
) -> DataFrame:
    """Full random shuffle, then batches over the whole order; the short last batch stays.

    There is one stream of batches (worker 0): the cluster's cores share its work.
    """
    check_run("parquet", modality, batch_size, workers)
    order = shuffle.global_shuffle(corpus.read_parquet_shards(spark, path).drop("shard_id"), "__id__", seed, epoch, "seat")
    batches = batching.global_batches(order, batch_size, "seat").withColumn("worker", F.lit(0).cast("long"))
    return _decoded(_capped(batches, max_batches, 1))


FEEDS = {"tar": tar_feed, "indexed": indexed_feed, "parquet": parquet_feed}


def prepare(
    spark: SparkSession, modality: str, source: str, out: str, formats: tuple[str, ...] = tuple(FORMAT_FOLDERS),
    row_cap: int | None = None, **sizes,
) -> dict[str, str]:
    """Corpus to training layouts: read, number in file order, write every format asked for.

    A broken text line fails the job.  ``row_cap`` keeps the first samples only;
    without it the whole source is written.
    """
    check_run(formats[0], modality, 1)
    if modality == "text":
        numbered = number_source_rows(corpus.read_text_corpus(spark, source, strict=True))
    elif modality == "images":
        numbered = image_bytes(number_source_rows(corpus.read_image_files(spark, source)), "image", "image")
    else:
        numbered = number_shard_rows(corpus.read_tar(spark, source, "jpg binary, txt string", shard=True)).select("__id__", "jpg", "txt")
    if row_cap is not None:
        numbered = numbered.where(F.col("__id__") < row_cap)
    return sinks.write_formats(numbered, out, modality, formats, **sizes)


def time_feed(
    spark: SparkSession, loader: str, dataset: str, path: str, batch_size: int, workers: int = 4,
    epochs: int = 3, max_batches: int | None = None, seed: int = 42,
) -> DataFrame:
    """Feed rate per epoch, each epoch in a new order, as epoch records.

    Every column of every sample is consumed by a digest per batch, and an
    observation counts the batches and samples that came by.
    """
    check_run(loader, dataset, batch_size, workers)
    records = []
    for epoch in range(epochs):
        start = time.perf_counter()
        feed = FEEDS[loader](spark, path, dataset, batch_size, workers, seed, epoch, max_batches)
        digest = F.bit_xor(F.xxhash64(*feed.columns)).alias("digest")
        batches = feed.groupBy("worker", "batch_id").agg(F.count(F.lit(1)).alias("n"), digest)
        seen = Observation()
        counted = batches.observe(seen, F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
        counted.write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - start
        found = seen.get
        records.append({
            "epoch": epoch, "batches": found["batches"], "total_samples": found["samples"], "elapsed_sec": round(elapsed, 3),
            "samples_per_sec": round(found["samples"] / elapsed, 2) if elapsed > 0 else 0.0,
            "loader": loader, "dataset": dataset, "batch_size": batch_size, "num_workers": workers,
        })
    full = [{f.name: r.get(f.name) for f in EPOCH_RECORD} for r in records]
    return spark.createDataFrame(full, EPOCH_RECORD).withColumn("timestamp", F.current_timestamp())
