"""One query per operator, over the given tables.

Each function takes (spark, sf_dir) and returns a DataFrame; ``oracles.py`` has
the same result in SQL under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import fields, images, labels, text, udfs
from feedloom.operators import batching, greedy, inversions, metrics, numbering, pairing, quality, sharding, shuffle
from feedloom.plans import feeds, views
from feedloom.plans.views import (
    BATCH, BLOCKS, BUFFER, BYTE_LIMIT, DAY_US, EXTRA_LOADER, GAP_US, LOADERS, PARQUET_ROWS, SEED, STAGES, TAR_ROWS, TAR_SLICE, WORKERS,
)
from feedloom.schemas import BATCH_SIZES, MEMORY_BANDS, ROW_CAP, SMOKE_BATCHES, UTIL_BANDS
from feedloom.session import fresh_dir, settle
from feedloom.sources import blocks, buckets, corpus, members, sinks
from feedloom.sources.indexed import fetch_samples
from feedloom.streaming import gauges as live
from feedloom.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources and sinks -------------------------------------------------------


@query
def scan_jsonl(spark, d):
    docs = views.samples(spark, d)
    where = fresh_dir(spark, "jsonl")
    meta = F.struct(F.col("__id__").alias("doc_id"), "lang", "source").alias("meta")
    docs.select("text", meta).write.json(where)
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
    read = corpus.read_text_corpus(spark, where, shape)
    return read.select(
        F.col("meta.doc_id").alias("doc_id"), F.col("meta.lang").alias("lang"),
        F.length("text").cast("long").alias("n_chars"), F.md5(text.to_utf8("text")).alias("text_md5"),
    )


@query
def block_layout(spark, d):
    blocks = sharding.id_blocks(views.ids(spark, d), "__id__", BLOCKS)
    return blocks.groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("__id__").alias("first_id"), F.max("__id__").alias("last_id")
    )


def _tar_written(spark, d) -> str:
    where = fresh_dir(spark, "tar")
    docs = views.samples(spark, d).select("__id__", F.col("text").alias("txt"))
    sinks.write_tar(docs, where, ["txt"], TAR_ROWS)
    return where


def _indexed_written(spark, d, greedy: bool = False) -> str:
    where = fresh_dir(spark, "indexed")
    docs = views.samples(spark, d).select("__id__", "text", F.struct("lang", "source").alias("meta"))
    sinks.write_indexed(sinks.indexed_rows(docs, "text"), where, BYTE_LIMIT, "text", greedy)
    return where


@query
def tar_roundtrip(spark, d):
    read = corpus.read_tar(spark, _tar_written(spark, d), shard=True)
    return read.select(
        F.col("__key__").alias("sample_key"), F.col("__shard__").alias("shard"),
        text.utf8_bytes("txt").alias("n_bytes"), F.md5(text.to_utf8("txt")).alias("text_md5"),
    )


@query
def indexed_roundtrip(spark, d):
    read = corpus.read_indexed(spark, _indexed_written(spark, d))
    return read.select(F.col("__id__").alias("doc_id"), "meta", F.md5(text.to_utf8("text")).alias("text_md5"))


@query
def indexed_greedy(spark, d):
    """Strict byte limit: every sample comes back, and no shard file of several rows exceeds the limit."""
    where = _indexed_written(spark, d, greedy=True)
    shards = corpus.read_manifest(spark, where)
    files = corpus.list_shards(spark, where, "*.mds").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("bytes").alias("file_bytes"))
    checked = shards.join(files, "file").agg(
        F.sum("n_rows").cast("long").alias("n_rows"),
        metrics.as_count((F.col("file_bytes") > BYTE_LIMIT) & (F.col("n_rows") > 1)).alias("oversized"),
        F.sum(F.col("last_id") - F.col("first_id") + 1).cast("long").alias("covered_ids"),
    )
    return checked


@query
def random_access(spark, d):
    """Every sample fetched by id through manifest and seek, then compared by digest."""
    where = _indexed_written(spark, d)
    got = fetch_samples(spark, where, views.ids(spark, d))
    return got.select(F.col("__id__").alias("doc_id"), F.md5(text.to_utf8("text")).alias("text_md5"))


@query
def pushed_slices(spark, d):
    """Three id ranges of an indexed layout, and the same keys of a tar layout; only their shards are opened."""
    indexed, tar = _indexed_written(spark, d), _tar_written(spark, d)
    n, out = views.ids(spark, d).count(), None
    for start, end in ((n // 10, n // 10 + 100), (n // 2, n // 2 + 40), (n - 30, n)):
        ids = (start, end - 1)
        by_id = corpus.read_indexed(spark, indexed, ids).select(F.lit("indexed").alias("format"), F.col("__id__").alias("doc_id"), F.md5(text.to_utf8("text")).alias("text_md5"))
        by_key = corpus.read_tar(spark, tar, ids=ids).select(F.lit("tar").alias("format"), F.col("__key__").cast("long").alias("doc_id"), F.md5(text.to_utf8("txt")).alias("text_md5"))
        part = by_id.unionByName(by_key).withColumn("slice_start", F.lit(start).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def tar_index(spark, d):
    """Tar members by an index of their offsets, and their bodies read by seek in slices of a few samples."""
    index = members.index_tars(spark, _tar_written(spark, d))
    body = members.read_members(index, "`__shard__` string, `__place__` long, txt string", TAR_SLICE)
    held = index.select(
        F.element_at(F.split("file", "/"), -1).alias("shard"), F.col("place"), F.col("key").alias("sample_key"), "field", "offset", F.col("size").alias("n_bytes")
    )
    read = body.select(F.col("__shard__").alias("shard"), F.col("__place__").alias("place"), F.md5(text.to_utf8("txt")).alias("text_md5"))
    return held.join(read, ["shard", "place"])


@query
def bucketed_epochs(spark, d):
    """Three epochs over a payload that is bucketed once; after that only ids move."""
    docs = views.samples(spark, d).select("__id__", "text")
    payload, out = buckets.write_buckets(docs, fresh_dir(spark, "buckets"), "__id__"), None
    for epoch in range(3):
        order = shuffle.index_shuffle(views.ids(spark, d), "__id__", WORKERS, SEED, epoch)
        part = buckets.fetch_bucketed(order, payload, "__id__").select(
            F.lit(epoch).cast("long").alias("epoch"), "worker", "pos", F.col("__id__").alias("doc_id"), F.md5(text.to_utf8("text")).alias("text_md5")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def feed_blocks(spark, d):
    """Two epochs of a Parquet layout in block order: a partition per row group, then as many as there are workers."""
    where = fresh_dir(spark, "parquet")
    sinks.write_parquet_shards(views.samples(spark, d).select("__id__", "text"), where, PARQUET_ROWS)
    splits, out = blocks.block_splits(spark, f"{where}/data"), None
    wanted = T.StructType([T.StructField("__id__", T.LongType()), T.StructField("text", T.StringType())])
    for epoch in (0, 1):
        fed = blocks.read_blocks(blocks.block_order(splits, SEED, epoch), wanted, WORKERS if epoch else None)
        part = fed.select(
            F.lit(epoch).cast("long").alias("epoch"), F.col("__id__").alias("doc_id"), F.col("__block__").alias("block_rank"),
            F.col("__place__").alias("place"), F.md5(text.to_utf8("text")).alias("text_md5"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def mapped_samples(spark, d):
    """A user function over every stored sample of a tar layout."""
    read = corpus.read_tar(spark, _tar_written(spark, d)).select(F.col("__key__").alias("sample_key"), "txt")
    return udfs.map_samples(read, _line_facts, "sample_key string, n_lines long, longest_line long")


def _line_facts(sample: dict) -> dict:
    lines = (sample["txt"] or "").split("\n")
    return {"sample_key": sample["sample_key"], "n_lines": len(lines), "longest_line": max(map(len, lines))}


@query
def layout_pairs(spark, d):
    """Samples with two members stored in tar shards, read back by key and paired again."""
    where = fresh_dir(spark, "pairs")
    docs = views.samples(spark, d).select("__id__", F.col("text").alias("txt"))
    notes = views.table(spark, d, "labels").select(F.col("doc_id").alias("__id__"), F.concat_ws(":", "quality", "toxic").alias("cls"))
    sinks.write_tar(docs.join(notes, "__id__", "left"), where, ["txt", "cls"], TAR_ROWS)
    read = corpus.read_tar(spark, where, "txt string, cls string")
    members = read.where("cls IS NOT NULL").select("__key__", "cls")
    pairs = pairing.pair(read.select("__key__", "txt"), members, "__key__")
    return pairs.select(F.col("__key__").alias("sample_key"), "cls", F.md5(text.to_utf8("txt")).alias("text_md5"))


@query
def shard_list(spark, d):
    """The shard names a tar layout publishes in its list, each with the rows found in that shard."""
    where = _tar_written(spark, d)
    rows = corpus.read_tar(spark, where, shard=True).groupBy(F.col("__shard__").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return corpus.read_shard_list(spark, where).join(rows, "file", "left")


@query
def results_roundtrip(spark, d):
    """Epoch records written by loader and dataset, and read back."""
    where = fresh_dir(spark, "results")
    records = views.epoch_results(spark, d).withColumn("num_workers", F.lit(WORKERS))
    sinks.write_results(records, where)
    read = corpus.read_written_results(spark, where)
    whole = [F.col(c).cast("long").alias(c) for c in ("batch_size", "num_workers", "epoch", "total_samples")]
    return read.select("run", "loader", "dataset", *whole, "samples_per_sec")


@query
def fanout_formats(spark, d):
    """Three layouts from one read; each must hold the same samples."""
    docs = views.samples(spark, d).select("__id__", "text", F.struct("lang", "source").alias("meta"))
    paths = sinks.write_formats(docs, fresh_dir(spark, "fanout"), "text", parquet_rows=PARQUET_ROWS, tar_rows=TAR_ROWS, limit=BYTE_LIMIT)
    parts = []
    for fmt, path in paths.items():
        df = corpus.read_layout(spark, fmt, path)
        ident = F.col("__key__").cast("long") if fmt == "tar" else F.col("__id__")
        parts.append(df.select(F.lit(fmt).alias("format"), ident.alias("doc_id"), F.md5(text.to_utf8(fields.text_column(df))).alias("text_md5")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def parquet_shards(spark, d):
    laid = sharding.count_shards(views.ids(spark, d), "__id__", PARQUET_ROWS)
    name = labels.parquet_shard_name(F.col("shard_id"), F.col("n_shards"))
    return laid.groupBy("shard_id", name.alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("__id__").alias("first_id"), F.max("__id__").alias("last_id")
    )


@query
def tar_shards(spark, d):
    """The manifest a tar write leaves behind."""
    return corpus.read_manifest(spark, _tar_written(spark, d))


def _tar_manifest(spark, d) -> DataFrame:
    docs = views.samples(spark, d).select("__id__", text.utf8_bytes("text").alias("bytes"))
    return sharding.manifest(sharding.fixed_shards(docs, "__id__", TAR_ROWS), "__id__", F.col("bytes"))


@query
def shard_manifest(spark, d):
    return _tar_manifest(spark, d).select(labels.tar_shard_name(F.col("shard_id")).alias("file"), "n_rows", "bytes")


def _byte_manifest(spark, d) -> DataFrame:
    sizes = settle(views.samples(spark, d).select("__id__", text.utf8_bytes("text").alias("bytes")), "sizes")
    return sharding.byte_manifest(sizes, "__id__", "bytes", BYTE_LIMIT)


@query
def byte_shards(spark, d):
    return _byte_manifest(spark, d)


@query
def greedy_shards(spark, d):
    """The strict byte limit over the whole corpus as one sequential rule, computed by ranges of 64 ids."""
    sizes = settle(views.samples(spark, d).select("__id__", text.utf8_bytes("text").alias("bytes")), "sizes")
    return greedy.greedy_manifest(sizes, "__id__", "bytes", BYTE_LIMIT, bits=6)


@query
def resolve_samples(spark, d):
    """Id to shard and place, through the byte manifest and by arithmetic."""
    found = sharding.locate(views.ids(spark, d), "__id__", _byte_manifest(spark, d))
    fixed = sharding.locate_fixed("__id__", TAR_ROWS)
    return found.select(
        F.col("__id__").alias("doc_id"), "shard_id", "place",
        fixed["shard_id"].alias("fixed_shard"), fixed["place"].alias("fixed_place"),
    )


@query
def storage_footprint(spark, d):
    """Size of the tar layout on disk, and of its payload."""
    where = _tar_written(spark, d)
    disk = sinks.storage_footprint(spark, where, "*.tar").select(F.lit("tar files").alias("what"), "files", "bytes", "gb")
    held = corpus.read_manifest(spark, where).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    held = held.select(F.lit("payload").alias("what"), "files", "bytes", F.round(F.col("bytes") / 1e9, 6).alias("gb"))
    return disk.unionByName(held)


@query
def shard_balance(spark, d):
    return sharding.balance(_byte_manifest(spark, d))


# ---- scalar functions --------------------------------------------------------


@query
def dense_ids(spark, d):
    """Numbers from the file order, against numbers from the id order."""
    docs = views.table(spark, d, "documents").select("doc_id")
    by_file = numbering.number_source_rows(docs, "file_pos")
    return numbering.number_by_id(by_file, "doc_id", "sample_id")


@query
def id_range(spark, d):
    """The corpus cut into [start, end) slices of 250 ids."""
    cut = sharding.slices(views.samples(spark, d).select("__id__", "n_chars"), "__id__", 250)
    return cut.groupBy("slice_start", "slice_end").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("__id__").alias("first_id"), F.max("__id__").alias("last_id"), F.sum("n_chars").alias("n_chars")
    )


@query
def sample_keys(spark, d):
    return views.ids(spark, d).select(F.col("__id__").alias("doc_id"), text.sample_key("__id__").alias("sample_key"))


@query
def utf8_sizes(spark, d):
    docs = views.samples(spark, d).select("__id__", "text", text.to_utf8("text").alias("raw"))
    back = text.as_text("raw", docs.schema["raw"].dataType)
    return docs.select(
        F.col("__id__").alias("doc_id"), text.utf8_bytes("text").alias("n_bytes"),
        F.length(back).cast("long").alias("n_chars"), (back == F.col("text")).alias("same"),
    )


@query
def meta_json(spark, d):
    events = views.table(spark, d, "events")
    meta = events.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    packed = meta.select("event_id", F.struct("event_type", "k").alias("meta"))
    return packed.select("event_id", text.meta_text("meta", packed.schema["meta"].dataType).alias("meta"))


@query
def first_field(spark, d):
    """The text field of differently named tables, and a value-time fallback."""
    names = ["text", "txt", "__text__", "html"]
    out = None
    for name in ("benchmark", "conversations", "documents", "pages"):
        df = views.table(spark, d, name)
        body = fields.text_column(df, names)
        part = df.select(F.lit(name).alias("corpus"), F.lit(fields.first_field(df, names)).alias("field"), body.alias("body"))
        out = part if out is None else out.unionByName(part)
    filled = fields.first_present("body", "corpus")
    return out.groupBy("corpus", "field").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(filled)).cast("long").alias("n_chars")
    )


@query
def char_tokens(spark, d):
    tokens = text.char_tokens("text")
    return views.samples(spark, d).select(F.col("__id__").alias("doc_id"), F.array_join(tokens, ",").alias("tokens"))


@query
def padded_tokens(spark, d):
    """Whole texts as sequences of equal width."""
    docs = views.samples(spark, d).select(F.col("__id__").alias("doc_id"), text.char_tokens("text").alias("ids"))
    docs = text.token_sequences(docs, "ids")
    weighted = F.zip_with("ids", F.sequence(F.lit(1), F.size("ids")), lambda t, i: t.cast("long") * i)
    return docs.select(
        "doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("ids").cast("long").alias("width"),
        F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"),
    )


@query
def normalise_vectors(spark, d):
    vectors = views.table(spark, d, "embeddings")
    return vectors.select("vec_id", F.posexplode(images.normalise_vector("embedding")).alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), "x"
    )


@query
def stack_vectors(spark, d):
    stacked = batching.stack_vectors(views.table(spark, d, "embeddings"), "vec_id", "embedding", BATCH)
    cell = F.zip_with("data", F.sequence(F.lit(1), F.size("data")), lambda x, i: F.floor(x.cast("double") * 1000000).cast("long") * i)
    return stacked.select(
        "batch_id", F.array_join("shape", "x").alias("shape"),
        F.aggregate(cell, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"),
    )


def _pictures(spark, d) -> DataFrame:
    """Each embedding as an encoded 8 x 8 picture."""
    drawn = views.pixel_vectors(spark, d).select("vec_id", images.vector_tensor("pixels", 8, 8).alias("picture"))
    return images.encode_images(drawn, "picture").select("vec_id", "encoded")


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


@query
def decoded_images(spark, d):
    """Vectors drawn as pictures, encoded losslessly, decoded to RGB."""
    good, _ = images.split_errors(images.decode_images(_pictures(spark, d), "encoded"), "image")
    return good.select("vec_id", F.array_join("image.shape", "x").alias("shape"), F.md5("image.data").alias("pixels_md5"))


@query
def resized_images(spark, d):
    """The same pictures enlarged to 224 x 224, channels first; encoded bytes are spread before the work grows."""
    resized = images.decode_resize_images(_pictures(spark, d), "encoded", partitions=_cores(spark))
    good, _ = images.split_errors(resized, "image")
    return good.select("vec_id", F.array_join("image.shape", "x").alias("shape"), F.md5("image.data").alias("pixels_md5"))


@query
def series_labels(spark, d):
    sets = views.gauges(spark, d).groupBy("loader", "dataset", "batch_size").agg(F.count(F.lit(1)).alias("readings"))
    name = labels.series_label(F.col("loader"), F.col("dataset"), F.col("batch_size"))
    return sets.select(name.alias("series"), labels.short_label(F.col("loader"), F.col("batch_size")).alias("short_series"), "readings")


@query
def run_names(spark, d):
    runs = views.epoch_results(spark, d).withColumn("num_workers", F.lit(WORKERS))
    name = labels.run_name(*[F.col(c) for c in ("loader", "dataset", "batch_size", "num_workers", "epoch")])
    return runs.select(name.alias("run"), "total_samples")


@query
def stamped_results(spark, d):
    """Result records completed with the settings of their experiment."""
    datasets = views.table(spark, d, "events").select(F.col("event_type").alias("dataset")).distinct()
    grid = pairing.experiment_matrix(datasets, loader=[*LOADERS, EXTRA_LOADER], batch_size=BATCH_SIZES)
    settings = grid.select(
        "dataset", "loader", F.col("batch_size").cast("long").alias("batch_size"),
        F.lit(WORKERS).cast("long").alias("num_workers"), F.lit("cpu").alias("gpu_name"), F.lit("local").alias("hostname"),
    )
    results = views.epoch_results(spark, d).select("loader", "dataset", "batch_size", "epoch", "samples_per_sec")
    return metrics.stamp_results(results, settings, ["dataset", "loader", "batch_size"]).drop("timestamp")


# ---- filters and validation --------------------------------------------------


@query
def row_cap(spark, d):
    """The portion of 10,000 samples, in source order, that each sample is in."""
    orders = views.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    numbered = numbering.number_by_id(orders, "o_orderkey", "__id__")
    return sharding.row_caps(numbered, "__id__", ROW_CAP).select(F.col("__id__").alias("sample_id"), "portion", "o_orderkey", "o_totalprice")


@query
def batch_cap(spark, d):
    """The smoke run of 20 batches that each batch of the epoch is in."""
    order = shuffle.global_shuffle(views.ids(spark, d), "__id__", SEED)
    runs = batching.smoke_runs(batching.global_batches(order, BATCH), SMOKE_BATCHES)
    chars = shuffle.fetch(runs, views.samples(spark, d).select("__id__", "n_chars"), "__id__")
    return chars.groupBy("smoke_run", "batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@query
def nonempty_samples(spark, d):
    """Samples per run, epoch and hour; hours without batches count 0."""
    batches = views.batch_log(spark, d)
    hour = F.floor(F.col("got_us") % DAY_US / 3_600_000_000).cast("long").alias("hour")
    counts = batches.groupBy("run", "epoch", hour).agg(F.sum("n").alias("samples"))
    grid = batches.select("run", "epoch").distinct().withColumn("hour", F.explode(F.expr("sequence(0L, 23L)")))
    return batching.nonempty(grid, counts, ["run", "epoch", "hour"], "samples")


@query
def starved_workers(spark, d):
    return sharding.starved_workers(_tar_manifest(spark, d), [4, 8, 16, 128])


@query
def shape_check(spark, d):
    docs = views.samples(spark, d).select("__id__", F.expr("n_chars div 500").alias("shape"))
    return batching.shape_check(batching.global_batches(docs, BATCH, "__id__"), ["batch_id"], F.col("shape"))


@query
def shape_batches(spark, d):
    """Batches of one shape along the shuffled order; the rests of all shapes come last, marked."""
    docs = views.samples(spark, d).select("__id__", F.expr("n_chars div 500").alias("shape"))
    batches = batching.shape_batches(shuffle.global_shuffle(docs, "__id__", SEED), "shape", BATCH // 4)
    return batches.withColumnRenamed("__id__", "doc_id")


@query
def time_range(spark, d):
    """The readings of an absolute time range; both bounds reach the scan."""
    readings = views.table(spark, d, "events")
    low, high = F.expr("TIMESTAMP_NTZ '2024-01-08 04:59:48.017'"), F.expr("TIMESTAMP_NTZ '2024-01-22 06:15:29.096'")
    return readings.where(F.col("ts").between(low, high)).select("event_id", views.micros().alias("ts_us"), "value")


@query
def nonnull_series(spark, d):
    """Chart points without the series that have no value at any point."""
    points = _chart_points(spark, d)
    return metrics.nonnull_series(points, ["loader", "batch_size"], "samples_per_sec")


# ---- orders ------------------------------------------------------------------


@query
def global_shuffle(spark, d):
    return shuffle.global_shuffle(views.ids(spark, d), "__id__", SEED).select(F.col("__id__").alias("doc_id"), "pos")


@query
def shuffled_rows(spark, d):
    """Rows moved into the epoch's order with their text; the order is read off the partitions."""
    docs = views.samples(spark, d).select("__id__", "text")
    moved = shuffle.shuffled_partitions(docs, "__id__", SEED)
    return moved.select(F.col("__id__").alias("doc_id"), F.md5(text.to_utf8("text")).alias("text_md5"))


@query
def buffer_shuffle(spark, d):
    """Windows of 100 rows inside shards of 128."""
    docs = views.ids(spark, d).withColumn("in_pos", F.col("__id__") % TAR_ROWS)
    out = shuffle.window_shuffle(docs, F.expr(f"__id__ div {TAR_ROWS}"), "in_pos", "__id__", BUFFER, SEED)
    return out.select(F.col("__id__").alias("doc_id"), "out_pos")


@query
def buffer_stream(spark, d):
    """A buffer of 100 rows over shards of 128: no row comes out 100 places early or late."""
    docs = views.ids(spark, d).withColumn("in_pos", F.col("__id__") % TAR_ROWS)
    out = shuffle.buffer_order(docs, F.expr(f"__id__ div {TAR_ROWS}"), "in_pos", "__id__", BUFFER, SEED)
    return out.select(F.col("__id__").alias("doc_id"), "out_pos")


def _shard_ids(spark, d) -> DataFrame:
    return views.ids(spark, d).select(F.expr(f"__id__ div {TAR_ROWS}").alias("shard_id")).distinct()


@query
def shard_shuffle(spark, d):
    return shuffle.shard_order(_shard_ids(spark, d), "shard_id", SEED)


@query
def worker_round_robin(spark, d):
    return sharding.assign_workers(shuffle.shard_order(_shard_ids(spark, d), "shard_id", SEED), "rank", WORKERS)


@query
def index_shuffle(spark, d):
    return shuffle.index_shuffle(views.ids(spark, d), "__id__", WORKERS, SEED).withColumnRenamed("__id__", "doc_id")


@query
def index_shuffle_fetch(spark, d):
    """Index order first, whole texts fetched by id afterwards."""
    order = shuffle.index_shuffle(views.ids(spark, d), "__id__", WORKERS, SEED)
    fetched = shuffle.fetch(order, views.samples(spark, d).select("__id__", "text"), "__id__")
    return fetched.select("worker", "pos", F.col("__id__").alias("doc_id"), F.md5(text.to_utf8("text")).alias("text_md5"))


@query
def block_shuffle(spark, d):
    blocks = sharding.id_blocks(views.ids(spark, d), "__id__", BLOCKS)
    return shuffle.block_shuffle(blocks, "block", "__id__", SEED, blocks=BLOCKS).withColumnRenamed("__id__", "doc_id")


@query
def materialised_epochs(spark, d):
    """One full shuffle written once, then cheap block orders for two more epochs."""
    where = fresh_dir(spark, "materialised")
    shuffle.global_shuffle(views.ids(spark, d), "__id__", SEED).write.parquet(where)
    stored = spark.read.parquet(where).withColumnRenamed("pos", "place")
    blocks = sharding.id_blocks(stored, "place", BLOCKS)
    out = None
    for epoch in (1, 2):
        turn = shuffle.block_shuffle(blocks, "block", "place", SEED, epoch, BLOCKS)
        part = turn.select(F.lit(epoch).cast("long").alias("epoch"), F.col("__id__").alias("doc_id"), "pos")
        out = part if out is None else out.unionByName(part)
    return out


@query
def epoch_orders(spark, d):
    return shuffle.epoch_orders(views.ids(spark, d), "__id__", 3, SEED).withColumnRenamed("__id__", "doc_id")


def _orders(spark, d) -> DataFrame:
    """(method, id, pos) of the four shuffles."""
    base = views.ids(spark, d)
    everywhere = shuffle.global_shuffle(base, "__id__", SEED)
    blocks = shuffle.block_shuffle(sharding.id_blocks(base, "__id__", BLOCKS), "block", "__id__", SEED, blocks=BLOCKS)
    shards = shuffle.block_shuffle(sharding.fixed_shards(base, "__id__", TAR_ROWS), "shard_id", "__id__", SEED)
    placed = base.withColumn("in_pos", F.col("__id__") % TAR_ROWS)
    windows = shuffle.window_shuffle(placed, F.expr(f"__id__ div {TAR_ROWS}"), "in_pos", "__id__", BUFFER, SEED)
    windows = windows.withColumn("pos", F.expr(f"__id__ div {TAR_ROWS} * {TAR_ROWS} + out_pos"))
    out = None
    for name, df in {"global": everywhere, "block": blocks, "shard": shards, "buffer": windows}.items():
        part = df.select(F.lit(name).alias("method"), F.col("__id__").alias("id"), "pos")
        out = part if out is None else out.unionByName(part)
    return out


@query
def shuffle_quality(spark, d):
    return quality.shuffle_quality(_orders(spark, d))


@query
def order_inversions(spark, d):
    """How many pairs of samples each shuffle turns round, in ranges of 256 ids and positions."""
    orders = settle(_orders(spark, d), "orders")
    turned = inversions.order_inversions(orders, ["method"], bits=8)
    return turned.withColumn("inversions", F.col("inversions").cast("long"))


@query
def batch_mix(spark, d):
    """How far the languages of every shuffled batch are from those of the corpus."""
    placed = shuffle.global_shuffle(views.samples(spark, d).select("__id__", "lang"), "__id__", SEED)
    return inversions.batch_mix(batching.global_batches(placed, BATCH), "batch_id", "lang")


# ---- batches -----------------------------------------------------------------


@query
def batches_partial(spark, d):
    """Batches inside each worker over its shuffled shards; short last batches stay."""
    docs = sharding.fixed_shards(views.samples(spark, d).select("__id__", "n_chars"), "__id__", TAR_ROWS)
    sizes = docs.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_rows"))
    ranked = sharding.assign_workers(shuffle.shard_order(sizes, "shard_id", SEED), "rank", WORKERS)
    placed = docs.withColumn("place", F.col("__id__") % TAR_ROWS)
    batches = batching.worker_batches(placed, ranked, BATCH, "shard_id", "place")
    return batches.groupBy("worker", "batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("__id__").alias("min_id"), F.max("__id__").alias("max_id"), F.sum("n_chars").alias("n_chars")
    )


def _ordered(spark, d, *columns: str) -> DataFrame:
    return shuffle.global_shuffle(views.samples(spark, d).select("__id__", *columns), "__id__", SEED)


@query
def batches_drop_last(spark, d):
    """Batches over the whole order; the short last one is told apart."""
    batches = batching.full_batches(_ordered(spark, d, "n_chars"), BATCH)
    return batches.groupBy("batch_id", "full").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("__id__").alias("id_sum"), F.sum("n_chars").alias("n_chars"))


@query
def batches_global(spark, d):
    batches = batching.global_batches(_ordered(spark, d, "n_chars"), BATCH)
    return batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("__id__").alias("id_sum"), F.sum("n_chars").alias("n_chars"))


@query
def block_batches(spark, d):
    return batching.block_batches(sharding.id_blocks(views.ids(spark, d), "__id__", BLOCKS), "block", BATCH)


@query
def collate_text(spark, d):
    """Whole texts of a batch as one ordered list."""
    batches = batching.global_batches(_ordered(spark, d, "text"), BATCH)
    rows = batching.collate(batches, ["batch_id"], "pos", ["__id__", "text"])
    return rows.select("batch_id", "n_rows", F.array_join("__id__", ",").alias("doc_ids"), F.md5(text.to_utf8(F.array_join("text", "|"))).alias("texts_md5"))


@query
def batch_tokens(spark, d):
    """The flagship: corpus, epoch order, batches, character tokens, padding."""
    counted = views.samples(spark, d).select("__id__", text.token_count("text").alias("tokens"), text.sequence_count("text").alias("sequences"))
    order = shuffle.global_shuffle(counted, "__id__", SEED)
    return batching.batch_tokens(batching.global_batches(order, BATCH), F.col("tokens"), F.col("sequences"))


@query
def inflight_bytes(spark, d):
    blocks = sharding.id_blocks(views.ids(spark, d), "__id__", BLOCKS).groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))
    return batching.inflight_bytes(blocks)


@query
def feed_tar(spark, d):
    """The tar feed from written shards: two workers, 100-row windows, partial batches."""
    feed = feeds.tar_feed(spark, _tar_written(spark, d), "text", BATCH, 2, SEED, buffer=BUFFER)
    return feed.select(F.col("__key__").alias("sample_key"), "worker", "seat", "batch_id", text.token_count("txt").alias("n_tokens"))


@query
def feed_indexed(spark, d):
    """The indexed feed from written shards: two workers, samples fetched by seek, short batches told apart."""
    feed = feeds.indexed_feed(spark, _indexed_written(spark, d), "text", BATCH, 2, SEED)
    return feed.select(F.col("__id__").alias("doc_id"), "worker", "seat", "batch_id", "full", text.token_count("text").alias("n_tokens"))


@query
def feed_parquet(spark, d):
    """The Parquet feed from written shards: one stream of batches over the full shuffle."""
    where = fresh_dir(spark, "parquet")
    sinks.write_parquet_shards(views.samples(spark, d).select("__id__", "text"), where, PARQUET_ROWS, "text")
    feed = feeds.parquet_feed(spark, where, "text", BATCH, seed=SEED)
    return feed.select(F.col("__id__").alias("doc_id"), "worker", "seat", "batch_id", text.token_count("text").alias("n_tokens"))


@query
def prepare_corpus(spark, d):
    """JSONL files to layouts; ids follow the file order."""
    source = fresh_dir(spark, "source")
    docs = views.samples(spark, d).select("__id__", "text", F.struct("lang", "source").alias("meta"))
    docs.repartitionByRange("__id__").sortWithinPartitions("__id__").drop("__id__").write.json(source)
    paths = feeds.prepare(spark, "text", source, fresh_dir(spark, "prepared"), ("parquet", "indexed"), parquet_rows=PARQUET_ROWS, limit=BYTE_LIMIT)
    stored, indexed = corpus.read_layout(spark, "parquet", paths["parquet"]), corpus.read_layout(spark, "indexed", paths["indexed"])
    rows = stored.select(F.lit("parquet").alias("format"), "__id__", "text", "meta").unionByName(
        indexed.select(F.lit("indexed").alias("format"), "__id__", "text", "meta")
    )
    return rows.select("format", F.col("__id__").alias("doc_id"), "meta", F.md5(text.to_utf8("text")).alias("text_md5"))


# ---- joins and grids ---------------------------------------------------------


@query
def pair_samples(spark, d):
    captions = views.table(spark, d, "labels")
    docs = views.table(spark, d, "documents").select("doc_id", "n_chars")
    pairs = pairing.pair(docs, captions, "doc_id")
    return pairs.select(text.sample_key("doc_id").alias("sample_key"), "n_chars", "quality", "toxic")


@query
def unpaired_samples(spark, d):
    return pairing.unpaired(views.table(spark, d, "documents"), views.table(spark, d, "labels"), "doc_id", "document", "label")


@query
def tar_entries(spark, d):
    """Paired samples taken apart into entries, sizes regained per sample."""
    pairs = pairing.pair(views.table(spark, d, "documents").select("doc_id", "text"), views.table(spark, d, "labels"), "doc_id")
    named = pairs.select(text.sample_key("doc_id").alias("sample_key"), "text", F.col("quality").cast("string").alias("cls"))
    return pairing.sample_entries(named, "sample_key", {"txt": "text", "cls": "cls"})


@query
def experiment_matrix(spark, d):
    """Every loader and batch size for each dataset seen, with the batches it already has."""
    datasets = views.table(spark, d, "events").select(F.col("event_type").alias("dataset")).distinct()
    grid = pairing.experiment_matrix(datasets, loader=LOADERS, batch_size=BATCH_SIZES).withColumn("batch_size", F.col("batch_size").cast("long"))
    done = views.epoch_results(spark, d).groupBy("dataset", "loader", "batch_size").agg(F.sum("batches").alias("batches"))
    return batching.nonempty(grid, done, ["dataset", "loader", "batch_size"], "batches")


def _averages(spark, d) -> DataFrame:
    averages = metrics.epoch_average(views.epoch_results(spark, d), ["loader", "dataset", "batch_size"], ["samples_per_sec", "peak_value"])
    return _shown(averages)


def _shown(averages: DataFrame) -> DataFrame:
    """Means to six digits behind the point: their last digits depend on the order of summation."""
    return averages.withColumns({m: F.round(m, 6) for m in ("samples_per_sec", "peak_value")})


def _chart_points(spark, d) -> DataFrame:
    """Averages of the regular loaders, and the extra series at every batch size."""
    known = _averages(spark, d).select("loader", "dataset", "batch_size", "samples_per_sec")
    extra = F.col("loader") == EXTRA_LOADER
    return metrics.append_series(known, extra, ["loader", "dataset"], "batch_size", BATCH_SIZES, "samples_per_sec")


@query
def append_series(spark, d):
    return _chart_points(spark, d)


# ---- feed analytics ----------------------------------------------------------

RUN = ["run", "epoch"]


def _timeline(spark, d) -> DataFrame:
    return metrics.batch_timeline(views.batch_log(spark, d), RUN)


@query
def epoch_metrics(spark, d):
    return metrics.epoch_metrics(views.batch_log(spark, d), RUN)


@query
def data_stall(spark, d):
    return metrics.data_stall(views.batch_log(spark, d), RUN)


@query
def stage_shares(spark, d):
    times = views.table(spark, d, "events").select("user_id", "event_type", (F.floor("value") * 1000).cast("long").alias("us"))
    return metrics.stage_shares(times, ["user_id"], "event_type", "us", STAGES)


@query
def gauge_summary(spark, d):
    """Five gauges, each an event type; other rows are absent readings."""
    readings = views.gauges(spark, d)
    of = lambda kind: F.when(F.col("dataset") == kind, F.col("value"))
    return metrics.gauge_summary(readings, ["loader", "batch_size"], of("view"), of("click"), of("error"), of("purchase"), of("signup"))


@query
def epoch_average(spark, d):
    return _averages(spark, d)


@query
def comparison_pivot(spark, d):
    """Metric rows against loader/batch-size columns, per dataset-free average."""
    results = views.epoch_results(spark, d)
    averages = _shown(metrics.epoch_average(results, ["loader", "batch_size"], ["samples_per_sec", "peak_value"]))
    names = [f"{loader}_{size}" for loader in LOADERS for size in BATCH_SIZES] + [f"{EXTRA_LOADER}_128"]
    return metrics.comparison_pivot(averages, ["samples_per_sec", "peak_value"], F.format_string("%s_%d", "loader", "batch_size"), names)


@query
def panel_stats(spark, d):
    return metrics.panel_stats(views.gauges(spark, d), ["loader", "dataset", "batch_size"], F.col("value"))


@query
def threshold_bands(spark, d):
    readings = views.gauges(spark, d)
    util = metrics.threshold_bands(readings, ["loader"], F.col("value"), UTIL_BANDS).withColumn("panel", F.lit("util"))
    memory = metrics.threshold_bands(readings, ["loader"], F.col("value"), MEMORY_BANDS).withColumn("panel", F.lit("memory"))
    return util.unionByName(memory)


@query
def corpus_profile(spark, d):
    docs = views.samples(spark, d)
    return docs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(docs.columns)).cast("long").alias("n_columns"),
        F.min(F.length("text")).cast("long").alias("min_chars"),
        F.max(F.length("text")).cast("long").alias("max_chars"),
        F.round(F.avg(F.length("text")), 4).alias("avg_chars"),
        F.sum(text.utf8_bytes("text")).alias("n_bytes"),
        F.min_by(F.length("text"), "__id__").cast("long").alias("first_chars"),
    )


@query
def baseline_ratio(spark, d):
    return metrics.baseline_ratio(
        _averages(spark, d), ["dataset", "batch_size"], F.col("loader"), "parquet", "samples_per_sec"
    ).select("loader", "dataset", "batch_size", "samples_per_sec", "ratio")


@query
def batch_waits(spark, d):
    return _timeline(spark, d).select("run", "epoch", "i", "wait_us")


@query
def running_rate(spark, d):
    return metrics.running_rate(_timeline(spark, d)).select("run", "epoch", "i", "samples", "running_sps")


@query
def active_batches(spark, d):
    """Batches and waits per capture phase."""
    phased = _timeline(spark, d).withColumn("phase", metrics.capture_phase(F.col("i")))
    return phased.groupBy("run", "epoch", "phase").agg(F.count(F.lit(1)).alias("batches"), F.sum("wait_us").alias("wait_us"), F.sum("n").alias("samples"))


@query
def first_batch_latency(spark, d):
    return metrics.first_batch_latency(views.batch_log(spark, d), RUN)


# ---- telemetry ---------------------------------------------------------------

SERIES = ["loader", "dataset", "batch_size"]


@query
def gauge_windows(spark, d):
    """One-second means and peaks per label set."""
    readings = views.gauges(spark, d).withColumn("second", F.floor(views.micros() / 1_000_000).cast("long"))
    value = metrics.finite(F.col("value"))
    return readings.groupBy(*SERIES, "second").agg(
        F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.count(value).alias("readings")
    )


@query
def gauge_latest(spark, d):
    """Last value per label set at each five-second refresh."""
    readings = views.gauges(spark, d).withColumn("refresh", F.floor(views.micros() / 5_000_000).cast("long"))
    return readings.groupBy(*SERIES, "refresh").agg(F.max_by("value", metrics.time_order(views.micros(), F.col("event_id"))).alias("last_value"))


@query
def gauge_visible(spark, d):
    """What each series shows at every refresh of a minute's grid, with readings up to five minutes old."""
    readings = views.gauges(spark, d).withColumn("us", views.micros())
    return metrics.visible_values(readings, SERIES, "us", "value", "event_id", 60_000_000, 300_000_000)


@query
def run_spans(spark, d):
    return metrics.run_spans(views.batch_log(spark, d), ["run"], "got_us", GAP_US)


RUN_GAP_US = 3_600_000_000


@query
def marked_runs(spark, d):
    """Runs per loader, ended by an error event or an hour of silence."""
    events = views.label_sets(views.table(spark, d, "events")).withColumns({"us": views.micros(), "ended": F.col("event_type") == "error"})
    return runs.marked_runs(events, ["loader"], "us", "event_id", "ended", RUN_GAP_US)


def _event_stream(spark, d) -> DataFrame:
    return views.table_stream(spark, d, "events").withColumn("at", F.timestamp_micros(views.micros()))


def _ending_event_stream(spark, d) -> tuple[DataFrame, live.End]:
    """The events as a stream that has an end."""
    events, end = live.with_end(views.table_stream(spark, d, "events"), "ts")
    return events.withColumn("at", F.timestamp_micros(views.micros())), end


@query
def gauge_windows_stream(spark, d):
    """As gauge_windows, as a stream, to its last window."""
    events, end = _ending_event_stream(spark, d)
    readings = views.label_sets(events).select("at", *SERIES, "value")
    return live.append_table(spark, live.window_stats(readings, SERIES, F.col("value"), 1, "at"), "windows", end)


@query
def gauge_latest_stream(spark, d):
    events, end = _ending_event_stream(spark, d)
    readings = views.label_sets(events).select("at", "event_id", *SERIES, "value")
    return live.append_table(spark, live.window_latest(readings, SERIES, "value", "event_id", 5, "at"), "latest", end)


@query
def run_spans_stream(spark, d):
    events, end = _ending_event_stream(spark, d)
    readings = events.select("at", F.col("event_type").alias("run"))
    return live.append_table(spark, live.session_spans(readings, ["run"], "10 minutes", "at"), "spans", end)


@query
def marked_runs_stream(spark, d):
    """The same runs from a stream, each put out when its marker or a timer ends it; rows that came too late are counted."""
    events, end = _ending_event_stream(spark, d)
    readings = views.label_sets(events).select("at", "event_id", "loader", (F.col("event_type") == "error").alias("ended"))
    tracked = runs.track_runs(readings, ["loader"], "event_id", "ended", RUN_GAP_US, "at")
    return runs.runs_table(spark, tracked, "runs", end).select("loader", "kind", "start_us", "last_us", "readings", "by_marker")


@query
def gauge_upserts(spark, d):
    """The current value of every label set after the stream."""
    readings = views.label_sets(_event_stream(spark, d)).select("at", "event_id", *SERIES, "value")
    table = live.snapshot_table(spark, readings, live.newest_reading(SERIES, "value", "event_id", "at"), "current", "append")
    return table.select(*SERIES, "event_id", "value")


@query
def live_counters(spark, d):
    """Counters kept while batches stream in; the last state is the epoch's totals."""
    batches = views.as_batches(_event_stream(spark, d))
    return live.snapshot_table(spark, live.live_counters(batches, RUN), live.newest_batch(RUN), "counters")
