"""A Parquet feed in block order: whole row groups in a random order of their own every epoch, without a shuffle.

``block_splits`` reads the footers once and keeps a row per row group. ``block_order`` puts them in an epoch's
order and gives each its place in it. ``read_blocks`` is a scan whose partitions are runs of row groups in that
order: payload rows come out where the order wants them, numbered, and no row is exchanged. A number of
partitions that is asked for is met by putting row groups together or by cutting them at row numbers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from feedloom.operators.numbering import bucketed_window, hash_bucket, id_bucket
from feedloom.operators.shuffle import shuffle_key
from feedloom.session import fresh_dir, settle, ship_package
from feedloom.sources.shardfiles import READ_BYTES, READ_ROWS, open_fs, read_text, write_text

SPLITS = "folder long, file string, row_group long, n_rows long, bytes long"
BLOCK, PLACE = "__block__", "__place__"


def block_splits(spark: SparkSession, path: str) -> DataFrame:
    """A row per row group of the Parquet files under ``path``, from their footers, numbered in file order.

    Files in ``shard_id=`` folders go by that number, others by name. The table is written, so the footers
    are read once for all epochs.
    """
    ship_package(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    folder = F.regexp_extract("path", r"/shard_id=(\d+)/", 1)
    named = listed.select(F.when(folder != "", folder.cast("long")).otherwise(-1).cast("long").alias("folder"), F.col("path").alias("file"))

    def footers(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for where, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, name = open_fs(file)
                with files.open_input_file(name) as source:
                    meta = pq.ParquetFile(source).metadata
                groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                rows += [(where, file, g, info.num_rows, info.total_byte_size) for g, info in enumerate(groups) if info.num_rows]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["folder", "file", "row_group", "n_rows", "bytes"])

    found = settle(named.mapInArrow(footers, SPLITS), "footers")
    # Row groups of one file are ordered in a window of that file, files among each other by their first one.
    inside = Window.partitionBy("folder", "file").orderBy("row_group")
    files = found.groupBy("folder", "file").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_rows").alias("rows"))
    earlier = Window.partitionBy("folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumns({"g": F.coalesce(F.sum("groups").over(earlier), F.lit(0)), "r": F.coalesce(F.sum("rows").over(earlier), F.lit(0))})
    folders = files.groupBy("folder").agg(F.sum("groups").alias("groups"), F.sum("rows").alias("rows"))
    upto = bucketed_window(folders, [], id_bucket("folder"), ["folder"], running={"_g": "groups", "_r": "rows"})
    upto = upto.select("folder", (F.col("_g") - F.col("groups")).alias("folder_g"), (F.col("_r") - F.col("rows")).alias("folder_r"))
    offset = F.coalesce(F.sum("n_rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumns({"_i": F.row_number().over(inside) - 1, "_o": offset}).join(files.select("folder", "file", "g", "r"), ["folder", "file"]).join(upto, "folder")
    numbered = placed.select(
        (F.col("folder_g") + F.col("g") + F.col("_i")).cast("long").alias("block"), "file", "row_group", "n_rows", "bytes", (F.col("folder_r") + F.col("r") + F.col("_o")).cast("long").alias("first_row")
    )
    return settle(numbered, "splits")


def block_order(splits: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """The splits with their rank in the epoch's order and the place of their first row in it."""
    keyed = splits.withColumn("_key", shuffle_key("block", seed, epoch))
    ranked = bucketed_window(keyed, [], hash_bucket(splits.withColumn("_key", shuffle_key("block", seed, epoch)), "_key"), ["_key", "block"], number="block_rank", running={"_upto": "n_rows"})
    return ranked.select(*splits.columns, "block_rank", (F.col("_upto") - F.col("n_rows")).alias("place"))


def cut_into(pieces: list[dict], partitions: int) -> list[list[dict]]:
    """Pieces in order of place as runs of about equally many rows; row groups that lie on a cut are divided at it."""
    total = sum(p["n_rows"] for p in pieces)
    edges = [total * i // partitions for i in range(1, partitions)] + [total]
    runs: list[list[dict]] = [[] for _ in range(partitions)]
    at = 0
    for p in pieces:
        done = 0
        while done < p["n_rows"]:
            while edges[at] <= p["place"] + done:
                at += 1
            take = min(p["n_rows"] - done, edges[at] - p["place"] - done)
            runs[at].append({**p, "start": p["start"] + done, "n_rows": take, "place": p["place"] + done})
            done += take
    return runs


@dataclass
class BlockRun(InputPartition):
    pieces: list

    def __init__(self, pieces: list):
        super().__init__(pieces)
        self.pieces = pieces


class BlockReader(DataSourceReader):
    def __init__(self, plan: str, schema: T.StructType):
        self.plan, self.schema = plan, schema

    def partitions(self):
        files, name = open_fs(self.plan)
        return [BlockRun(run) for run in map(json.loads, read_text(files, name).splitlines()) if run]

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:
            return
        shape = to_arrow_schema(self.schema)
        columns = [n for n in self.schema.names if n not in (BLOCK, PLACE)]
        for piece in partition.pieces:
            files, name = open_fs(piece["file"])
            with files.open_input_file(name) as source:
                held = pq.ParquetFile(source)
                per_row = max(1, piece["bytes"] // max(1, piece["group_rows"]))
                rows = max(1, min(READ_ROWS, READ_BYTES // per_row))
                at, stop = 0, piece["start"] + piece["n_rows"]
                for batch in held.iter_batches(rows, row_groups=[piece["row_group"]], columns=columns, use_threads=False):
                    a, b = max(0, piece["start"] - at), min(batch.num_rows, stop - at)
                    if a < b:
                        cut = batch.slice(a, b - a)
                        first = piece["place"] + at + a - piece["start"]
                        added = {BLOCK: pa.array([piece["block_rank"]] * cut.num_rows, pa.int64()), PLACE: pa.array(range(first, first + cut.num_rows), pa.int64())}
                        yield pa.RecordBatch.from_arrays([added[f.name] if f.name in added else cut.column(f.name).cast(f.type) for f in shape], schema=shape)
                    at += batch.num_rows
                    if at >= stop:
                        break


class ParquetBlocks(DataSource):
    """Option: ``plan``, a file with one line of pieces per partition."""

    @classmethod
    def name(cls):
        return "parquet_blocks"

    def reader(self, schema):
        return BlockReader(self.options["plan"], schema)


def read_blocks(ordered: DataFrame, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """The rows of ordered splits: a partition per row group, or just as many as asked for, in order of place.

    ``schema`` names the columns to read; ``__block__`` (rank) and ``__place__`` (row number in the epoch) are added. The plan holds
    a line per partition, as Spark's own scans do on the driver.
    """
    spark = ordered.sparkSession
    ship_package(spark)
    spark.dataSource.register(ParquetBlocks)
    rows = ordered.orderBy("place").select("file", "row_group", "n_rows", "bytes", "block_rank", "place").toLocalIterator()
    pieces = [{**r.asDict(), "start": 0, "group_rows": r.n_rows} for r in rows]
    runs = cut_into(pieces, partitions) if partitions else [[p] for p in pieces]
    plan = fresh_dir(spark, "block-plan")
    files, name = open_fs(plan)
    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
    write_text(files, name, "\n".join(json.dumps(run) for run in runs))
    full = T.StructType([*schema.fields, T.StructField(BLOCK, T.LongType()), T.StructField(PLACE, T.LongType())])
    return spark.read.format("parquet_blocks").schema(full).option("plan", plan).load()
