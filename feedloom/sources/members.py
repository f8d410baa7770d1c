"""Tars cut into tasks by an index of their members.

``index_tars`` reads the headers of every tar once, skipping the bodies, and keeps a row per member: where its body lies,
and which sample it belongs to. ``read_members`` deals that index to tasks by ranges of bytes and reaches the
bodies by seek, so a tar of any size becomes as many tasks as it has ranges, and filters or joins on the index (some keys,
an epoch's order, a few fields) decide what is read before any body is opened. Only index rows are exchanged.
"""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import fresh_dir, ship_package
from feedloom.sources.shardfiles import READ_ROWS, RowChunks, open_fs
from feedloom.sources.tar import KEY, PLACE, SHARD, parse_field, sample_name

MEMBERS = "file string, place long, key string, start long, field string, offset long, size long"
SLICE_BYTES = 256 << 20
HEADER_BUFFER = 64 << 10
BODY_BUFFER = 1 << 20


def tar_members(raw):
    """(place, key, start, field, offset, size) of every plain file in an open seekable tar, in file order.

    Neighbours with one key are a sample, as in ``tar_shards``; ``start`` is the offset of its first body. Members are
    not kept, so memory doesn't grow with the tar. Sparse members have no body in one piece and raise.
    """
    place, current, start = -1, None, 0
    with tarfile.open(fileobj=io.BufferedReader(raw, HEADER_BUFFER), mode="r:", errors="backslashreplace") as tar:
        while (entry := tar.next()) is not None:
            tar.members.clear()
            if not entry.isfile():
                continue
            if entry.issparse():
                raise ValueError(f"{entry.name} is stored sparsely and can't be read by offset")
            key, field = sample_name(entry.name)
            if key != current:
                place, current, start = place + 1, key, entry.offset_data
            yield place, key, start, field, entry.offset_data, entry.size


def index_tars(spark: SparkSession, path: str, into: str | None = None, glob: str = "*.tar") -> DataFrame:
    """The members of all tars under ``path`` as a table written to ``into`` (for foreign tars, a folder beside them).

    One task scans one tar's headers. Tars may be named by anything Spark lists and Arrow opens. An empty tar has no
    rows; a broken one fails the job, naming the tar, and an index is only there when all were read.
    """
    ship_package(spark)
    where = into or fresh_dir(spark, "members")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    shape = T.StructType.fromDDL(MEMBERS)

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(shape)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=shape.names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                files, name = open_fs(file)
                rows = []
                try:
                    with files.open_input_file(name) as raw:
                        for member in tar_members(raw):
                            rows.append((file, *member))
                            if len(rows) == READ_ROWS:
                                yield batch_of(rows)
                                rows = []
                except tarfile.TarError as broken:
                    raise ValueError(f"{file}: {broken}") from broken
                if rows:
                    yield batch_of(rows)

    listed.mapInArrow(scan, MEMBERS).write.parquet(where)
    return open_index(spark, where)


def open_index(spark: SparkSession, where: str) -> DataFrame:
    """An index written before."""
    return spark.read.schema(MEMBERS).parquet(where)


def read_members(index: DataFrame, schema: T.StructType | str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The samples of an index, read by seek in tasks of about ``slice_bytes``.

    ``schema`` names the fields to read (text, whole number or binary) and may ask for ``__key__``, ``__shard__`` (the tar's name) and ``__place__``. A
    sample without a field has NULL there, a field that occurs twice has its last body, and a sample of which the index
    holds any member is a row. Bodies of fields not asked for are not read. No index rows: no rows.
    """
    spark = index.sparkSession
    ship_package(spark)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = {f.name: f.dataType for f in schema if f.name not in (KEY, SHARD, PLACE)}
    asked = F.when(F.col("field").isin(list(fields)), F.col("size")).otherwise(0)
    held = index.agg(F.sum(asked).alias("bytes")).first().bytes or 0
    tasks = int(held) // slice_bytes + 1
    # A slice is a range of a tar's bytes that samples start in, so a sample is never cut, however its tar is.
    dealt = index.repartition(tasks, F.col("file"), F.expr(f"start div {int(slice_bytes)}")).sortWithinPartitions("file", "place", "offset")

    def fetch(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        chunks = RowChunks(to_arrow_schema(schema))
        opened, source, seen, row, size = None, None, None, None, 0
        try:
            for batch in batches:
                columns = [batch.column(n).to_pylist() for n in ("file", "place", "key", "field", "offset", "size")]
                for file, place, key, field, offset, length in zip(*columns, strict=True):
                    if (file, place) != seen:
                        if row is not None and (full := chunks.add(row, size)):
                            yield full
                        seen, row, size = (file, place), dict.fromkeys(schema.names), 0
                        row.update((k, v) for k, v in {KEY: key, SHARD: file.rpartition("/")[2], PLACE: place}.items() if k in row)
                    if field not in fields:
                        continue
                    if file != opened:
                        if source is not None:
                            source.close()
                        files, name = open_fs(file)
                        opened, source = file, io.BufferedReader(files.open_input_file(name), BODY_BUFFER)
                    source.seek(offset)
                    body = source.read(length)
                    if len(body) != length:
                        raise ValueError(f"{file} ends inside {key}.{field}: the index is of another file")
                    row[field] = parse_field(body, fields[field])
                    size += length
            if row is not None and (full := chunks.add(row, size)):
                yield full
            if full := chunks.flush():
                yield full
        finally:
            if source is not None:
                source.close()

    return dealt.mapInArrow(fetch, schema)
