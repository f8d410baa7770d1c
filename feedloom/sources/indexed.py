"""Indexed binary shards as a Spark data source (``indexed_shards``).

The byte layout follows the public MDS version 2 description: a shard is
``uint32 n``, ``uint32[n + 1]`` record offsets from the file start, a JSON
description, then the records; a record is the ``uint32`` sizes of its variable
columns followed by all values, columns in name order, integers as 8 bytes
little-endian.  ``index.json`` lists the shards in sample order.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from feedloom.operators.sharding import locate
from feedloom.schemas import INDEXED_SHARD_FORMAT
from feedloom.session import ship_package
from feedloom.sources.shardfiles import SHARD_LIST, IdRange, RollingWriter, RowChunks, ShardFile, exists, fenced_shards, open_fs, read_text, shard_runs, write_text

INDEX = "index.json"
_TYPES = {"int": T.LongType(), "str": T.StringType(), "bytes": T.BinaryType()}


def columns_of(schema: T.StructType) -> dict[str, str]:
    """Declared column kinds of a Spark schema, steering columns left out."""
    kinds = {}
    for f in schema:
        if f.name == "shard_id":
            continue
        if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType)):
            kinds[f.name] = "int"
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "str"
        elif isinstance(f.dataType, T.BinaryType):
            kinds[f.name] = "bytes"
        else:
            raise ValueError(f"{f.name}: indexed shards hold int, str and bytes columns only")
    return kinds


def spark_schema(columns: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def describe(columns: dict[str, str], limit: int | None) -> dict:
    names = sorted(columns)
    return {
        "column_encodings": [columns[n] for n in names],
        "column_names": names,
        "column_sizes": [8 if columns[n] == "int" else None for n in names],
        "compression": None,
        "format": "mds",
        "hashes": [],
        "size_limit": limit,
        "version": 2,
    }


def encode_record(row: dict, columns: list[tuple[str, str]]) -> bytes:
    sizes, values = [], []
    for name, kind in columns:
        value = row[name]
        if value is None:
            raise ValueError(f"{name} of sample {row.get('__id__')} is NULL; indexed shards cannot hold it")
        if kind == "int":
            values.append(struct.pack("<q", value))
        else:
            values.append(value.encode("utf-8") if kind == "str" else bytes(value))
            sizes.append(len(values[-1]))
    return struct.pack(f"<{len(sizes)}I", *sizes) + b"".join(values)


def decode_record(data: bytes, columns: list[tuple[str, str]]) -> dict:
    variable = sum(kind != "int" for _, kind in columns)
    sizes = iter(struct.unpack_from(f"<{variable}I", data))
    at, row = 4 * variable, {}
    for name, kind in columns:
        size = 8 if kind == "int" else next(sizes)
        value = data[at : at + size]
        at += size
        row[name] = struct.unpack("<q", value)[0] if kind == "int" else value.decode("utf-8") if kind == "str" else value
    return row


class IndexedReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, ids: IdRange, cores: str | None = None):
        self.path, self.schema, self.ids, self.cores = path, schema, ids, cores

    def partitions(self):
        files, root = open_fs(self.path)
        if exists(files, f"{root}/{SHARD_LIST}"):
            return shard_runs(fenced_shards(self.path, self.ids), self.cores)
        out, first = [], 0
        for s in json.loads(read_text(files, f"{root}/{INDEX}"))["shards"]:
            begin, end = self.ids.places(first, s["samples"])
            if begin < end:
                out.append(ShardFile(s["raw_data"]["basename"], first, s["samples"], s["raw_data"].get("bytes")))
            first += s["samples"]
        return shard_runs(out, self.cores)

    def read(self, partition):
        for shard in partition.shards if partition is not None else []:  # no shards: Spark still asks once
            yield from self.read_shard(shard)

    def read_shard(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        files, root = open_fs(self.path)
        with files.open_input_file(f"{root}/{partition.name}") as source:
            (count,) = struct.unpack("<I", source.read(4))
            placed = partition.first is not None and partition.rows == count
            begin, end = self.ids.places(partition.first, count) if placed else (0, count)
            (start,) = struct.unpack("<I", source.read(4))
            source.seek(4 + 4 * (count + 1))
            head = json.loads(source.read(start - 4 * (count + 2)))
            source.seek(4 + 4 * begin)
            offsets = np.frombuffer(source.read(4 * (end - begin + 1)), dtype="<u4").astype(np.int64)
            columns = list(zip(head["column_names"], head["column_encodings"]))
            chunks = RowChunks(to_arrow_schema(self.schema))
            wanted = set(self.schema.names)
            source.seek(int(offsets[0]))
            for size in np.diff(offsets).tolist():
                row = decode_record(source.read(size), columns)
                if self.ids and not placed and row["__id__"] not in self.ids:
                    continue
                if batch := chunks.add({k: v for k, v in row.items() if k in wanted}, size):
                    yield batch
            if batch := chunks.flush():
                yield batch


class IndexedWriter(RollingWriter):
    """Records of the open shard are held until it closes, as the offsets come first."""

    def __init__(self, path: str, columns: dict[str, str], limit: int | None, greedy: bool):
        super().__init__(path, limit if greedy else None)
        self.head = describe(columns, limit)
        self.columns = list(zip(self.head["column_names"], self.head["column_encodings"]))
        self.config = json.dumps(self.head, sort_keys=True).encode("utf-8")
        self.records: list[bytes] = []
        self.sink = None

    def file_name(self, shard, part):
        return f"shard.{shard:05d}.{part:05d}.mds" if self.limit else INDEXED_SHARD_FORMAT % shard

    def start(self, sink):
        self.sink, self.records = sink, []

    def empty(self):
        return 8 + len(self.config)

    def room(self, row):
        size = 4
        for name, kind in self.columns:
            value = row[name]
            size += 8 if kind == "int" else 4 + (len(value.encode("utf-8")) if kind == "str" else len(value))
        return size

    def add(self, row):
        record = encode_record(row, self.columns)
        self.records.append(record)
        return len(record)

    def finish(self):
        count = len(self.records)
        start = 4 + 4 * (count + 1) + len(self.config)
        ends = start + np.cumsum([0] + [len(r) for r in self.records])
        if ends[-1] >= 1 << 32:
            raise ValueError("an indexed shard holds at most 4 GiB; lower the byte limit")
        self.sink.write(struct.pack("<I", count) + ends.astype("<u4").tobytes() + self.config)
        for record in self.records:
            self.sink.write(record)
        self.records = []

    def publish_manifest(self, files, root, shards):
        listed = []
        for shard in shards:
            size = 4 + 4 * (shard["n_rows"] + 1) + len(self.config) + shard["bytes"]
            raw = {"basename": shard["file"], "bytes": size, "hashes": {}}
            listed.append({**self.head, "raw_data": raw, "samples": shard["n_rows"], "zip_data": None})
        listed = listed or [{**self.head, "raw_data": None, "samples": 0, "zip_data": None}]
        shards_only = [s for s in listed if s["raw_data"]]
        write_text(files, f"{root}/{INDEX}", json.dumps({"shards": shards_only, "columns": dict(self.columns), "version": 2}, sort_keys=True))


class IndexedShards(DataSource):
    """Options: ``path``; for reading ``cores`` (small shards then share a task), ``first_id``, ``last_id``; for writing ``size_limit`` (bytes), ``greedy`` (strict limit per id range)."""

    @classmethod
    def name(cls):
        return "indexed_shards"

    def schema(self):
        files, root = open_fs(self.options["path"])
        index = json.loads(read_text(files, f"{root}/{INDEX}"))
        columns = index.get("columns") or dict(zip(index["shards"][0]["column_names"], index["shards"][0]["column_encodings"]))
        return spark_schema(columns)

    def reader(self, schema):
        return IndexedReader(self.options["path"], schema, IdRange(self.options), self.options.get("cores"))

    def writer(self, schema, overwrite):
        limit = self.options.get("size_limit")
        greedy = self.options.get("greedy", "false").lower() == "true"
        return IndexedWriter(self.options["path"], columns_of(schema), int(limit) if limit else None, greedy)


def fetch_samples(
    spark: SparkSession, path: str, ids: DataFrame, ident: str = "__id__", transform=None, schema: T.StructType | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Random access: the samples with the given ids, by seeking in their shards.

    Ids are placed through the manifest, gathered by shard, and each task reads
    only the offsets and records it needs.  ``transform`` (dict -> dict) runs on
    every sample as it is fetched and then ``schema`` describes its result.
    Repeated ids come back as often as they are asked for, ids that no shard holds not at all.
    The columns of ``ids`` in ``carry`` travel along, so that no payload has to be joined later.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(spark)
    files, root = open_fs(path)
    index = json.loads(read_text(files, f"{root}/{INDEX}"))
    kinds = index.get("columns") or dict(zip(index["shards"][0]["column_names"], index["shards"][0]["column_encodings"]))
    columns = [(name, kinds[name]) for name in sorted(kinds)]
    schema = schema or spark_schema(dict(columns))
    from feedloom.sources.corpus import read_manifest

    shards = read_manifest(spark, path).where("n_rows > 0")
    placed = locate(ids, ident, shards)
    carry = carry or []
    placed = placed.join(ids.select(ident, *carry), ident)
    if carry:
        schema = T.StructType([*schema.fields, *[ids.schema[c] for c in carry]])
    # The name of the file travels with the id; a manifest row is joined, not collected.
    named = placed.join(shards.select("shard_id", "file"), "shard_id").select("file", "place", *carry)
    arrow = to_arrow_schema(schema)

    def seek(batches):
        handles, name, source, offsets = open_fs(path), None, None, None
        chunks = RowChunks(arrow)
        for batch in batches:
            for file, place, *extras in zip(*(column.to_pylist() for column in batch.columns)):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, handles[0].open_input_file(f"{handles[1]}/{file}")
                source.seek(4 + 4 * place)
                offsets = struct.unpack("<2I", source.read(8))
                source.seek(offsets[0])
                row = decode_record(source.read(offsets[1] - offsets[0]), columns)
                row = {**(transform(row) if transform else row), **dict(zip(carry, extras))}
                if out := chunks.add(row, offsets[1] - offsets[0]):
                    yield out
        if source is not None:
            source.close()
        if out := chunks.flush():
            yield out

    return named.repartition("file").sortWithinPartitions("file", "place").mapInArrow(seek, schema)
