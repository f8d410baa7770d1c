"""Key-matched tar shards as a Spark data source (``tar_shards``).

One tar is one task, or, told the ``cores`` that read, small tars share one.  Entries ``<key>.<field>`` of one key form a row; a field
the sample lacks is NULL.  A schema may also ask for the shard's name
(``__shard__``) and the sample's 0-based place in it (``__place__``).
"""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from feedloom.schemas import KEY_FORMAT, TAR_SHARD_FORMAT
from feedloom.sources.shardfiles import IdRange, RollingWriter, RowChunks, every_shard, fenced_shards, open_fs, shard_runs, write_text

KEY = "__key__"
SHARD = "__shard__"
PLACE = "__place__"
_STEERING = {"shard_id", "__id__", KEY, SHARD, PLACE}


class TarReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, ids: IdRange, cores: str | None = None):
        self.path, self.schema, self.ids, self.cores = path, schema, ids, cores

    def partitions(self):
        return shard_runs(fenced_shards(self.path, self.ids) if self.ids else every_shard(self.path, ".tar"), self.cores)

    def read(self, partition):
        for shard in partition.shards if partition is not None else []:  # no shards: Spark still asks once
            yield from self.read_shard(shard)

    def read_shard(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = {f.name: f.dataType for f in self.schema if f.name not in _STEERING}
        chunks = RowChunks(to_arrow_schema(self.schema))
        files, root = open_fs(self.path)

        def sample(key, place):
            row = dict.fromkeys(self.schema.names)
            row.update((k, v) for k, v in {KEY: key, SHARD: partition.name, PLACE: place}.items() if k in row)
            return row

        current, row, size, place = None, None, 0, -1
        with files.open_input_stream(f"{root}/{partition.name}") as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            for entry in tar:
                if not entry.isfile():
                    continue
                key, ext = sample_name(entry.name)
                if self.ids and (number := int(key.rpartition("/")[2])) not in self.ids:
                    if self.ids.last is not None and number > self.ids.last and partition.first is not None:
                        break
                    place += key != current
                    current = key
                    continue
                if key != current:
                    if row is not None and (batch := chunks.add(row, size)):
                        yield batch
                    place += 1
                    current, row, size = key, sample(key, place), 0
                if ext in fields:
                    body = tar.extractfile(entry).read()
                    row[ext] = parse_field(body, fields[ext])
                    size += len(body)
        if row is not None and (batch := chunks.add(row, size)):
            yield batch
        if batch := chunks.flush():
            yield batch


def sample_name(entry: str) -> tuple[str, str]:
    """Key and field of an entry: its folder and name up to the first point, and what follows it."""
    folder, _, base = entry.rpartition("/")
    stem, _, field = base.partition(".")
    return f"{folder}/{stem}" if folder else stem, field


def parse_field(body: bytes, dtype: T.DataType):
    if isinstance(dtype, T.BinaryType):
        return body
    text = body.decode("utf-8")
    return int(text) if isinstance(dtype, (T.LongType, T.IntegerType)) else text


class TarWriter(RollingWriter):
    """``<key>.<field>`` entries; times and owners are fixed so content is repeatable."""

    def __init__(self, path: str, fields: list[str]):
        super().__init__(path, None)
        self.fields = fields
        self.tar = None

    def file_name(self, shard, part):
        return TAR_SHARD_FORMAT % shard

    def start(self, sink):
        self.tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)

    def empty(self):
        return 0

    def add(self, row):
        key, total = row.get(KEY) or KEY_FORMAT % row["__id__"], 0
        for name in self.fields:
            value = row[name]
            if value is None:
                continue
            body = value if isinstance(value, bytes) else str(value).encode("utf-8")
            entry = tarfile.TarInfo(f"{key}.{name}")
            entry.size = len(body)
            self.tar.addfile(entry, io.BytesIO(body))
            total += len(body)
        return total

    def finish(self):
        self.tar.close()
        self.tar = None

    def publish_manifest(self, files, root, shards):
        write_text(files, f"{root}/manifest.txt", "\n".join(sorted(s["file"] for s in shards)))


class TarShards(DataSource):
    """Options: ``path``; ``cores`` to let small tars share a task; ``first_id``, ``last_id`` for keys that are ids, in a layout with a shard list.  Give the fields to read with ``.schema``; the default is text."""

    @classmethod
    def name(cls):
        return "tar_shards"

    def schema(self):
        return f"`{KEY}` string, txt string"

    def reader(self, schema):
        return TarReader(self.options["path"], schema, IdRange(self.options), self.options.get("cores"))

    def writer(self, schema, overwrite):
        return TarWriter(self.options["path"], [n for n in schema.names if n not in _STEERING])
