"""What the tar and indexed shard formats share: files, manifests, rolling writers.

Paths may be anything Arrow's filesystem layer opens (local or mounted paths,
hdfs://, s3://, gs://).  Shards are written by tasks under a temporary name and
moved into place when complete; their content depends on the rows only, so a
retried task replaces a shard with the same bytes.  Readers go by the manifest,
which is written last, so a half-finished write is never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

SHARD_LIST = "shards.jsonl"
READ_ROWS = 1024
SLICE_ROWS = 256
READ_BYTES = 32 << 20
# What a task reads where shards are small: at most, and at least.
TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 20


def open_fs(path: str):
    """(filesystem, path on it).

    A bare path is a folder of this machine, so only a local session takes one; on a
    cluster name the scheme, ``file://`` for a folder mounted everywhere.  What follows
    ``file:`` is a name as Spark takes it, not an escaped URI: spaces and ``%`` are themselves.
    """
    from pyarrow import fs
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if ":" not in path and context is not None and not re.match(r"local($|\[)", context.master):
        raise ValueError(f"on a cluster {path} would be another folder on every machine: give it with its scheme")
    if named := re.fullmatch(r"file:(?://)?(/(?!/).*)", path, re.DOTALL):
        return fs.LocalFileSystem(), named[1].rstrip("/") or "/"
    return fs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))


def exists(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


def read_text(files, path: str) -> str:
    with files.open_input_stream(path) as stream:
        return stream.read().decode("utf-8")


def write_text(files, path: str, text: str) -> None:
    spare = f"{path}.{uuid.uuid4().hex[:8]}"
    with files.open_output_stream(spare) as stream:
        stream.write(text.encode("utf-8"))
    files.move(spare, path)


@dataclass
class ShardFile(InputPartition):
    """A shard; with its first id and its number of rows where the shard list tells them."""

    name: str

    def __init__(self, name: str, first: int | None = None, rows: int | None = None, size: int | None = None):
        super().__init__(name)
        self.name, self.first, self.rows, self.size = name, first, rows, size


@dataclass
class ShardRun(InputPartition):
    """Neighbouring shards that one task reads one after the other."""

    shards: list

    def __init__(self, shards: list):
        super().__init__(shards)
        self.shards = shards


def shard_runs(shards: list[ShardFile], cores: str | int | None) -> list[ShardRun]:
    """Shards in order, dealt to tasks: one each, or, given the ``cores`` that will read them, small ones together.

    A task gets up to ``TASK_BYTES``, and less where that would leave cores without work. A shard of unknown size has its own task.
    """
    runs, held = [], 0
    if cores is not None:
        total = sum(s.size or 0 for s in shards)
        most = min(TASK_BYTES, max(LEAST_BYTES, total // (3 * int(cores))))
    for shard in shards:
        if cores is None or shard.size is None or not runs or runs[-1][-1].size is None or held + shard.size > most:
            runs.append([])
            held = 0
        runs[-1].append(shard)
        held += shard.size or 0
    return [ShardRun(run) for run in runs]


class IdRange:
    """The options ``first_id`` and ``last_id`` of a source: samples between them, both inside; either may be missing.

    The range is an option and not a pushed filter, because all scans of one DataFrame over a Python source share
    one reader, so that two different filters on it would get each other's shards.
    """

    def __init__(self, options) -> None:
        first, last = options.get("first_id"), options.get("last_id")
        self.first, self.last = (None if x is None else int(x) for x in (first, last))

    def __contains__(self, ident: int) -> bool:
        return (self.first is None or ident >= self.first) and (self.last is None or ident <= self.last)

    def __bool__(self) -> bool:
        return self.first is not None or self.last is not None

    def places(self, first: int, rows: int) -> tuple[int, int]:
        """The places [begin, end) of a shard with ``rows`` consecutive ids from ``first`` on."""
        begin = 0 if self.first is None else min(rows, max(0, self.first - first))
        return begin, rows if self.last is None else max(begin, min(rows, self.last - first + 1))


def fenced_shards(path: str, ids: IdRange) -> list[ShardFile]:
    """The shards of a shard list that may hold ids of the range; their first id where ids are consecutive."""
    files, root = open_fs(path)
    listed = [json.loads(line) for line in read_text(files, f"{root}/{SHARD_LIST}").splitlines() if line]
    some = [s for s in listed if (ids.first is None or s["last_id"] >= ids.first) and (ids.last is None or s["first_id"] <= ids.last)]
    return [ShardFile(s["file"], s["first_id"] if s["last_id"] - s["first_id"] + 1 == s["n_rows"] else None, s["n_rows"], s["bytes"]) for s in some]


@dataclass
class WrittenShards(WriterCommitMessage):
    shards: list[dict] = field(default_factory=list)


def rows_of(batch):
    """Rows of an Arrow batch as dicts, a few hundred held at a time."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        yield from batch.slice(start, SLICE_ROWS).to_pylist()


class RowChunks:
    """Gathers rows into Arrow batches of bounded rows and bytes."""

    def __init__(self, schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: dict, size: int):
        self.rows.append(row)
        self.size += size
        return self.flush() if len(self.rows) >= READ_ROWS or self.size >= READ_BYTES else None

    def flush(self):
        import pyarrow as pa

        if not self.rows:
            return None
        batch = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0
        return batch


class RollingWriter(DataSourceArrowWriter):
    """One file per shard from rows that arrive sorted by shard.

    Input columns ``shard_id`` and ``__id__`` steer the write.  With a byte
    ``limit`` a shard is closed before the row that would exceed it, and
    ``shard_id`` only names the id range the task works on.
    """

    def __init__(self, path: str, limit: int | None):
        self.path, self.limit = path, limit
        files, root = open_fs(path)
        if exists(files, f"{root}/{SHARD_LIST}"):
            raise ValueError(f"{path} already holds shards; write to a new folder")
        files.create_dir(root, recursive=True)

    # -- what a format provides
    def start(self, sink):
        """Begin a file on an open binary sink."""

    def room(self, row: dict) -> int:
        """Bytes the row takes in the file."""
        raise NotImplementedError

    def empty(self) -> int:
        """Bytes of a file without rows."""
        raise NotImplementedError

    def add(self, row: dict) -> int:
        """Append a row; returns its payload bytes."""
        raise NotImplementedError

    def finish(self) -> None:
        """Complete the file."""

    def file_name(self, shard: int, part: int) -> str:
        raise NotImplementedError

    def publish_manifest(self, files, root: str, shards: list[dict]) -> None:
        """Write the format's own manifest."""

    # -- the roll itself
    def write(self, iterator):
        files, root = open_fs(self.path)
        done: list[dict] = []
        now: dict | None = None
        sink = spare = None
        filled = part = 0

        def close():
            self.finish()
            sink.close()
            files.move(spare, f"{root}/{now['file']}")
            done.append(now)

        for batch in iterator:
            for row in rows_of(batch):
                shard, ident = row.pop("shard_id"), row["__id__"]
                turned = now is None or shard != now["range"]
                full = self.limit and not turned and filled + self.room(row) > self.limit
                if turned or full:
                    if now is not None:
                        close()
                    part = part + 1 if full else 0
                    if turned and any(s["range"] == shard for s in done):
                        raise ValueError("rows must be sorted by shard_id within a task")
                    name = self.file_name(shard, part)
                    now = {"range": shard, "part": part, "file": name, "n_rows": 0, "bytes": 0, "first_id": ident, "last_id": ident}
                    spare = f"{root}/.{name}.{uuid.uuid4().hex[:8]}"
                    sink = files.open_output_stream(spare)
                    self.start(sink)
                    filled = self.empty()
                filled += self.room(row) if self.limit else 0
                now["bytes"] += self.add(row)
                now["n_rows"] += 1
                now["last_id"] = ident
        if now is not None:
            close()
        return WrittenShards(shards=done)

    def commit(self, messages):
        files, root = open_fs(self.path)
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: (s["range"], s["part"]))
        if len({s["file"] for s in shards}) != len(shards):
            raise ValueError("a shard was written by two tasks; repartition by shard_id first")
        lines = []
        for number, shard in enumerate(shards):
            shard["shard_id"] = number if self.limit else shard["range"]
            lines.append(json.dumps({k: shard[k] for k in ("shard_id", "file", "n_rows", "bytes", "first_id", "last_id")}))
        self.publish_manifest(files, root, shards)
        write_text(files, f"{root}/{SHARD_LIST}", "\n".join(lines))

    def abort(self, messages):
        files, root = open_fs(self.path)
        for message in messages:
            for shard in message.shards if message else []:
                if exists(files, f"{root}/{shard['file']}"):
                    files.delete_file(f"{root}/{shard['file']}")


def every_shard(path: str, suffix: str) -> list[ShardFile]:
    """All shards: with sizes from the shard list, else by name from the listing."""
    files, root = open_fs(path)
    if exists(files, f"{root}/{SHARD_LIST}"):
        return fenced_shards(path, IdRange({}))
    return [ShardFile(name) for name in shard_names(path, suffix)]


def shard_names(path: str, suffix: str) -> list[str]:
    """Shard files in name order: from the manifest, else from the listing."""
    from pyarrow import fs

    files, root = open_fs(path)
    listed = f"{root}/{SHARD_LIST}"
    if exists(files, listed):
        return [json.loads(line)["file"] for line in read_text(files, listed).splitlines() if line]
    found = files.get_file_info(fs.FileSelector(root))
    return sorted(f.base_name for f in found if f.base_name.endswith(suffix) and not f.base_name.startswith("."))
