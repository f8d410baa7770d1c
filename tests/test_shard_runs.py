"""Small shards share a read task."""

import pytest
from pyspark.sql import functions as F

from feedloom.sources import corpus, shardfiles, sinks
from feedloom.sources.shardfiles import ShardFile, shard_runs


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("runs"))
    docs = spark.range(300).select(F.col("id").alias("__id__"), F.format_string("text %d", "id").alias("text"), F.lit(None).cast("string").alias("meta"))
    docs = docs.fillna("{}", ["meta"])
    return sinks.write_formats(docs, out, "text", ("tar", "indexed"), tar_rows=5, limit=100, tasks=3)


@pytest.mark.parametrize("fmt", ["tar", "indexed"])
def test_small_shards_share_tasks(spark, layouts, fmt):
    shards = corpus.read_manifest(spark, layouts[fmt]).count()
    read = corpus.read_layout(spark, fmt, layouts[fmt])
    assert shards >= 20 and read.rdd.getNumPartitions() == 1
    ident = F.col("__key__").cast("long") if fmt == "tar" else F.col("__id__")
    rows = read.select(ident.alias("i"), "txt" if fmt == "tar" else "text").collect()
    assert sorted(map(tuple, rows)) == [(i, f"text {i}") for i in range(300)]


def test_apart_and_in_order(spark, layouts):
    shards = corpus.read_manifest(spark, layouts["tar"]).count()
    assert corpus.read_tar(spark, layouts["tar"], apart=True).rdd.getNumPartitions() == shards
    places = corpus.read_tar(spark, layouts["tar"], shard=True).select("__shard__", "__place__", "__key__").collect()
    assert {(r[0], r[1]): int(r[2]) for r in places} == {(f"shard-{i // 5:06d}.tar", i % 5): i for i in range(300)}


def test_runs_are_bounded_and_leave_no_core_idle(monkeypatch):
    monkeypatch.setattr(shardfiles, "TASK_BYTES", 100)
    monkeypatch.setattr(shardfiles, "LEAST_BYTES", 10)
    sizes = lambda found: [[s.size for s in run.shards] for run in found]
    files = [ShardFile(str(i), size=20) for i in range(30)]
    assert sizes(shard_runs(files, 1)) == [[20] * 5] * 6
    assert sizes(shard_runs(files, 5)) == [[20] * 2] * 15
    assert sizes(shard_runs(files, None)) == sizes(shard_runs(files, 1000)) == [[20]] * 30
    odd = [ShardFile("a", size=5), ShardFile("b"), ShardFile("c", size=5), ShardFile("d", size=5), ShardFile("e", size=500)]
    assert sizes(shard_runs(odd, 1)) == [[5], [None], [5, 5], [500]] and shard_runs([], 4) == []
