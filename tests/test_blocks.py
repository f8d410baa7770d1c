"""Block-order feeds, id ranges of shard layouts, and what panels show at each refresh."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators import metrics
from feedloom.plans import views
from feedloom.sources import blocks, corpus, indexed, sinks, tar
from feedloom.sources.shardfiles import IdRange

WANTED = T.StructType([T.StructField("__id__", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def layout(spark, sf, tmp_path_factory):
    """Parquet shards of 20 rows each."""
    where = str(tmp_path_factory.mktemp("blocks"))
    sinks.write_parquet_shards(views.samples(spark, sf).select("__id__", "text"), where, 20)
    return where


def test_splits_follow_shard_numbers(spark, layout):
    splits = blocks.block_splits(spark, f"{layout}/data").orderBy("block").collect()
    assert [s.block for s in splits] == list(range(10)) and [s.first_row for s in splits] == list(range(0, 200, 20))
    assert [int(s.file.split("shard_id=")[1].split("/")[0]) for s in splits] == list(range(10))


@pytest.mark.parametrize("partitions", [None, 1, 4, 7, 30])
def test_feed_is_in_order_without_exchange(spark, sf, layout, partitions):
    splits = blocks.block_splits(spark, f"{layout}/data")
    texts = {r["__id__"]: r.text for r in views.samples(spark, sf).collect()}
    orders = []
    for epoch in (0, 1):
        fed = blocks.read_blocks(blocks.block_order(splits, 42, epoch), WANTED, partitions)
        assert "Exchange" not in fed._jdf.queryExecution().executedPlan().toString()
        rows = fed.withColumn("part", F.spark_partition_id()).collect()
        assert fed.rdd.getNumPartitions() == (partitions or 10)
        assert [r["__place__"] for r in rows] == list(range(200)) and all(texts[r["__id__"]] == r.text for r in rows)
        by_block = [[r["__id__"] for r in rows if r["__block__"] == b] for b in range(10)]
        assert all(ids == list(range(ids[0], ids[0] + 20)) and ids[0] % 20 == 0 for ids in by_block)
        if partitions:
            sizes = [sum(r.part == p for r in rows) for p in range(partitions)]
            assert max(sizes) - min(sizes) <= 1
        orders.append([r["__id__"] for r in rows])
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1]) == list(range(200))


def test_row_groups_of_one_file_are_blocks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, n in (("b", 25), ("a", 7), ("c", 0)):
        pq.write_table(pa.table({"text": [f"{name}{i}" for i in range(n)], "x": list(range(n))}), tmp_path / f"{name}.parquet", row_group_size=10)
    splits = blocks.block_splits(spark, str(tmp_path))
    assert [(r.n_rows, r.first_row) for r in splits.orderBy("block").collect()] == [(7, 0), (10, 7), (10, 17), (5, 27)]
    fed = blocks.read_blocks(blocks.block_order(splits, 1, 3), T.StructType([T.StructField("text", T.StringType())]), 3).collect()
    assert [r["__place__"] for r in fed] == list(range(32)) and len({r.text for r in fed}) == 32


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "text string").write.parquet(str(tmp_path / "none"))
    splits = blocks.block_splits(spark, str(tmp_path / "none"))
    assert splits.count() == 0
    assert blocks.read_blocks(blocks.block_order(splits), T.StructType([T.StructField("text", T.StringType())])).count() == 0


def test_cuts_are_even_and_whole():
    pieces, place = [], 0
    for n in (5, 1, 40, 3):
        pieces.append({"n_rows": n, "place": place, "start": 0})
        place += n
    for partitions in (1, 2, 7, 49, 60):
        runs = blocks.cut_into(pieces, partitions)
        rows = [p["place"] + i for run in runs for p in run for i in range(p["n_rows"])]
        assert len(runs) == partitions and rows == list(range(place))


@pytest.fixture(scope="module")
def shards(spark, sf, tmp_path_factory):
    docs = views.samples(spark, sf)
    a, b = (str(tmp_path_factory.mktemp(n)) for n in ("indexed", "tar"))
    sinks.write_indexed(sinks.indexed_rows(docs.select("__id__", "text", F.struct("lang").alias("meta")), "text"), a, 60_000, "text")
    sinks.write_tar(docs.select("__id__", F.col("text").alias("txt")), b, ["txt"], 16)
    return a, b


@pytest.mark.parametrize("ids", [(0, 0), (37, 90), (None, 20), (150, None), (199, 500), (90, 37), (-5, -1), (None, None)])
def test_ranges_open_only_their_shards(spark, shards, ids):
    want = [i for i in range(200) if (ids[0] is None or i >= ids[0]) and (ids[1] is None or i <= ids[1])]
    by_id = corpus.read_indexed(spark, shards[0], ids)
    by_key = corpus.read_tar(spark, shards[1], ids=ids, shard=True)
    assert sorted(r["__id__"] for r in by_id.collect()) == want
    rows = by_key.collect()
    assert sorted(int(r["__key__"]) for r in rows) == want and all(int(r["__key__"]) % 16 == r["__place__"] for r in rows)
    listed = corpus.read_manifest(spark, shards[0]).collect()
    options = {k: v for k, v in zip(("first_id", "last_id"), ids, strict=True) if v is not None}
    opened = indexed.IndexedReader(shards[0], by_id.schema, IdRange(options)).partitions()
    assert len(opened) == sum(any(s.first_id <= i <= s.last_id for i in want) for s in listed) or not want
    assert len(tar.TarReader(shards[1], by_key.schema, IdRange(options)).partitions()) == len({i // 16 for i in want}) or not want


def test_a_range_reads_few_bytes(shards, monkeypatch):
    schema = T.StructType([T.StructField("__id__", T.LongType()), T.StructField("text", T.StringType())])
    read = []

    class Counted:
        def __init__(self, source):
            self.source = source

        def read(self, n):
            read.append(n)
            return self.source.read(n)

        def seek(self, at):
            return self.source.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

    class Files:
        def __init__(self, files):
            self.files = files

        def open_input_file(self, name):
            return Counted(self.files.open_input_file(name))

        def __getattr__(self, name):
            return getattr(self.files, name)

    real = indexed.open_fs
    monkeypatch.setattr(indexed, "open_fs", lambda path: (Files(real(path)[0]), real(path)[1]))
    sizes = []
    for ids in ({}, {"first_id": "60", "last_id": "60"}):
        reader = indexed.IndexedReader(shards[0], schema, IdRange(ids))
        read.clear()
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        sizes.append((len(rows), sum(read)))
    assert [n for n, _ in sizes] == [200, 1] and sizes[1][1] < sizes[0][1] / 20


def test_without_a_shard_list(spark, sf, tmp_path):
    docs = views.samples(spark, sf).select("__id__", "text")
    where = str(tmp_path / "foreign")
    sinks.write_indexed(docs, where, 60_000, "text")
    (tmp_path / "foreign" / "shards.jsonl").unlink()
    assert sorted(r["__id__"] for r in corpus.read_indexed(spark, where, (37, 90)).collect()) == list(range(37, 91))


def visible(rows, step, stale):
    out = {}
    for series in {r[0] for r in rows}:
        mine = sorted((us, i, v) for s, us, v, i in rows if s == series and us is not None)
        if not mine:
            continue
        for refresh in range(math.ceil(mine[0][0] / step) * step, mine[-1][0] + stale + step, step):
            seen = [m for m in mine if m[0] <= refresh]
            if seen and refresh - seen[-1][0] <= stale:
                out[(series, refresh)] = (seen[-1][2], refresh - seen[-1][0])
    return out


@pytest.mark.parametrize("step,stale", [(10, 0), (10, 35), (7, 100), (1, 3)])
def test_visible_values(spark, step, stale):
    pick = random.Random(step)
    rows = [(pick.choice(["hot", "hot", "a", None]), pick.choice([pick.randint(0, 60_000), pick.randint(300, 400), 500]), float(i), i) for i in range(200)]
    rows += [("only null", None, 1.0, 900), ("a", -25, 2.0, 901)]
    table = spark.createDataFrame(rows, "series string, us long, value double, event_id long").repartition(5)
    got = metrics.visible_values(table, ["series"], "us", "value", "event_id", step, stale).collect()
    assert {(r.series, r.refresh_us): (r.visible_value, r.age_us) for r in got} == visible(rows, step, stale) and len(got) == len(visible(rows, step, stale))
