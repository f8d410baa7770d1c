"""Tars read by an index of their members, and payloads kept in buckets of their id."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.shuffle import index_shuffle
from feedloom.session import fresh_dir
from feedloom.sources import buckets, corpus, members

FIELDS = "txt string, cls long, jpg binary"
ASKED = f"`__key__` string, `__shard__` string, `__place__` long, {FIELDS}"


def write_tar(path, entries, form=tarfile.GNU_FORMAT):
    with tarfile.open(path, "w", format=form) as tar:
        for name, body in entries:
            if body is None:
                folder = tarfile.TarInfo(name)
                folder.type = tarfile.DIRTYPE
                tar.addfile(folder)
                continue
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))


def random_entries(seed, samples, longest):
    rng = random.Random(seed)
    out = []
    for i in range(samples):
        key = f"part{i % 3}/{i:06d}" if seed % 2 else f"{i:06d}"
        if rng.random() < 0.1:
            out.append((f"part{i % 3}", None))
        fields = [f for f in ("txt", "cls", "jpg", "seg.png") if rng.random() < 0.8] or ["txt"]
        for field in fields:
            size = rng.choice([0, 1, 511, 512, 513, rng.randrange(longest)])
            body = str(rng.randrange(10)).encode() if field == "cls" else "é".encode() * (size // 2) if field == "txt" else rng.randbytes(size)
            out.append((f"{key}.{field}", body))
    return out


@pytest.fixture(scope="module")
def foreign(tmp_path_factory):
    """Tars of other makers: folders, long names, both header forms, one that holds most of the bytes, an empty one."""
    where = tmp_path_factory.mktemp("foreign")
    write_tar(where / "a.tar", random_entries(1, 40, 3000))
    write_tar(where / "big.tar", random_entries(2, 400, 20_000), tarfile.PAX_FORMAT)
    write_tar(where / "long.tar", [("d" * 120 + "/" + "k" * 130 + ".txt", b"deep"), ("né.漢.txt", "字".encode()), ("x.txt", b"1"), ("y.txt", b""), ("x.txt", b"2"), ("x.txt", b"3")])
    write_tar(where / "none.tar", [])
    return str(where)


def as_set(df):
    return sorted(((r["__shard__"], r["__place__"], r["__key__"], r["txt"], r["cls"], bytes(r["jpg"]) if r["jpg"] is not None else None) for r in df.collect()), key=repr)


@pytest.mark.parametrize("slice_bytes", [1, 20_000, 1 << 30])
def test_same_samples_as_the_sequential_reader(spark, foreign, slice_bytes):
    index = members.index_tars(spark, foreign)
    got = members.read_members(index, ASKED, slice_bytes if slice_bytes > 1 else 5_000)
    assert as_set(got) == as_set(corpus.read_tar(spark, foreign, FIELDS, shard=True))


def test_offsets_point_at_the_bodies(spark, foreign):
    for row in members.index_tars(spark, foreign).collect():
        name = row.file.removeprefix("file:")
        with tarfile.open(name) as tar:
            assert any(m.offset_data == row.offset and m.size == row.size and m.name == f"{row.key}.{row.field}" for m in tar.getmembers())
    counts = members.index_tars(spark, foreign).groupBy("file", "place").agg(F.min("offset").alias("a"), F.min("start").alias("b"), F.max("start").alias("c"))
    assert counts.where("a <> b OR b <> c").count() == 0


def test_one_large_tar_is_read_by_many_tasks(spark, foreign):
    index = members.index_tars(spark, foreign)
    size = os.path.getsize(f"{foreign}/big.tar")
    got = members.read_members(index.where(F.col("file").endswith("/big.tar")), ASKED, size // 16).withColumn("task", F.spark_partition_id())
    rows = got.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in rows) == 400 and len(rows) >= 3 and max(r.n for r in rows) < 300  # slices go to tasks by a hash of the path


def test_filters_on_the_index_decide_what_is_read(spark, foreign, tmp_path):
    index = members.index_tars(spark, foreign, str(tmp_path / "index"))
    every = {(r["__shard__"], r["__place__"]): r for r in members.read_members(index, ASKED).collect()}
    some = members.read_members(index.where("place % 7 = 3 AND field = 'txt'"), "`__shard__` string, `__place__` long, txt string").collect()
    want = {k for k, r in every.items() if k[1] % 7 == 3 and r.txt is not None}
    assert {(r["__shard__"], r["__place__"]) for r in some} == want and all(every[r["__shard__"], r["__place__"]].txt == r.txt for r in some)
    # an index read anew is the same, and no rows give no rows
    assert members.open_index(spark, str(tmp_path / "index")).exceptAll(index).count() == 0
    assert members.read_members(index.limit(0), ASKED).collect() == []


def test_tars_changed_or_broken(spark, tmp_path):
    write_tar(tmp_path / "t.tar", [("a.txt", b"x" * 5000), ("b.txt", b"y" * 5000)])
    index = members.index_tars(spark, str(tmp_path))
    whole = (tmp_path / "t.tar").read_bytes()
    (tmp_path / "t.tar").write_bytes(whole[:7000])
    with pytest.raises(Exception, match="index is of another file"):
        members.read_members(index, "txt string").collect()
    with pytest.raises(Exception, match="t.tar"):
        members.index_tars(spark, str(tmp_path)).collect()


# ---- buckets


def above(plan: str, what: str) -> list[str]:
    """The nodes over the first line of a plan that holds ``what``."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if what in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    found, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            now = depth(line)
            found.append(line)
    return found


@pytest.mark.parametrize("count,partitions", [(3, "4"), (4, "4"), (4, "64")])
def test_epochs_move_no_payload(spark, count, partitions):
    docs = spark.range(500).select((F.col("id") * 3).alias("sid"), F.concat(F.lit("text "), "id").alias("text"))
    payload = buckets.write_buckets(docs, fresh_dir(spark, "b"), "sid", count)
    texts, orders = {r.sid: r.text for r in docs.collect()}, []
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for epoch in range(3):
            fed = buckets.fetch_bucketed(index_shuffle(docs.select("sid"), "sid", 4, 42, epoch), payload, "sid")
            over = above(fed._jdf.queryExecution().executedPlan().toString(), "Bucketed: true")
            assert any("ShuffledHashJoin" in line for line in over) and not any("Exchange" in line or "Sort " in line for line in over), over
            rows = fed.collect()
            assert sorted(r.pos for r in rows) == list(range(500)) and all(texts[r.sid] == r.text for r in rows)
            orders.append([r.sid for r in sorted(rows, key=lambda r: r.pos)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert orders[0] != orders[1] != orders[2]


def test_buckets_opened_anew_and_edges(spark):
    shape = T.StructType.fromDDL("sid long, `odd ``name` string, inner struct<`a b`:int, c:array<string>>")
    rows = [(1, "x", (1, ["p"])), (2, None, None), (None, "null id", (2, [])), (2, "again", None)]
    docs, where = spark.createDataFrame(rows, shape), fresh_dir(spark, "it's")
    first = buckets.write_buckets(docs, where, "sid", 4)
    again = buckets.open_buckets(spark, where, "sid", 4, shape)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))
    order = spark.createDataFrame([(2, 0), (1, 1), (9, 2), (None, 3)], "sid long, pos long")
    assert sorted((r.sid, r.pos) for r in buckets.fetch_bucketed(order, again, "sid").collect()) == [(1, 1), (2, 0), (2, 0)]
    with pytest.raises(ValueError, match="both have pos"):
        buckets.fetch_bucketed(order, docs.withColumn("pos", F.lit(1)), "sid")
    with pytest.raises(Exception):  # noqa: B017
        buckets.write_buckets(docs, where, "sid", 4)
    empty = buckets.write_buckets(docs.limit(0), fresh_dir(spark, "none"), "sid", 4)
    assert buckets.fetch_bucketed(order, empty, "sid").count() == 0
