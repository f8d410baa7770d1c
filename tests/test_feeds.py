"""Preparation and feeds from end to end."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import images
from feedloom.plans import feeds
from feedloom.session import fresh_dir
from feedloom.sources import corpus, sinks


@pytest.fixture(scope="module")
def layouts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "__id__")
    docs = docs.select("__id__", "text", F.struct("lang").alias("meta"))
    return sinks.write_formats(docs, fresh_dir(spark, "feeds"), "text", parquet_rows=50, tar_rows=32, limit=20_000)


@pytest.mark.parametrize("loader,ident", [("tar", "__key__"), ("indexed", "__id__"), ("parquet", "__id__")])
def test_each_sample_at_most_once_and_batches_filled(spark, layouts, loader, ident):
    rows = feeds.FEEDS[loader](spark, layouts[loader], "text", 16, 3).select(F.col(ident).cast("long").alias("i"), "worker", "batch_id", "seat").collect()
    assert len({r.i for r in rows}) == len(rows)
    per_worker = {}
    for r in rows:
        per_worker.setdefault(r.worker, []).append(r)
    for mine in per_worker.values():
        assert sorted(r.seat for r in mine) == list(range(len(mine)))
        assert all(r.batch_id == r.seat // 16 for r in mine)
    assert len(rows) == 200
    if loader == "indexed":
        full = feeds.indexed_feed(spark, layouts[loader], "text", 16, 3).where("full").count()
        assert full == sum(n // 16 * 16 for n in (67, 67, 66))
    other = {r.i: (r.worker, r.seat) for r in feeds.FEEDS[loader](spark, layouts[loader], "text", 16, 3, epoch=1).select(F.col(ident).cast("long").alias("i"), "worker", "seat").collect()}
    assert sum(other.get(r.i) != (r.worker, r.seat) for r in rows) > 100


@pytest.mark.parametrize("loader", ["tar", "indexed", "parquet"])
def test_feed_timing_counts_everything(spark, layouts, loader):
    records = feeds.time_feed(spark, loader, "text", layouts[loader], 16, workers=2, epochs=2).orderBy("epoch").collect()
    want = {"tar": (200, 14), "indexed": (200, 14), "parquet": (200, 13)}[loader]
    assert [(r.total_samples, r.batches) for r in records] == [want, want] or loader == "tar"
    if loader == "tar":  # the split of shards over workers changes per epoch
        assert all(r.total_samples == 200 and r.batches in (13, 14) for r in records)
    assert all(r.samples_per_sec > 0 and r.timestamp is not None for r in records)
    capped = feeds.time_feed(spark, loader, "text", layouts[loader], 16, workers=2, epochs=1, max_batches=5).first()
    assert (capped.batches, capped.total_samples) == (5, 80)


def test_unknown_choices(spark):
    for args in (("zip", "text"), ("tar", "video")):
        with pytest.raises(ValueError):
            feeds.time_feed(spark, *args, "x", 16)
    with pytest.raises(ValueError):
        feeds.prepare(spark, "text", "x", "y", ("zip",))


def test_more_workers_than_shards(spark, layouts):
    with pytest.raises(ValueError, match="shards"):
        feeds.tar_feed(spark, layouts["tar"], "text", 16, 100)


def test_cap_is_applied_before_samples_are_fetched(spark, layouts):
    feed = feeds.indexed_feed(spark, layouts["indexed"], "text", 16, 2, max_batches=3)
    assert feed.count() == 48


def pixels(seed):
    return np.random.default_rng(seed).integers(0, 256, (12, 10, 3), dtype=np.uint8)


def test_images_from_folder_to_feed(spark, tmp_path):
    for label in (0, 1):
        (tmp_path / f"label={label}").mkdir()
        for i in range(5):
            (tmp_path / f"label={label}" / f"{i}.png").write_bytes(images.encode_png(pixels(label * 5 + i)))
    (tmp_path / "label=1" / "9.png").write_bytes(b"not a picture")
    paths = feeds.prepare(spark, "images", str(tmp_path), fresh_dir(spark, "img"), tar_rows=4, parquet_rows=4, limit=10_000)
    for loader, field in (("tar", "jpg"), ("indexed", "image"), ("parquet", "image")):
        every = feeds.FEEDS[loader](spark, paths[loader], "images", 1, 1).select(field, "decode_error").collect()
        rows = [r for r in every if r.decode_error is None]
        assert len(every) == 11 and [r[field] for r in every if r.decode_error is not None] == [None]
        got = sorted(bytes(r[field].data) for r in rows)
        assert got == sorted(images.resize_planes(pixels(s)).tobytes() for s in range(10))
        assert all(r[field].shape == [3, 224, 224] for r in rows)


def test_pairs_from_tars_with_a_cap(spark, tmp_path):
    for shard in range(2):
        with tarfile.open(tmp_path / f"in-{shard}.tar", "w") as tar:
            for k in range(6):
                for ext, body in (("jpg", images.encode_png(pixels(k))), ("txt", f"{shard}/{k}".encode())):
                    entry = tarfile.TarInfo(f"some_{shard}_{k}.{ext}")
                    entry.size = len(body)
                    tar.addfile(entry, io.BytesIO(body))
    paths = feeds.prepare(spark, "image+text", str(tmp_path), fresh_dir(spark, "pairs"), ("tar", "indexed"), row_cap=9, tar_rows=5)
    rows = corpus.read_indexed(spark, paths["indexed"]).orderBy("__id__").collect()
    assert [r.txt for r in rows] == [f"{i // 6}/{i % 6}" for i in range(9)]
    feed = feeds.tar_feed(spark, paths["tar"], "image+text", 4, 2).collect()
    assert len(feed) == 9 and all(r.jpg.shape == [3, 224, 224] for r in feed)


def test_text_from_jsonl_keeps_file_order_and_fails_on_broken_lines(spark, tmp_path):
    for name, count in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"text": f"{name}{i}", "meta": {"n": i}}) for i in range(count)))
    paths = feeds.prepare(spark, "text", str(tmp_path), fresh_dir(spark, "txt"), ("tar",))
    rows = corpus.read_tar(spark, paths["tar"]).orderBy("__key__").collect()
    assert [r.txt for r in rows] == ["a0", "a1", "a2", "b0", "b1"]
    (tmp_path / "c.jsonl").write_text("{broken")
    with pytest.raises(Exception):
        feeds.prepare(spark, "text", str(tmp_path), fresh_dir(spark, "txt"), ("tar",))


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "Reused" not in line]


def test_tar_and_indexed_feeds_shuffle_no_payload(spark, layouts):
    tar = feeds.tar_feed(spark, layouts["tar"], "text", 16, 2)._jdf.queryExecution().executedPlan().toString()
    scan_branch = tar.splitlines()
    scan = next(i for i, line in enumerate(scan_branch) if "tar_shards" in line.lower() or "BatchScan" in line)
    join = next(i for i, line in enumerate(scan_branch) if "BroadcastHashJoin" in line)
    assert join < scan and not any("Exchange hashpartitioning" in line for line in scan_branch[join:scan])
    plan = feeds.indexed_feed(spark, layouts["indexed"], "text", 16, 2)._jdf.queryExecution().executedPlan().toString().splitlines()
    fetch = next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert not any("Exchange" in line for line in plan[:fetch])
