"""Readers and writers: round trips, edge rows, failures."""

import io
import json
import os
import shutil
import struct
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.udfs import map_samples
from feedloom.operators.numbering import number_source_rows
from feedloom.plans.views import table
from feedloom.schemas import EPOCH_RECORD, modality_schema
from feedloom.session import fresh_dir, shared_dir
from feedloom.sources import corpus, sinks
from feedloom.sources.indexed import fetch_samples

EDGE_TEXTS = ["", "plain", "né 漢字 😀🎉", "x" * 5000, "line\nbreak\ttab", "y" * 20]


@pytest.fixture()
def edge(spark):
    rows = [(i, t, json.dumps({"n": i})) for i, t in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, "__id__ long, text string, meta string")


def as_pairs(df):
    return sorted((r["__id__"], r["text"]) for r in df.select("__id__", "text").collect())


def test_jsonl_with_a_broken_line(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").orderBy("doc_id").limit(50).collect()
    lines = [json.dumps({"text": d.text, "meta": {"lang": d.lang, "source": d.source}}) for d in docs]
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:20] + ["{broken"] + lines[20:]))
    meta = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
    df = corpus.read_text_corpus(spark, str(tmp_path), meta).cache()
    assert df.where("_corrupt_record IS NOT NULL").count() == 1
    good = df.where("_corrupt_record IS NULL").select("text", "meta.lang").collect()
    assert [(r.text, r.lang) for r in good] == [(d.text, d.lang) for d in docs]
    # metadata also reads as JSON text
    assert json.loads(corpus.read_text_corpus(spark, str(tmp_path)).first().meta) == {"lang": docs[0].lang, "source": docs[0].source}


def test_all_formats_hold_the_same_rows(spark, edge):
    paths = sinks.write_formats(edge, fresh_dir(spark, "t"), "text", parquet_rows=2, tar_rows=4, limit=1000)
    assert paths["parquet"].endswith("/text/parquet") and paths["tar"].endswith("/text/webdataset") and paths["indexed"].endswith("/text/mds")
    want = list(enumerate(EDGE_TEXTS))
    assert as_pairs(corpus.read_layout(spark, "parquet", paths["parquet"])) == want
    assert as_pairs(corpus.read_layout(spark, "indexed", paths["indexed"])) == want
    tar = corpus.read_layout(spark, "tar", paths["tar"])
    assert as_pairs(tar.select(F.col("__key__").cast("long").alias("__id__"), F.col("txt").alias("text"))) == want
    names = [r.file for r in corpus.read_manifest(spark, paths["parquet"]).orderBy("shard_id").collect()]
    assert names == [f"shard-{i:05d}-of-00003.parquet" for i in range(3)]
    assert corpus.read_parquet_shards(spark, paths["parquet"], 3).rdd.getNumPartitions() == 3
    sizes = corpus.list_shards(spark, paths["parquet"] + "/data", "*.parquet").collect()
    assert len(sizes) == 3 and all(r.bytes > 0 for r in sizes)


def test_empty_corpus(spark, edge):
    paths = sinks.write_formats(edge.limit(0), fresh_dir(spark, "t"), "text")
    for fmt in ("tar", "indexed"):
        assert corpus.read_layout(spark, fmt, paths[fmt]).count() == 0
    assert corpus.read_manifest(spark, paths["tar"]).count() == 0


def test_greedy_limit_is_strict_except_for_a_lone_row(spark, edge):
    where = fresh_dir(spark, "t")
    sinks.write_indexed(edge, where, 900, "text", greedy=True, range_rows=100)
    shards = corpus.read_manifest(spark, where).orderBy("shard_id").collect()
    assert [s.first_id for s in shards][1:] == [s.last_id + 1 for s in shards[:-1]]
    sizes = {r.path.split("/")[-1]: r.bytes for r in corpus.list_shards(spark, where, "*.mds").collect()}
    assert all(sizes[s.file] <= 900 or s.n_rows == 1 for s in shards)
    assert as_pairs(corpus.read_indexed(spark, where)) == list(enumerate(EDGE_TEXTS))


def test_indexed_bytes_follow_the_layout(spark, edge):
    where = fresh_dir(spark, "t")
    sinks.write_indexed(edge, where, 1 << 20, "text")
    index = json.load(open(f"{where}/index.json"))
    (shard,) = index["shards"]
    raw = open(f"{where}/{shard['raw_data']['basename']}", "rb").read()
    assert len(raw) == shard["raw_data"]["bytes"] and shard["samples"] == 6 and shard["format"] == "mds"
    (n,) = struct.unpack_from("<I", raw)
    offsets = struct.unpack_from(f"<{n + 1}I", raw, 4)
    assert n == 6 and offsets[-1] == len(raw)
    assert json.loads(raw[4 + 4 * (n + 1): offsets[0]])["column_names"] == ["__id__", "meta", "text"]
    meta_size, text_size = struct.unpack_from("<2I", raw, offsets[2])
    body = raw[offsets[2] + 8: offsets[3]]
    assert struct.unpack_from("<q", body)[0] == 2
    assert body[8 + meta_size:].decode() == EDGE_TEXTS[2] and len(body[8 + meta_size:]) == text_size


def test_random_access_with_repeated_and_missing_ids(spark, edge):
    where = fresh_dir(spark, "t")
    sinks.write_indexed(edge, where, 600, "text")
    wanted = spark.createDataFrame([(3,), (2,), (2,), (99,)], "__id__ long")
    assert as_pairs(fetch_samples(spark, where, wanted)) == [(2, EDGE_TEXTS[2]), (2, EDGE_TEXTS[2]), (3, EDGE_TEXTS[3])]
    schema = T.StructType([T.StructField("__id__", T.LongType()), T.StructField("n", T.LongType())])
    hooked = fetch_samples(spark, where, wanted, transform=lambda s: {"__id__": s["__id__"], "n": len(s["text"])}, schema=schema)
    assert sorted((r["__id__"], r.n) for r in hooked.collect()) == [(2, len(EDGE_TEXTS[2])), (2, len(EDGE_TEXTS[2])), (3, 5000)]


def test_foreign_tars_with_a_missing_field(spark, tmp_path):
    for shard in range(3):
        with tarfile.open(tmp_path / f"part-{shard}.tar", "w") as tar:
            for k in range(4):
                for ext, body in {"jpg": b"\xff\xd8" + bytes([k]), "txt": f"caption {k}".encode()}.items():
                    if (shard, k, ext) == (1, 2, "jpg"):
                        continue
                    entry = tarfile.TarInfo(f"{shard:04d}{k:04d}.{ext}")
                    entry.size = len(body)
                    tar.addfile(entry, io.BytesIO(body))
    df = corpus.read_corpus(spark, "image+text", str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    rows = {r["__key__"]: r for r in df.collect()}
    assert len(rows) == 12 and rows["00010002"].jpg is None and rows["00010002"].txt == "caption 2"
    assert bytes(rows["00020001"].jpg) == b"\xff\xd8\x01"
    named = corpus.read_tar(spark, str(tmp_path), "txt string", shard=True).groupBy("__shard__").count().collect()
    assert {(r["__shard__"], r["count"]) for r in named} == {(f"part-{i}.tar", 4) for i in range(3)}


def test_no_second_write_into_a_folder(spark, edge):
    where = fresh_dir(spark, "t")
    sinks.write_tar(edge.withColumnRenamed("text", "txt"), where, ["txt"], 2)
    with pytest.raises(Exception, match="already holds shards"):
        sinks.write_tar(edge.withColumnRenamed("text", "txt"), where, ["txt"], 2)


def test_nothing_readable_after_a_failed_write(spark, edge):
    where = fresh_dir(spark, "t")
    bad = edge.withColumn("text", F.when(F.col("__id__") < 3, F.col("text")))
    with pytest.raises(Exception, match="is NULL"):
        sinks.write_indexed(bad, where, 600, "text")
    with pytest.raises(Exception):
        corpus.read_indexed(spark, where).count()


def test_a_shard_split_over_tasks_is_refused(spark, edge):
    corpus.register_sources(spark)
    where = fresh_dir(spark, "t")
    split = edge.select("__id__", F.lit(0).cast("long").alias("shard_id"), F.col("text").alias("txt")).repartition(3, "__id__")
    with pytest.raises(Exception):
        split.write.format("tar_shards").option("path", where).mode("append").save()


def test_extra_tar_fields(spark, edge):
    where = fresh_dir(spark, "t")
    sinks.write_tar(edge.select("__id__", F.col("text").alias("txt"), F.col("meta").alias("json")), where, ["txt", "json"], 4)
    rows = corpus.read_tar(spark, where, "txt string, json string").orderBy("__key__").collect()
    assert [json.loads(r.json)["n"] for r in rows] == list(range(6))
    assert open(f"{where}/manifest.txt").read() == "shard-000000.tar\nshard-000001.tar"


def test_footprint(spark, edge, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"1" * 100)
    (tmp_path / "sub" / "b.bin").write_bytes(b"1" * 50)
    row = sinks.storage_footprint(spark, str(tmp_path)).first()
    assert (row.files, row.bytes) == (2, 150)


def test_results_round_trip(spark, tmp_path):
    record = {f.name: None for f in EPOCH_RECORD}
    record.update(epoch=0, batches=10, total_samples=640, elapsed_sec=1.5, samples_per_sec=426.67, loader="tar", dataset="text", batch_size=64, num_workers=4)
    (tmp_path / "tar_text_bs64_w4_epoch0.json").write_text(json.dumps(record, indent=2))
    read = corpus.read_results(spark, str(tmp_path))
    row = read.first()
    assert (row.batches, row.samples_per_sec, row.loader) == (10, 426.67, "tar")
    where = fresh_dir(spark, "results")
    sinks.write_results(read, where)
    again = spark.read.json(where).first()
    assert again.run == "tar_text_bs64_w4_epoch0" and again.dataset == "text"
    # Several records of one loader and dataset share a file; each comes back, with its folder's names.
    sinks.write_results(read.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in (1, 2, 3)]))).coalesce(1), where)
    back = corpus.read_written_results(spark, where).orderBy("epoch").collect()
    assert [(r.epoch, r.loader, r.dataset, r.run[-6:]) for r in back] == [(e, "tar", "text", f"epoch{e}") for e in range(4)]


def test_choices_are_checked_before_jobs(spark):
    for call in (lambda: modality_schema("video"), lambda: sinks.layout_path("o", "text", "zip"), lambda: corpus.read_layout(spark, "zip", "x")):
        with pytest.raises(ValueError):
            call()


def test_shared_dir_is_the_one_the_session_names(spark):
    assert fresh_dir(spark, "x").startswith(shared_dir(spark)) and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_user_function_over_samples(spark, edge):
    out = map_samples(edge.select("__id__", "text"), lambda r: {"__id__": r["__id__"], "n": len(r["text"])}, "__id__ long, n long", partitions=3)
    assert sorted((r["__id__"], r.n) for r in out.collect()) == [(i, len(t)) for i, t in enumerate(EDGE_TEXTS)]


def test_ids_for_a_multi_file_corpus(spark, tmp_path):
    for name, count in (("a", 3), ("b", 4), ("c", 2)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"text": f"{name}{i}", "meta": {}}) for i in range(count)))
    df = spark.read.schema("text string").json(str(tmp_path))
    got = [r.text for r in number_source_rows(df).orderBy("__id__").collect()]
    assert got == ["a0", "a1", "a2", "b0", "b1", "b2", "b3", "c0", "c1"]


def test_layouts_without_our_shard_list(spark, edge, tmp_path):
    """Tars and indexed shards as another writer would leave them: no shard list."""
    from feedloom.plans import feeds

    where = fresh_dir(spark, "t")
    paths = sinks.write_formats(edge, where, "text", ("tar", "indexed"), tar_rows=2, limit=3000)
    for fmt, suffix in (("tar", ".tar"), ("indexed", ".mds")):
        bare = tmp_path / fmt
        bare.mkdir()
        for name in os.listdir(paths[fmt]):
            if name.endswith(suffix) or name == "index.json":
                shutil.copy(f"{paths[fmt]}/{name}", bare / name)
        ours = corpus.read_manifest(spark, paths[fmt]).orderBy("shard_id").collect()
        derived = corpus.read_manifest(spark, str(bare)).orderBy("shard_id").collect()
        pick = lambda rows: [(r.shard_id, r.file, r.n_rows, r.first_id, r.last_id) for r in rows]
        assert pick(derived) == pick(ours)
        assert feeds.FEEDS[fmt](spark, str(bare), "text", 1, 1).count() == 6
    assert as_pairs(fetch_samples(spark, str(tmp_path / "indexed"), edge.select("__id__"))) == list(enumerate(EDGE_TEXTS))
    assert [r.file for r in corpus.read_shard_list(spark, paths["tar"]).collect()] == [f"shard-{i:06d}.tar" for i in range(3)]


def test_a_retried_task_writes_the_same_bytes(tmp_path):
    """Both attempts of a task leave one identical shard and one manifest row."""
    import pyarrow as pa

    from feedloom.sources.tar import TarWriter

    batch = pa.RecordBatch.from_pylist([{"shard_id": 3, "__id__": i, "txt": f"t{i}"} for i in range(6, 8)])
    writer = TarWriter(str(tmp_path / "w"), ["txt"])
    lost = writer.write(iter([batch]))
    first = (tmp_path / "w" / "shard-000003.tar").read_bytes()
    kept = writer.write(iter([batch]))
    assert lost == kept and (tmp_path / "w" / "shard-000003.tar").read_bytes() == first
    writer.commit([kept])
    assert sorted(os.listdir(tmp_path / "w")) == ["manifest.txt", "shard-000003.tar", "shards.jsonl"]


def test_a_split_shard_is_refused_at_commit(tmp_path):
    import pyarrow as pa

    from feedloom.sources.tar import TarWriter

    writer = TarWriter(str(tmp_path / "w"), ["txt"])
    parts = [writer.write(iter([pa.RecordBatch.from_pylist([{"shard_id": 0, "__id__": i, "txt": "x"}])])) for i in range(2)]
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit(parts)


class _Session:
    """A session without the setting, on a given master."""

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()
        self.conf = type("F", (), {"get": staticmethod(lambda key, default=None: default)})()


def test_own_folder_only_in_local_mode():
    local = _Session("local[2]")
    assert shared_dir(local) == shared_dir(local) and os.path.isdir(shared_dir(local))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host:7077"))


def test_relative_and_file_paths(tmp_path, monkeypatch):
    from feedloom.sources.shardfiles import open_fs

    monkeypatch.chdir(tmp_path)
    assert open_fs("out/text")[1] == str(tmp_path / "out" / "text")
    assert open_fs(f"file:{tmp_path}")[1] == open_fs(str(tmp_path))[1] == str(tmp_path)


def test_bare_paths_are_refused_on_a_cluster(monkeypatch):
    from pyspark import SparkContext

    from feedloom.sources.shardfiles import open_fs

    class Cluster:
        master = "spark://somewhere:7077"

    monkeypatch.setattr(SparkContext, "_active_spark_context", Cluster())
    with pytest.raises(ValueError, match="scheme"):
        open_fs("/data/out")
    assert open_fs("file:///data/out")[1] == "/data/out"


def test_file_names_are_not_escaped_uris(tmp_path):
    from feedloom.sources.shardfiles import exists, open_fs

    where = tmp_path / "my out%20" / "50%"
    where.mkdir(parents=True)
    for start in ("file:", "file://"):
        files, root = open_fs(f"{start}{where}/")
        assert root == str(where) and exists(files, root)
    with pytest.raises(ValueError):
        open_fs("file://elsewhere/data")
