"""Numbering, shuffles and batches: invariants and worked examples."""

from pyspark.sql import functions as F
from pyspark.sql import Window

from feedloom.operators import batching, metrics, numbering, sharding, shuffle


def ids(spark, n, parts=4):
    return spark.range(0, n, 1, parts).withColumnRenamed("id", "__id__")


def test_numbers_are_dense_across_buckets(spark):
    sparse = ids(spark, 3000).select((F.col("__id__") * 7 + 3).alias("k"))
    out = numbering.bucketed_window(sparse, [], numbering.id_bucket("k", 8), ["k"], number="n", running={"s": "k"}, previous={"p": "k"})
    rows = out.orderBy("k").collect()
    total = 0
    for i, r in enumerate(rows):
        total += r.k
        assert (r.n, r.s, r.p) == (i, total, rows[i - 1].k if i else None)


def test_keyed_window_equals_plain_window_with_a_hot_and_a_null_key(spark):
    # One key holds most rows, one key is NULL.
    data = ids(spark, 5000).select(
        F.when(F.col("__id__") % 10 < 7, "hot").when(F.col("__id__") % 10 == 7, None).otherwise("cold").alias("k"),
        (F.col("__id__") * 13 % 1000).alias("t"), F.col("__id__").alias("e"), (F.col("__id__") % 11).alias("v"),
    )
    w = Window.partitionBy("k").orderBy("t", "e")
    want = data.select(
        "k", "e", (F.row_number().over(w).cast("long") - 1).alias("n"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("p"),
    )
    got = numbering.bucketed_window(data, ["k"], F.expr("t div 40"), ["t", "e"], number="n", running={"s": "v"}, previous={"p": "v"})
    got = got.select("k", "e", "n", "s", "p")
    assert got.count() == 5000
    assert got.exceptAll(want).count() == 0


def test_file_order_numbers(spark, tmp_path):
    ids(spark, 1000, 3).withColumn("x", F.col("__id__") * 2).write.json(str(tmp_path / "j"))
    df = spark.read.schema("__id__ long, x long").json(str(tmp_path / "j"))
    rows = numbering.number_source_rows(df, "n").collect()
    assert sorted(r.n for r in rows) == list(range(1000))
    by_file = sorted(rows, key=lambda r: r.n)
    assert [r["__id__"] for r in by_file] == list(range(1000))


def test_file_order_numbers_do_not_move_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = numbering.number_source_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Exchange" in line)


def test_shuffle_is_a_permutation_whatever_the_partitions(spark):
    a = shuffle.global_shuffle(ids(spark, 2000, 2), "__id__", 7).collect()
    b = shuffle.global_shuffle(ids(spark, 2000, 9), "__id__", 7).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}
    assert sorted(r.pos for r in a) == list(range(2000))
    other = {r["__id__"]: r.pos for r in shuffle.global_shuffle(ids(spark, 2000), "__id__", 7, epoch=1).collect()}
    assert sum(other[r["__id__"]] != r.pos for r in a) > 1900


def test_rows_in_shuffled_partitions_follow_the_positions(spark):
    df = ids(spark, 1500)
    moved = shuffle.shuffled_partitions(df, "__id__", 3, partitions=5).withColumn("seat", F.monotonically_increasing_id())
    seats = [r["__id__"] for r in moved.orderBy("seat").collect()]
    want = [r["__id__"] for r in shuffle.global_shuffle(df, "__id__", 3).orderBy("pos").collect()]
    assert seats == want


def test_buffer_order_bound_and_repeatability(spark):
    shards = spark.createDataFrame([(0, 0, 1000), (1, 1000, 5), (3, 1005, 70_000)], "shard_id long, first_id long, n_rows long")
    places = shards.withColumn("in_pos", F.explode(F.expr("sequence(0L, n_rows - 1)"))).withColumn("__id__", F.expr("first_id + in_pos"))
    placed = places.select("shard_id", "__id__", "in_pos")
    rows = shuffle.buffer_order(placed, F.col("shard_id"), "in_pos", "__id__", 100, 42).collect()
    assert sorted(r["__id__"] for r in rows) == list(range(71_005))
    assert sorted((r.shard_id, r.out_pos) for r in rows) == sorted((r.shard_id, r.in_pos) for r in rows)
    assert all(abs(r.in_pos - r.out_pos) <= 99 for r in rows)
    again = shuffle.buffer_order(placed.repartition(1), F.col("shard_id"), "in_pos", "__id__", 100, 42).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    assert any(r.in_pos // 100 != r.out_pos // 100 for r in rows)
    other = shuffle.buffer_order(placed, F.col("shard_id"), "in_pos", "__id__", 100, 42, epoch=1).collect()
    assert {tuple(r) for r in rows} != {tuple(r) for r in other}


def test_hash_buckets_grow_with_the_rows(spark):
    ids = spark.range(5000).withColumn("key", shuffle.shuffle_key("id", 1))
    assert {r.b for r in ids.select(numbering.hash_bucket(ids, "key").alias("b")).distinct().collect()} == {0}
    buckets = ids.withColumn("b", numbering.hash_bucket(ids, "key", rows=500))
    found = buckets.groupBy("b").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("b").collect()
    assert [r.b for r in found] == list(range(10)) and all(350 < r.n < 650 for r in found)
    assert all(x.high < y.low for x, y in zip(found, found[1:]))
    cut = numbering.bucketed_window(ids, [], numbering.hash_bucket(ids, "key", rows=500), ["key", "id"], number="pos").collect()
    want = sorted(cut, key=lambda r: r.key)
    assert [r.pos for r in want] == list(range(5000))


def test_window_shuffle_moves_less_than_its_window(spark):
    df = ids(spark, 1000).withColumn("p", F.col("__id__") % 250)
    rows = shuffle.window_shuffle(df, F.expr("__id__ div 250"), "p", "__id__", 40).collect()
    assert all(abs(r.out_pos - r.p) < 40 for r in rows)


def test_index_cut_gives_each_worker_the_same_share(spark):
    rows = shuffle.index_shuffle(ids(spark, 50_000, 8), "__id__", 4).groupBy("worker").count().collect()
    assert sorted((r.worker, r["count"]) for r in rows) == [(w, 12_500) for w in range(4)]


def test_index_shuffle_does_not_sort_payload(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "__id__")
    plan = shuffle.index_shuffle(docs, "__id__", 4)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_every_id_once_per_epoch(spark):
    rows = shuffle.epoch_orders(ids(spark, 300), "__id__", 3).collect()
    for epoch in range(3):
        mine = [r for r in rows if r.epoch == epoch]
        assert sorted(r["__id__"] for r in mine) == sorted(r.pos for r in mine) == list(range(300))
    orders = [tuple(r["__id__"] for r in sorted((r for r in rows if r.epoch == e), key=lambda r: r.pos)) for e in range(3)]
    assert len(set(orders)) == 3


def test_batch_counts(spark):
    df = ids(spark, 1000).withColumn("pos", F.col("__id__"))
    assert batching.global_batches(df, 64).select("batch_id").distinct().count() == 16
    full = batching.full_batches(df, 64).groupBy("batch_id", "full").count().collect()
    assert sorted((r["full"], r["count"]) for r in full) == [(False, 40)] + [(True, 64)] * 15
    runs = batching.smoke_runs(batching.global_batches(df, 64), 6).groupBy("smoke_run").count().collect()
    assert sorted((r.smoke_run, r["count"]) for r in runs) == [(0, 384), (1, 384), (2, 232)]


def test_block_of_2000_rows_makes_32_batches(spark):
    row = batching.block_batches(ids(spark, 2000).withColumn("block", F.lit(0)), "block", 64).first()
    assert (row.n_batches, row.last_rows) == (32, 16)


def test_blocks_of_100k_rows(spark):
    sizes = sharding.id_blocks(ids(spark, 100_000), "__id__", 50).groupBy("block").count().collect()
    assert len(sizes) == 50 and {r["count"] for r in sizes} == {2000}


def test_inflight_estimate(spark):
    blocks = spark.createDataFrame([(b, 2000) for b in range(5)], "block int, n_rows long")
    assert batching.inflight_bytes(blocks).first().peak_bytes == 903_168_000


def test_seek_arithmetic(spark):
    at = sharding.locate_fixed("__id__", 5000)
    row = ids(spark, 30_000).where("__id__ = 23401").select(at["shard_id"].alias("s"), at["place"].alias("p")).first()
    assert (row.s, row.p) == (4, 3401)


def test_locate_over_uneven_shards(spark):
    bounds = [(0, 0, 9), (1, 10, 10), (2, 11, 199_999), (3, 200_000, 200_500), (4, 200_501, 300_000)]
    shards = spark.createDataFrame(bounds, "shard_id long, first_id long, last_id long")
    asked = [0, 9, 10, 11, 65_535, 65_536, 131_072, 199_999, 200_000, 200_501, 262_144, 300_000, 300_001]
    got = sharding.locate(spark.createDataFrame([(i,) for i in asked + [11, 11]], "i long"), "i", shards).collect()
    want = {i: next(((s, i - a) for s, a, b in bounds if a <= i <= b), None) for i in asked}
    assert {r.i: (r.shard_id, r.place) for r in got} == {i: v for i, v in want.items() if v}
    tagged = sharding.tag_shards(spark.createDataFrame([(i,) for i in asked[:-1]], "i long"), "i", shards, 10).collect()
    assert {r.i: r.shard_id for r in tagged} == {i: v[0] for i, v in want.items() if v}


def test_byte_grid_closes_gaps(spark):
    sizes = spark.createDataFrame([(0, 40), (1, 70), (2, 350), (3, 10), (4, 10)], "__id__ long, size long")
    got = [tuple(r) for r in sharding.byte_manifest(sizes, "__id__", "size", 100).orderBy("shard_id").collect()]
    assert got == [(0, 2, 110, 0, 1), (1, 1, 350, 2, 2), (2, 2, 20, 3, 4)]


def test_count_shards_edge_sizes(spark):
    for n, size, want in [(0, 10, []), (5, 10, [5]), (25, 10, [12, 13]), (30, 10, [10, 10, 10])]:
        laid = sharding.count_shards(ids(spark, n), "__id__", size).groupBy("shard_id").count().orderBy("shard_id").collect()
        assert [r["count"] for r in laid] == want


def test_id_slice_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = sharding.id_slice(docs, "doc_id", 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "LessThan(doc_id,20)" in plan


def test_feasibility(spark):
    import pytest

    shards = spark.createDataFrame([(s,) for s in range(3)], "shard_id long")
    sharding.require_feasible(shards, 3)
    with pytest.raises(ValueError):
        sharding.require_feasible(shards, 4)
    starved = sharding.starved_workers(shards, [2, 5]).collect()
    assert sorted((r.num_workers, r.worker) for r in starved) == [(5, 3), (5, 4)]


def test_spans_over_a_hot_series(spark):
    minute = 60_000_000
    times = [0, minute, 2 * minute, 30 * minute, 31 * minute, 41 * minute, 100 * minute]
    df = spark.createDataFrame([("hot", t, i) for i, t in enumerate(times)] + [("b", 5, 99)], "run string, us long, e long")
    got = metrics.run_spans(df, ["run"], "us", 10 * minute).collect()
    spans = sorted((r.run, r.start_us // minute, r.last_us // minute, r.readings) for r in got)
    assert spans == [("b", 0, 0, 1), ("hot", 0, 2, 3), ("hot", 30, 31, 2), ("hot", 41, 41, 1), ("hot", 100, 100, 1)]


def test_gauge_summary_of_absent_readings(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0), ("b", None), ("b", 4.0)], "k string, v double")
    v = F.col("v")
    rows = {r.k: r for r in metrics.gauge_summary(df, ["k"], v, v, v, v, v).collect()}
    assert rows["a"].gpu_util_pct == 0.0 and rows["a"].shm_peak_gb == 0.0
    assert (rows["b"].gpu_util_pct, rows["b"].gpu_util_min, rows["b"].gpu_mem_gb) == (3.0, 2.0, 4.0)


def test_capture_schedule(spark):
    rows = ids(spark, 10).select("__id__", metrics.capture_phase(F.col("__id__")).alias("p")).orderBy("__id__").collect()
    assert [r.p for r in rows] == ["wait"] * 2 + ["warmup"] + ["active"] * 5 + ["done"] * 2


def test_hot_buckets_are_cut_and_nothing_changes(spark):
    """Most batches of one run fall into one minute, some into one instant."""
    data = ids(spark, 4000).select(
        F.when(F.col("__id__") % 8 == 0, "quiet").otherwise("busy").alias("run"), F.col("__id__").alias("event_id"),
        F.when(F.col("__id__") % 4 == 3, F.lit(7_000_000)).when(F.col("__id__") % 4 == 2, F.col("__id__") * 50_000).otherwise(F.col("__id__") * 1_000).cast("long").alias("got_us"),
        F.lit(0).cast("long").alias("start_us"), (F.col("__id__") % 5 + 1).alias("n"),
    ).withColumn("done_us", F.col("got_us") + 300)
    w = Window.partitionBy("run").orderBy("got_us", "event_id")
    want = data.select(
        "run", "event_id", (F.row_number().over(w).cast("long") - 1).alias("i"),
        F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("samples"),
        (F.col("got_us") - F.coalesce(F.lag("done_us").over(w), "start_us")).alias("wait_us"),
    )
    for hot_rows in (10, 1_000_000):
        got = metrics.batch_timeline(data, ["run"], hot_rows).select("run", "event_id", "i", "samples", "wait_us")
        assert got.count() == 4000 and got.exceptAll(want).count() == 0
