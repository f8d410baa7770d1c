"""Streams over several files agree with batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from feedloom.plans import views
from feedloom.session import fresh_dir
from feedloom.streaming import gauges as live

SCHEMA = "ts timestamp, id long, k string, v double"


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=second)


@pytest.fixture()
def feed(spark, tmp_path):
    """Three files of one-second readings with NULL, NaN, a late row and a silent gap."""
    files = [
        [(at(s), s, "a", float(s)) for s in range(0, 20)] + [(at(3), 100, "b", None), (at(4), 101, "b", float("nan"))],
        [(at(s), s, "a", float(s)) for s in range(60, 80)],
        [(at(2), 200, "a", 999.0)] + [(at(s), s, "a", float(s)) for s in range(200, 220)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"raw{i}"))
        (part,) = (tmp_path / f"raw{i}").glob("*.parquet")
        target = tmp_path / "feed" / f"f{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path / "feed")


def stream(spark, feed):
    return live.read_stream(spark, feed, T._parse_datatype_string(SCHEMA), files_per_batch=1)


def second_of(row):
    return row.window_us // 1_000_000 - int(at(0).replace(tzinfo=dt.timezone.utc).timestamp())


def test_late_rows_are_dropped_and_gaps_stay_open(spark, feed):
    table = live.append_table(spark, live.window_stats(stream(spark, feed), ["k"], F.col("v"), 5), "w")
    rows = {(r.k, second_of(r)): r for r in table.collect()}
    assert rows[("a", 0)].readings == 5 and rows[("a", 0)].mean_value == 2.0 and rows[("a", 0)].max_value == 4.0
    assert rows[("b", 0)].readings == 0 and rows[("b", 0)].mean_value is None
    assert not [s for _, s in rows if 20 <= s < 60 or 80 <= s < 200]
    # open windows behind the 10 s watermark are not emitted yet: the newest row is at 219
    assert max(s for _, s in rows) == 200


def test_sessions_end_at_the_gap(spark, feed):
    # Row 200 is left out: its session still reaches past the watermark its micro-batch is judged by.
    readings = stream(spark, feed).where("v IS NOT NULL AND id <> 200")
    table = live.append_table(spark, live.session_spans(readings, ["k"], "30 seconds"), "s")
    rows = sorted((r.k, r.readings) for r in table.collect())
    assert rows == [("a", 20), ("a", 20), ("b", 1)]


def test_latest_per_refresh(spark, feed):
    table = live.append_table(spark, live.window_latest(stream(spark, feed), ["k"], "v", "id", 5), "l")
    rows = {(r.k, second_of(r)): r.last_value for r in table.collect()}
    assert rows[("a", 0)] == 4.0 and rows[("a", 75)] == 79.0


def test_upserts_keep_the_newest_reading(spark, feed):
    table = live.snapshot_table(spark, stream(spark, feed), live.newest_reading(["k"], "v", "id"), "u", "append")
    rows = {r.k: r for r in table.collect()}
    assert rows["a"].v == 219.0 and rows["a"].id == 219 and rows["b"].id == 101


def test_a_replayed_batch_changes_nothing(spark):
    snapshots = live.Snapshots(f"{fresh_dir(spark, 'replay')}/t")
    apply = snapshots.upsert(live.newest_batch(["k"]))
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    second = spark.createDataFrame([("a", 5)], "k string, n long")
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        apply(batch, number)
    assert {tuple(r) for r in snapshots.read(spark).collect()} == {("a", 5), ("b", 2)}


def test_counters_over_many_micro_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "e"))
    parts = live.read_stream(spark, str(tmp_path / "e"), events.schema, files_per_batch=1)
    table = live.snapshot_table(spark, live.live_counters(views.as_batches(parts), ["run"]), live.newest_batch(["run"]), "c")
    want = views.as_batches(events).groupBy("run").agg(F.count("*").alias("b"), F.sum("n").alias("n")).collect()
    assert {(r.run, r.batches, r.total_samples) for r in table.collect()} == {(r.run, r.b, r.n) for r in want}


@pytest.fixture(scope="module")
def by_folder(spark, tmp_path_factory):
    """The same events as a table of one file and as a folder of three."""
    kinds = ["view", "click", "error"]
    rows = [(i, at(97 * i), i % 11, kinds[i % 3], float(i % 50), None) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    where = tmp_path_factory.mktemp("events")
    events.repartition(3).write.parquet(f"{where}/folder/events.parquet")
    events.coalesce(1).write.parquet(f"{where}/raw")
    (part,) = (where / "raw").glob("*.parquet")
    (where / "file").mkdir()
    part.rename(where / "file" / "events.parquet")
    return where


def same_by_folder(spark, where, name):
    """Rows of a query, which are the same from both."""
    whole, parts = (sorted(str(r) for r in entry.queries()[name](spark, f"{where}/{kind}").collect()) for kind in ("file", "folder"))
    assert parts == whole
    return whole


def test_current_values_of_a_table_in_a_folder(spark, by_folder):
    assert same_by_folder(spark, by_folder, "gauge_upserts")


def test_counters_of_a_table_in_a_folder(spark, by_folder):
    assert same_by_folder(spark, by_folder, "live_counters")


@pytest.mark.parametrize("name", ["gauge_windows_stream", "gauge_latest_stream", "run_spans_stream"])
def test_windows_of_a_table_in_a_folder(spark, by_folder, name):
    assert same_by_folder(spark, by_folder, name)


def test_a_stream_with_an_end_closes_every_window(spark, feed):
    readings, end = live.with_end(stream(spark, feed).where("id <> 200"), "ts")
    table = live.append_table(spark, live.window_stats(readings, ["k"], F.col("v"), 5), "e", end)
    rows = {(r.k, second_of(r)): r.readings for r in table.collect()}
    assert rows[("a", 215)] == 5 and max(s for _, s in rows) == 215 and sum(n for (k, _), n in rows.items() if k == "a") == 59
    readings, end = live.with_end(stream(spark, feed).where("v IS NOT NULL AND id <> 200"), "ts")
    table = live.append_table(spark, live.session_spans(readings, ["k"], "30 seconds"), "f", end)
    assert sorted((r.k, r.readings) for r in table.collect()) == [("a", 19), ("a", 20), ("a", 20), ("b", 1)]


def test_means_of_very_small_and_large_values(spark):
    from feedloom.operators import metrics

    rows = spark.createDataFrame([("s", 1e-7), ("s", 3e-7), ("l", 1e23), ("l", 3e23)], "k string, v double")
    got = {r.k: r.v for r in metrics.epoch_average(rows, ["k"], ["v"]).collect()}
    assert got["s"] == pytest.approx(2e-7) and got["l"] == pytest.approx(2e23)
