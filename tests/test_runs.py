"""Runs ended by markers, silence and timers, against a plain loop; late rows; restarts."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import fresh_dir
from feedloom.streaming import gauges as live
from feedloom.streaming import runs

SCHEMA = "ts timestamp, id long, k string, v double"
START = dt.datetime(2024, 1, 1)
GAP = 30_000_000


def at(second):
    return START + dt.timedelta(seconds=second)


def us(second):
    return int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000) + int(second * 1_000_000)


def plain(rows, gap):
    """(start, last, readings, by marker) of one series' (us, id, ended) rows."""
    out, run = [], None
    for when, _, ended in sorted(rows):
        if run and when - run[1] >= gap:
            out.append((*run, False))
            run = None
        run = (run[0] if run else when, when, (run[2] if run else 0) + (not ended))
        if ended:
            out.append((*run, True))
            run = None
    return [r for r in out + ([(*run, False)] if run else []) if r[2]]


def test_runs_of_a_table(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(4000) * 1_000_000, i, rng.random() < 0.1) for i in range(400)] + [("n", None, 1, False), ("m", 5, 900, True)]
    frame = spark.createDataFrame(rows, "k string, us long, id long, ended boolean").repartition(5)
    for hot in (5_000_000, 3):
        got = {}
        for r in runs.marked_runs(frame, ["k"], "us", "id", "ended", GAP, hot).collect():
            got.setdefault(r.k, []).append((r.start_us, r.last_us, r.readings, r.by_marker))
        want = {k: plain([r[1:] for r in rows if r[0] == k], GAP) for k in ("a", "b", None)}
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_any_cut_of_a_series_gives_its_runs():
    rng = random.Random(7)
    for _ in range(200):
        rows = sorted((rng.randrange(60), i, rng.random() < 0.2) for i in range(rng.randrange(0, 25)))
        cuts = sorted(rng.randrange(70) for _ in range(rng.randrange(0, 6)))
        closed, opened, done = [], None, -1
        for cut in [*cuts, 1000]:
            part = np.array([r for r in rows if done <= r[0] < cut], runs._ROW)
            some, opened = runs.close_runs(opened, part, cut, 7)
            closed += some
            done = cut
        assert opened is None and closed == plain(rows, 7)


def arrive(spark, folder, rows, number):
    """One file of the feed; files come in the order of their times."""
    import os
    import pathlib

    made = f"{folder}-raw{number}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(made)
    (part,) = pathlib.Path(made).glob("*.parquet")
    target = pathlib.Path(folder) / f"f{number}.parquet"
    target.parent.mkdir(exist_ok=True)
    target.write_bytes(part.read_bytes())
    os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))


def tracked(spark, folder):
    feed = live.read_stream(spark, folder, T._parse_datatype_string(SCHEMA), files_per_batch=1)
    return runs.track_runs(feed, ["k"], "id", F.isnan("v"), GAP)


def test_markers_timers_late_rows_and_a_restart(spark, tmp_path):
    folder, where = str(tmp_path / "feed"), fresh_dir(spark, "tracked")
    arrive(spark, folder, [(at(s), s, "a", 1.0) for s in range(0, 20)] + [(at(5), 50, "b", 1.0), (at(12), 51, "b", float("nan")), (None, 52, "b", 1.0)], 0)
    arrive(spark, folder, [(at(15.5), 60, "a", 1.0)] + [(at(s), s, "a", 1.0) for s in range(60, 80)], 1)

    def go():
        with runs.rocks_state(spark):
            live.finish(tracked(spark, folder), f"{where}/table", f"{where}/checkpoint")
        rows = spark.read.parquet(f"{where}/table").collect()
        return sorted((r.k, r.kind, r.start_us, r.last_us, r.readings, r.by_marker) for r in rows)

    # a's first run has the reading that came after later ones; b's ends at its marker and not by silence.
    first = [("a", "run", us(0), us(19), 21, False), ("b", "run", us(5), us(12), 1, True)]
    assert go() == first
    # A new start goes on with the open run of 60..79; the reading of second 3 is behind what is decided.
    arrive(spark, folder, [(at(3), 300, "a", 1.0), (at(85), 85, "a", 1.0)], 2)
    arrive(spark, folder, [(at(300), 301, "c", 1.0)], 3)
    assert go() == sorted([*first, ("a", "late", us(3), us(3), 1, False), ("a", "run", us(60), us(85), 21, False)])
