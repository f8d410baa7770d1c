"""Runs of a series, ended by a marker or by silence, with late rows kept aside.

A marker is a reading without a number (NaN), as a loop leaves it when it ends.  The state of a series is
its open run and the readings that the watermark hasn't passed yet; readings are put in order of time before they count, so
the runs don't depend on how the stream was cut into micro-batches.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from feedloom.operators.metrics import time_order
from feedloom.operators.numbering import HOT_BUCKET_ROWS, bucketed_window, time_bucket
from feedloom.streaming.gauges import LATENESS, End, append_table

_STATE = "opened long, last long, readings long, until long, waiting binary"
_ROW = np.dtype([("us", "<i8"), ("id", "<i8"), ("ended", "?")])
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def marked_runs(readings: DataFrame, keys: list[str], micros: str, ident: str, ended: str, gap_us: int, hot_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """Runs of a finished table: a reading after a marker, or ``gap_us`` or more after the one before, begins a run.

    ``ended`` says which readings are markers; a marker is the end of its run but no reading, and one without readings makes
    no run. Equal times go by id; a null time is no reading, a null key is a series. A series is spread over its
    minutes, so one with a third of all rows is not gathered.
    """
    timed = readings.where(F.col(micros).isNotNull()).select(*keys, micros, ident, F.coalesce(ended, F.lit(False)).alias("_ended"))
    spread_over = {"fine": F.expr(f"{micros} div 1000"), "hot_rows": hot_rows, "latest": time_order(F.col(micros), F.col(ident))}
    # A null key would not meet its summary again in the windows' joins; inside a struct it does.
    named = timed.withColumn("_series", F.struct(*keys))
    seen = bucketed_window(named, ["_series"], time_bucket(micros), [micros, ident], previous={"_before": micros, "_closed": "_ended"}, **spread_over)
    begins = F.col("_before").isNull() | F.col("_closed") | (F.col(micros) - F.col("_before") >= F.lit(gap_us))
    begun = seen.withColumn("_begins", begins.cast("long")).drop("_before", "_closed")
    numbered = bucketed_window(begun, ["_series"], time_bucket(micros), [micros, ident], running={"_run": "_begins"}, **spread_over)
    runs = numbered.groupBy("_series", "_run").agg(
        F.min(micros).alias("start_us"), F.max(micros).alias("last_us"),
        F.sum((~F.col("_ended")).cast("long")).alias("readings"), F.max("_ended").alias("by_marker"),
    )
    return runs.where("readings > 0").select("_series.*", "start_us", "last_us", "readings", "by_marker")


def close_runs(opened: tuple[int, int, int] | None, rows: np.ndarray, until: int, gap_us: int):
    """(closed runs, open run) of a series whose readings before ``until`` are all known.

    A run is (start, last, readings, by marker); ``rows`` are in order; ``opened`` is (start, last, readings).
    """
    closed = []
    if len(rows):
        before = np.concatenate([[opened[1] if opened else rows["us"][0]], rows["us"][:-1]])
        begins = np.concatenate([[opened is None], rows["ended"][:-1]]) | (rows["us"] - before >= gap_us)
        at = np.flatnonzero(begins)
        starts = at if opened is None or begins[0] else np.concatenate([[0], at])
        counts = np.add.reduceat((~rows["ended"]).astype(np.int64), starts)
        lasts = np.concatenate([starts[1:], [len(rows)]]) - 1
        if opened is not None and begins[0]:
            closed.append((*opened, False))
            opened = None
        for k, (first, last) in enumerate(zip(starts, lasts, strict=True)):
            start, held = (opened[0], opened[2]) if k == 0 and opened else (int(rows["us"][first]), 0)
            opened = None
            run = (start, int(rows["us"][last]), held + int(counts[k]))
            if rows["ended"][last] or k < len(starts) - 1:
                closed.append((*run, bool(rows["ended"][last])))
            else:
                opened = run
    if opened is not None and opened[1] + gap_us <= until:
        closed.append((*opened, False))
        opened = None
    return [run for run in closed if run[2] > 0], opened


class RunTracker(StatefulProcessor):
    """A series: its open run, the time up to which it is decided, and the readings behind that."""

    def __init__(self, keys: list[str], gap_us: int) -> None:
        self.keys, self.gap_us = keys, gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", _STATE)

    def _advance(self, key, timers, come: np.ndarray):
        import pandas as pd

        opened, until, waiting = None, None, np.empty(0, _ROW)
        if self.state.exists():
            start, last, readings, until, held = self.state.get()
            opened = None if start is None else (start, last, readings)
            waiting = np.frombuffer(held, _ROW)
        late = come[come["us"] < until] if until is not None else come[:0]
        rows = np.concatenate([waiting, come[come["us"] >= until] if until is not None else come])
        rows = rows[np.lexsort((rows["id"], rows["us"]))]
        now = timers.getCurrentWatermarkInMs() * 1000
        until = now if until is None else max(until, now)
        ready = int(np.searchsorted(rows["us"], until, side="left"))
        closed, opened = close_runs(opened, rows[:ready], until, self.gap_us)
        rest = rows[ready:]
        self.state.update((*(opened or (None, None, None)), until, rest.tobytes()))
        due = [int(rest["us"][0]) + 1] if len(rest) else []
        due += [opened[1] + self.gap_us] if opened else []
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        out = [(*key, "run", *run) for run in closed]
        out += [(*key, "late", int(r["us"]), int(r["us"]), 1, bool(r["ended"])) for r in late]
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "kind", "start_us", "last_us", "readings", "by_marker"])

    def handleInputRows(self, key, rows, timerValues):
        parts = []
        for frame in rows:
            part = np.empty(len(frame), _ROW)
            # By place: rows come as named tuples, which rename some columns.
            for at, name in enumerate(_ROW.names, len(frame.columns) - len(_ROW.names)):
                part[name] = frame.iloc[:, at].to_numpy()
            parts.append(part)
        yield from self._advance(key, timerValues, np.concatenate(parts) if parts else np.empty(0, _ROW))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, timerValues, np.empty(0, _ROW))

    def close(self) -> None:
        pass


def track_runs(readings: DataFrame, keys: list[str], ident: str, ended: str, gap_us: int, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """A stream's runs as they end (``kind`` run), and every row that came too late for them (``kind`` late).

    A run ends at its marker, or by a timer once the watermark is ``gap_us`` past its last reading. A row is late when its
    series was already decided up to a later time; it is put out with its time and changes no run. The event time goes on as a plain
    number, so that Spark leaves late rows to this operator and doesn't drop them. Per series and micro-batch one task sorts the
    readings as arrays of 17 bytes each; bound what a trigger reads. Needs the RocksDB state store (``runs_table`` sets it).
    """
    timed = readings.where(F.col(ts).isNotNull()).withWatermark(ts, lateness)
    plain = timed.select(*keys, F.unix_micros(ts).alias("_us"), F.col(ident).cast("long").alias("_id"), F.coalesce(ended, F.lit(False)).alias("_ended"))
    named = ", ".join(f"`{k}` {plain.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{named}, kind string, start_us long, last_us long, readings long, by_marker boolean"
    return plain.groupBy(*keys).transformWithStateInPandas(RunTracker(keys, gap_us), schema, outputMode="append", timeMode="eventTime")


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def runs_table(spark: SparkSession, stream: DataFrame, label: str, end: End | None = None) -> DataFrame:
    """The finished table of ``track_runs``; without an end, runs that nothing has ended yet are not in it."""
    with rocks_state(spark):
        return append_table(spark, stream, label, end)
