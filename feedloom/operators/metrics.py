"""Feed rates, stalls, stage shares, gauge summaries and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.labels import band
from feedloom.operators.numbering import HOT_BUCKET_ROWS, bucketed_window, time_bucket
from feedloom.schemas import CAPTURE_PHASES


def as_count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """round(100 * part / whole), 0 when the whole is not positive."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def finite(value: Column) -> Column:
    """A gauge reading, with NaN (end marker, failed poll) as NULL."""
    return F.when(~F.isnan(value), value)


def time_order(micros: Column, ident: Column) -> Column:
    """Time, then id, as one number: aggregates that pick by it hash their keys, those that pick by a struct sort all rows."""
    return micros.cast("decimal(18,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") + ident.cast("decimal(20,0)")


def batch_timeline(batches: DataFrame, keys: list[str], hot_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """Number, running samples and wait of every batch of a run.

    In: keys, ``event_id``, ``got_us``, ``done_us``, ``start_us`` (loop start),
    ``n``.  The wait is counted from the end of the previous batch, the first
    one from the loop start.  A run is spread over its minutes, and a minute that
    holds too many batches over its milliseconds.
    """
    seen = bucketed_window(
        batches, keys, time_bucket("got_us"), ["got_us", "event_id"],
        number="i", running={"samples": "n"}, previous={"_prev_done": "done_us"},
        fine=F.expr("got_us div 1000"), hot_rows=hot_rows, latest=time_order(F.col("got_us"), F.col("event_id")),
    )
    wait = F.col("got_us") - F.coalesce("_prev_done", "start_us")
    return seen.withColumn("wait_us", wait).drop("_prev_done")


def epoch_metrics(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Batches, samples, elapsed time and feed rate per epoch."""
    elapsed = F.col("_elapsed_us") / 1e6
    rate = F.when(F.col("_elapsed_us") > 0, F.round(F.col("total_samples") / elapsed, 2)).otherwise(F.lit(0.0))
    return (
        batches.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.sum("n").alias("total_samples"),
            (F.max("done_us") - F.min("start_us")).alias("_elapsed_us"),
        )
        .select(*keys, "batches", "total_samples", F.round(elapsed, 3).alias("elapsed_sec"), rate.alias("samples_per_sec"))
    )


def _total_wait() -> Column:
    """Sum of all waits of a run without ordering it.

    Each batch's end is the next one's wait start, so the waits telescope:
    sum(got - done) + (end of the last batch) - (loop start).
    """
    last_done = F.max_by("done_us", time_order(F.col("got_us"), F.col("event_id")))
    return F.sum(F.col("got_us") - F.col("done_us")) + last_done - F.min("start_us")


def data_stall(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the epoch spent waiting for data; a plain aggregate, so a busy run is combined map-side."""
    return (
        batches.groupBy(*keys)
        .agg(_total_wait().alias("wait_us"), (F.max("done_us") - F.min("start_us")).alias("elapsed_us"))
        .withColumn("compute_us", F.col("elapsed_us") - F.col("wait_us"))
        .withColumn("data_stall_pct", percent(F.col("wait_us"), F.col("elapsed_us")))
    )


def stage_shares(times: DataFrame, keys: list[str], stage: str, micros: str, stages: list[str]) -> DataFrame:
    """Each stage's share of the summed time, one column per stage."""
    sums = [F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(micros))), F.lit(0).cast("long")).alias(f"_{s}") for s in stages]
    whole = times.groupBy(*keys).agg(F.sum(micros).alias("_all"), *sums)
    return whole.select(*keys, *[percent(F.col(f"_{s}"), F.col("_all")).alias(f"{s}_pct") for s in stages])


def gauge_summary(readings: DataFrame, keys: list[str], util: Column, memory: Column, cpu: Column, ram: Column, shm: Column) -> DataFrame:
    """Mean, minimum and peak per run; absent readings are left out, 0 when none is left."""
    util, memory, cpu, ram, shm = (finite(c) for c in (util, memory, cpu, ram, shm))

    def of(expr: Column, digits: int, name: str) -> Column:
        return F.coalesce(F.round(expr, digits), F.lit(0.0)).alias(name)

    return readings.groupBy(*keys).agg(
        of(F.avg(util), 2, "gpu_util_pct"),
        of(F.min(util), 2, "gpu_util_min"),
        of(F.max(memory), 3, "gpu_mem_gb"),
        of(F.avg(cpu), 2, "cpu_util_pct"),
        of(F.max(ram), 3, "ram_used_gb"),
        of(F.avg(shm), 3, "shm_used_gb"),
        of(F.max(shm), 3, "shm_peak_gb"),
    )


def epoch_average(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean over epochs."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("epochs"), *[F.avg(m).alias(m) for m in metrics])


def stamp_results(results: DataFrame, experiments: DataFrame, keys: list[str]) -> DataFrame:
    """Result records with the settings of their experiment and the time of stamping."""
    return results.join(experiments, keys, "left").withColumn("timestamp", F.current_timestamp())


def comparison_pivot(averages: DataFrame, metrics: list[str], column: Column, values: list[str]) -> DataFrame:
    """Metric rows x (loader, batch size) columns; the column list is given, not scanned for."""
    long = averages.select(column.alias("_column"), *metrics).unpivot("_column", metrics, "metric", "value")
    return long.groupBy("metric").pivot("_column", values).agg(F.max("value"))


def panel_stats(readings: DataFrame, keys: list[str], value: Column, digits: int = 4) -> DataFrame:
    value = finite(value)
    return readings.groupBy(*keys).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.round(F.avg(value), digits).alias("mean_value")
    )


def threshold_bands(readings: DataFrame, keys: list[str], value: Column, steps: list[float]) -> DataFrame:
    """Readings per threshold band."""
    return readings.groupBy(*keys, band(value, steps).alias("band")).agg(F.count(F.lit(1)).alias("readings"))


def baseline_ratio(averages: DataFrame, keys: list[str], name: Column, baseline: str, metric: str) -> DataFrame:
    """Each run's metric over the baseline run's in the same cell.

    A cell has one row per loader, so the window over it stays small.
    """
    cell = Window.partitionBy(*keys)
    base = F.max(F.when(name == baseline, F.col(metric))).over(cell)
    return averages.withColumn("ratio", F.col(metric) / F.when(base != 0, base))


def nonnull_series(readings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Readings of the series that have a value somewhere.

    The live series are found by a combined aggregate before the join, so no
    series is gathered whole.
    """
    live = readings.groupBy(*keys).agg(F.count(value).alias("_live")).where("_live > 0").select(*keys)
    return readings.join(live, keys, "left_semi")


def append_series(points: DataFrame, extra: Column, keys: list[str], size: str, sizes: list[int], value: str) -> DataFrame:
    """Chart points where an extra series exists at some batch sizes only.

    Rows that satisfy ``extra`` get a point at every size, NULL where they have
    no value; the other rows stay as they are.
    """
    every = F.array(*[F.lit(s).cast("long") for s in sizes])
    cells = points.withColumn("_cell", F.explode(F.when(extra, every).otherwise(F.array(F.col(size)))))
    shown = cells.withColumn("_shown", F.when(F.col("_cell") == F.col(size), F.col(value)))
    return shown.groupBy(*keys, F.col("_cell").alias(size)).agg(F.max("_shown").alias(value))


def running_rate(timeline: DataFrame) -> DataFrame:
    """Samples so far over the time since the loop start, after every batch."""
    elapsed = F.col("done_us") - F.col("start_us")
    rate = F.when(elapsed > 0, F.round(F.col("samples") / (elapsed / 1e6), 4)).otherwise(F.lit(0.0))
    return timeline.withColumn("running_sps", rate)


def capture_phase(i: Column, phases: dict[str, int] = CAPTURE_PHASES) -> Column:
    """Phase of a batch number in the once-through capture schedule."""
    out, start = None, 0
    for name, length in phases.items():
        hit = (i >= start) & (i < start + length)
        out = F.when(hit, name) if out is None else out.when(hit, name)
        start += length
    return out.otherwise(F.lit("done"))


def first_batch_latency(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Wait for the first batch against the mean wait of the rest, again without ordering the run."""
    whole = batches.groupBy(*keys).agg(
        _total_wait().alias("_wait"), (F.min("got_us") - F.min("start_us")).alias("first_wait_us"), F.count(F.lit(1)).alias("_n")
    )
    later = F.when(F.col("_n") > 1, F.round((F.col("_wait") - F.col("first_wait_us")) / (F.col("_n") - 1), 2))
    return whole.select(*keys, "first_wait_us", later.alias("later_wait_us"))


def run_spans(readings: DataFrame, keys: list[str], micros: str, gap_us: int) -> DataFrame:
    """Stretches of readings with no silence of ``gap_us`` or more between them.

    Readings in one cell of ``gap_us`` are never a gap apart, so they are first
    combined per cell (map-side, whatever a series' share of the rows).  A series
    then has at most (time span / gap) cells, and only those are ordered.
    """
    cells = readings.groupBy(*keys, F.floor(F.col(micros) / F.lit(gap_us)).cast("long").alias("_cell")).agg(
        F.min(micros).alias("_from"), F.max(micros).alias("_to"), F.count(F.lit(1)).alias("_n")
    )
    series = Window.partitionBy(*keys).orderBy("_cell")
    opens = F.coalesce((F.col("_from") - F.lag("_to").over(series) >= gap_us).cast("long"), F.lit(0).cast("long"))
    spans = cells.withColumn("_opens", opens)
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("_span", F.sum("_opens").over(upto))
    return spans.groupBy(*keys, "_span").agg(
        F.min("_from").alias("start_us"), F.max("_to").alias("last_us"), F.sum("_n").alias("readings")
    ).drop("_span")


def visible_values(readings: DataFrame, keys: list[str], micros: str, value: str, ident: str, step_us: int, stale_us: int) -> DataFrame:
    """What a panel shows at each refresh: every series' latest reading that is not older than ``stale_us``.

    Refreshes lie on the grid of ``step_us``; those without a reading of their own show an earlier one with its age, and
    those beyond its staleness show nothing (no row). Readings between two refreshes are first combined
    (map-side, whatever a series' share of the rows), so a series has at most one row per refresh before it is
    ordered, and it is ordered in stretches of refreshes. Equal times go by id; a null time is never visible, null series are a series.
    """
    timed = readings.where(F.col(micros).isNotNull()).withColumn("_cell", F.ceil(F.col(micros) / F.lit(step_us)).cast("long"))
    newest = timed.groupBy(*keys, "_cell").agg(F.max(micros).alias("_at"), F.max_by(value, time_order(F.col(micros), F.col(ident))).alias("_value"))
    # Backwards, the refresh that takes over is the row before.
    back = newest.withColumn("_back", -F.col("_cell"))
    taken = bucketed_window(back, keys, F.shiftright("_back", 12), ["_back"], previous={"_next": "_back"})
    last = F.floor((F.col("_at") + F.lit(stale_us)) / F.lit(step_us)).cast("long")
    last = F.least(last, F.coalesce(-F.col("_next") - 1, last))
    shown = taken.withColumn("_last", last).where("_last >= _cell").withColumn("_refresh", F.explode(F.sequence("_cell", "_last")))
    refresh = F.col("_refresh") * F.lit(step_us)
    return shown.select(*keys, refresh.alias("refresh_us"), F.col("_value").alias("visible_value"), (refresh - F.col("_at")).alias("age_us"))
