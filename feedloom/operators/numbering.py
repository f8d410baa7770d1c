"""Dense numbering, running sums and lags that never sort a whole key in one task.

A plain ``row_number() over (order by x)`` moves every row to one task, and
``over (partition by run order by x)`` moves a hot run to one task.  Here each
key is cut into *buckets* by an expression that grows with the order key.  The
window runs inside (key, bucket); a small table with one row per (key, bucket)
carries the counts, sums and last values over the bucket edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One summary row stands for this many consecutive ids.
ID_BUCKET_BITS = 18
# A bucket of md5 keys holds about this many rows, so their number grows with the rows.
HASH_BUCKET_ROWS = 1 << 18
# A bucket beyond this many rows is cut further where a finer order is given.
HOT_BUCKET_ROWS = 5_000_000


def id_bucket(ident: Column | str, bits: int = ID_BUCKET_BITS) -> Column:
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.shiftright(ident.cast("long"), bits)


def hash_bucket(df: DataFrame, key: Column | str, rows: int = HASH_BUCKET_ROWS) -> Column:
    """Buckets in the order of an md5 key, about ``rows`` rows of ``df`` in each.

    The rows are counted by a scalar subquery inside the job itself; md5 keys are even, so
    equal stretches of the key's first 32 bits make even buckets.
    """
    key = F.col(key) if isinstance(key, str) else key
    buckets = F.ceil(df.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(rows)).cast("long")
    first = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(first * buckets, 32)


def time_bucket(micros: Column | str, seconds: int = 60) -> Column:
    micros = F.col(micros) if isinstance(micros, str) else micros
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("long")


def _zero_if_none(total: Column) -> Column:
    return F.coalesce(total, F.lit(0).cast("long"))


def _edges(parted: DataFrame, facts: list[Column], keys: list[str], sums: list[str], lasts: list[str]) -> DataFrame:
    """Per bucket: totals of all earlier buckets of its key, and the last row before it.

    The window sees one row per bucket, never the rows themselves.
    """
    summary = parted.groupBy("_part").agg(*facts)
    by_key = [F.col(f"_part.{k}").alias(f"_k{i}") for i, k in enumerate(keys)]
    # The key parts become plain columns once, so all windows below share one exchange.
    place = [F.col("_part._bucket").alias("_bucket"), F.col("_part._fine").alias("_fine")] if keys else [F.col("_part").alias("_bucket")]
    flat = summary.select("*", *by_key, *place)
    ordered = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(*(["_bucket", "_fine"] if keys else ["_bucket"]))
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return flat.select(
        "_part",
        *[_zero_if_none(F.sum(n).over(earlier)).alias(f"_before_{n}") for n in sums],
        *[F.lag(n).over(ordered).alias(f"_edge_{n}") for n in lasts],
    )


def bucketed_window(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    number: str | None = None,
    running: dict[str, str] | None = None,
    previous: dict[str, str] | None = None,
    fine: Column | None = None,
    hot_rows: int = HOT_BUCKET_ROWS,
    latest: Column | None = None,
) -> DataFrame:
    """Window columns over ``keys`` ordered by ``order``, computed bucket by bucket.

    ``number``   0-based dense number of the row within its key
    ``running``  {new column: LONG column}: running sum up to and including the row
    ``previous`` {new column: column}: the column's value one row earlier, else NULL
    ``bucket`` must never decrease along ``order`` within a key, and should hold
    thousands of rows: one summary row per (key, bucket) is sorted per key.
    ``fine`` orders rows inside a bucket; buckets of more than ``hot_rows`` rows are
    cut by it.  At most (rows / hot_rows) buckets are hot, so their list is broadcast.
    ``latest`` is one number that orders rows as ``order`` does, for picking a bucket's last row.
    """
    running, previous = running or {}, previous or {}
    if fine is not None and not keys:
        raise ValueError("a finer cut needs a key")
    # Neither a struct nor the filled bucket is ever NULL, so no row is lost in the join.
    if keys:
        whole = F.struct(*keys, bucket.alias("_bucket"), F.lit(0).cast("long").alias("_fine"))
        parted = df.withColumn("_part", whole)
        if fine is not None:
            hot = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
            marked = parted.join(F.broadcast(hot.select("_part", F.lit(True).alias("_hot"))), "_part", "left")
            cut = F.when(F.col("_hot"), fine.cast("long")).otherwise(F.lit(0).cast("long"))
            parted = marked.select(*df.columns, F.struct(*keys, bucket.alias("_bucket"), cut.alias("_fine")).alias("_part"))
    else:
        parted = df.withColumn("_part", F.coalesce(bucket, F.lit(-1)))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    sums: list[str] = []
    facts: list[Column] = []
    if number:
        sums.append("_n")
        facts.append(F.count(F.lit(1)).alias("_n"))
    for new, source in running.items():
        sums.append(f"_s_{new}")
        facts.append(_zero_if_none(F.sum(source)).alias(f"_s_{new}"))
    lasts = [f"_l_{new}" for new in previous]
    # A number keeps this a hash aggregate; a struct of several columns needs a sort.
    if latest is None:
        latest = F.struct(*order) if len(order) > 1 else F.col(order[0])
    facts += [F.max_by(source, latest).alias(f"_l_{new}") for new, source in previous.items()]
    edges = _edges(parted, facts, keys, sums, lasts)

    local: dict[str, Column] = {}
    if number:
        local["_i"] = F.row_number().over(inside).cast("long") - 1
    for new, source in running.items():
        local[f"_r_{new}"] = _zero_if_none(F.sum(source).over(upto))
    for new, source in previous.items():
        local[f"_p_{new}"] = F.lag(source).over(inside)
    if previous:
        local["_first"] = F.row_number().over(inside) == 1

    joined = parted.withColumns(local).join(edges, "_part")
    final: dict[str, Column] = {}
    if number:
        final[number] = F.col("_i") + F.col("_before__n")
    for new in running:
        final[new] = F.col(f"_r_{new}") + F.col(f"_before__s_{new}")
    for new in previous:
        final[new] = F.when(F.col("_first"), F.col(f"_edge__l_{new}")).otherwise(F.col(f"_p_{new}"))
    return joined.select(*df.columns, *[col.alias(name) for name, col in final.items()])


def number_by_id(df: DataFrame, ident: str, into: str = "__id__") -> DataFrame:
    """Dense 0..N-1 numbers in the order of a unique integer column.

    One summary row stands for 2**18 consecutive ids (4 million rows for 10**12
    samples).  Hash-like ids spread over 64 bits belong in ``number_by_hash``.
    """
    return bucketed_window(df, [], id_bucket(ident), [ident], number=into)


def number_by_hash(df: DataFrame, hashed: str, ident: str | list[str], into: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """Dense numbers in the order of an md5 column, ties broken by ``ident``."""
    ident = [ident] if isinstance(ident, str) else ident
    return bucketed_window(df, keys or [], hash_bucket(df, hashed), [hashed, *ident], number=into)


def number_shard_rows(df: DataFrame, shard: str = "__shard__", place: str = "__place__", into: str = "__id__") -> DataFrame:
    """Dense numbers in (shard name, place in shard) order; only one row per shard is sorted."""
    sizes = df.groupBy(shard).agg((F.max(place) + 1).alias("_n"))
    earlier = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, _zero_if_none(F.sum("_n").over(earlier)).alias("_before"))
    return df.join(offsets, shard).withColumn(into, F.col("_before") + F.col(place)).drop("_before")


def number_source_rows(df: DataFrame, into: str = "__id__") -> DataFrame:
    """Dense 0..N-1 numbers in file order for a DataFrame read straight from files.

    Rows of one file block stay together and in order within a scan task, so the
    number is (rows in earlier blocks) + (offset inside the block).  Only one
    count per block is shuffled; the rows themselves never move.
    """
    placed = df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )
    blocks = placed.groupBy("_path", "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # Blocks number (input bytes / split size): under a million rows at 100 TB.
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_path", "_start", (_zero_if_none(F.sum("_n").over(earlier)) - F.col("_first")).alias("_shift")
    )
    return placed.join(offsets, ["_path", "_start"]).select(*df.columns, (F.col("_place") + F.col("_shift")).alias(into))
