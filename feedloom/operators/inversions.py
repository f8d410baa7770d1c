"""Pairs that an order turns round, and how far each batch's mix is from the corpus.

An inversion is a pair of samples of which the one with the smaller id comes later.  Ids and positions are both cut into
ranges of ``2**bits``, and every pair is counted in exactly one of three places: both ids in one range
(merge-counted inside it), both positions but not both ids in one range (merge-counted inside that), or neither, for which the
numbers of rows per (id range, position range) are enough.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.numbering import bucketed_window
from feedloom.session import settle, spread

# A range of ids or positions is one group in memory: a quarter million rows of two numbers.
RANGE_BITS = 18
# Smaller ranges share a group of so many ids or positions.
GROUP_BITS = 16
# Position ranges are told apart by this many bits at a time; a row holds a number for each value of them.
DIGIT_BITS = 3

_EXACT = "decimal(38,0)"


def count_turned(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j]: sorted runs of doubling length, each merged with its neighbour by one search over all."""
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, width, turned = len(ranks), 1, 0
    places = np.arange(n)
    while width < n:
        pair = places // (2 * width)
        right = places // width % 2 == 1
        # Runs of one pair keep together and in order when the pair's number leads the key.
        keys = pair * n + ranks
        lefts = keys[~right]
        ends = np.searchsorted(pair[~right], pair[right], side="right")
        turned += int((ends - np.searchsorted(lefts, keys[right], side="right")).sum())
        ranks = np.sort(keys) - pair * n
        width *= 2
    return turned


def _inside(rows: DataFrame, keys: list[str], part: str, order: list[str], value: str, bits: int) -> DataFrame:
    """(keys, turned) per group of neighbouring ranges: pairs of one range that ``order`` puts the other way round than ``value``.

    Ranges of few rows are counted together, up to ``2**GROUP_BITS`` ids or positions: with the range
    leading every value, no pair of two ranges counts as turned.
    """
    import pandas as pd

    given = rows.select(*keys, part, *dict.fromkeys([*order, value]), F.shiftright(part, max(0, GROUP_BITS - bits)).alias("_group"))
    width = len(keys)

    def count(key, frame):
        ordered = frame.sort_values(order)
        ranks = np.unique(ordered[value].to_numpy(), return_inverse=True)[1].astype(np.int64)
        ranges = np.unique(ordered[part].to_numpy(), return_inverse=True)[1].astype(np.int64)
        turned = count_turned(ranges * (len(ranks) + 1) + ranks)
        return pd.DataFrame([[*key[:width], turned]], columns=[*keys, "turned"])

    schema = ", ".join([*(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys), "turned long"])
    return given.groupBy(*keys, "_group").applyInPandas(count, schema)


def _between(cells: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, turned) per stretch of position ranges: pairs of cells whose position ranges first differ in one digit.

    Every cell stands once at each of ``levels`` digits, so rows grow as the cells do and never with the product of id and position
    ranges. A row holds the numbers of one id range's rows by digit; how many of earlier id ranges have a greater digit is a
    running sum along the id ranges, in stretches, so no task depends on how many ranges there are.
    """
    size, level = 1 << DIGIT_BITS, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    # Spread before the rows grow, as the planner sees the few cells only.
    each = spread(cells, *keys, "_i").select("*", level)
    each = each.select(
        *keys, "_level", "_i", "_n", F.expr(f"shiftright(_p, (_level + 1) * {DIGIT_BITS})").alias("_group"),
        F.expr(f"shiftright(_p, _level * {DIGIT_BITS}) & {size - 1}L").alias("_d"),
    )
    group = [*keys, "_level", "_group"]
    counts = [F.sum(F.when(F.col("_d") == d, F.col("_n")).otherwise(F.lit(0).cast("long"))).alias(f"_n{d}") for d in range(size)]
    # Written, as the sums along the id ranges read the counts twice.
    own = settle(each.groupBy(*group, "_i").agg(*counts), "digits")
    above = own.withColumns({f"_a{d}": sum((F.col(f"_n{e}") for e in range(d + 2, size)), F.col(f"_n{d + 1}")) for d in range(size - 1)})
    met = bucketed_window(above, group, F.shiftright("_i", 12), ["_i"], running={f"_u{d}": f"_a{d}" for d in range(size - 1)})
    none = F.lit(0).cast(_EXACT)
    pairs = [F.col(f"_n{d}").cast("decimal(19,0)") * (F.col(f"_u{d}") - F.col(f"_a{d}")).cast("decimal(19,0)") for d in range(size - 1)]
    held = [F.when(F.col(f"_n{d}") > 0, p.cast(_EXACT)).otherwise(none) for d, p in enumerate(pairs)]
    return met.groupBy(*keys).agg(*[F.sum(h).cast(_EXACT).alias(f"_t{d}") for d, h in enumerate(held)]).select(
        *keys, sum((F.col(f"_t{d}") for d in range(1, size - 1)), F.col("_t0")).alias("turned")
    )


def order_inversions(orders: DataFrame, keys: list[str], ident: str = "id", pos: str = "pos", bits: int = RANGE_BITS) -> DataFrame:
    """Per key: samples, inversions and their share of all pairs (0 in source order, about 0.5 at random, 1 backwards).

    ``orders`` holds every id and position of a key once, none negative; pairs with an
    equal id or position are not inverted. Rows with a null id or position are not counted; a null key is a key. One sample has a
    share of null, an empty table gives no rows. Sums are exact (38 digits). ``orders`` is read once per part: hand in a settled table. The
    largest position is asked for first, as it says how many digits tell position ranges apart.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = orders.where(F.col(ident).isNotNull() & F.col(pos).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(ident).cast("long").alias("_id"), F.col(pos).cast("long").alias("_pos")
    )
    rows = rows.withColumns({"_i": F.shiftright("_id", bits), "_p": F.shiftright("_pos", bits)})
    cells = rows.groupBy(*named, "_i", "_p").agg(F.count(F.lit(1)).alias("_n"))
    parts = [_inside(rows, named, "_i", ["_id", "_pos"], "_pos", bits), _inside(rows, named, "_p", ["_pos", "_id"], "_i", bits)]
    largest = rows.agg(F.max("_pos")).first()[0] or 0
    top = max(0, largest.bit_length() - bits)
    if top:
        parts.append(_between(cells, named, -(-top // DIGIT_BITS)))
    turned = None
    for part in parts:
        part = part.select(*named, F.col("turned").cast(_EXACT).alias("_turned"), F.lit(0).cast("long").alias("_rows"))
        turned = part if turned is None else turned.unionByName(part)
    counted = cells.select(*named, F.lit(0).cast(_EXACT).alias("_turned"), F.col("_n").alias("_rows"))
    sums = turned.unionByName(counted).groupBy(*named).agg(F.sum("_rows").alias("n"), F.sum("_turned").cast(_EXACT).alias("inversions"))
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    share = F.when(F.col("n") > 1, F.round(F.col("inversions").cast("double") / pairs, 6))
    return sums.select(*[F.col(n).alias(k) for k, n in zip(keys, named, strict=True)], "n", "inversions", share.alias("turned_share"))


def batch_mix(rows: DataFrame, batch: str, label: str) -> DataFrame:
    """Per batch: rows, and the distance (total variation, 0 to 1) of its labels' mix from that of all rows.

    A null label is a label, a null batch a batch. Counts per (batch, label) are combined before they move; rows themselves don't.
    A label that a batch lacks counts too: what a batch shares with the corpus is the sum of the smaller shares.
    """
    cells = rows.groupBy(F.col(batch).alias("_b"), F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    whole = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    corpus = rows.groupBy(F.col(label).alias("_m")).agg(F.count(F.lit(1)).alias("_of")).withColumn("_all", whole)
    sizes = rows.groupBy(F.col(batch).alias("_c")).agg(F.count(F.lit(1)).alias("n_rows"))
    seen = cells.join(corpus, F.col("_l").eqNullSafe(F.col("_m"))).join(sizes, F.col("_b").eqNullSafe(F.col("_c")))
    shared = F.least(F.col("_n") / F.col("n_rows"), F.col("_of") / F.col("_all"))
    return seen.groupBy("_b").agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_labels"), F.round(F.abs(1 - F.sum(shared)), 6).alias("mix_distance")
    ).withColumnRenamed("_b", batch)
