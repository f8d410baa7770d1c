"""How random an order is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.numbering import bucketed_window, id_bucket


def shuffle_quality(orders: DataFrame, ident: str = "id") -> DataFrame:
    """Displacement, kept neighbours, fixed points and correlation per method.

    ``orders`` holds (method, id, pos) with dense ids.  Neighbours are kept where
    the next id also has the next position, a lag along the id.
    """
    seen = bucketed_window(orders, ["method"], id_bucket(ident), [ident], previous={"_prev": "pos"})
    moved = F.abs(F.col("pos") - F.col(ident))
    return seen.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(moved), 4).alias("avg_move"),
        F.max(moved).alias("max_move"),
        F.sum(F.when(F.col("pos") == F.col("_prev") + 1, 1).otherwise(0)).cast("long").alias("kept_neighbours"),
        F.sum(F.when(moved == 0, 1).otherwise(0)).cast("long").alias("fixed_points"),
        F.round(F.corr(ident, "pos"), 4).alias("order_corr"),
    )
