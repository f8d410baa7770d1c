"""Pairing modalities by key, and the experiment grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Samples that have both members."""
    return left.join(right, key)


def unpaired(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Samples with one member only, and which one is missing."""
    a, b = left.select(key), right.select(key)
    # The side looked up is made distinct, so a key with many copies costs one row.
    lone_left = a.join(b.distinct(), key, "left_anti").withColumn("missing", F.lit(right_name))
    lone_right = b.join(a.distinct(), key, "left_anti").withColumn("missing", F.lit(left_name))
    return lone_left.unionByName(lone_right)


def experiment_matrix(base: DataFrame, **choices: list) -> DataFrame:
    """Every combination of the choices for each row of ``base``.

    The choice lists are arguments of the job, so each row grows by a fixed
    factor in place; no join is involved.
    """
    for name, values in choices.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base


def sample_entries(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Samples taken apart into named entries, one per field present.

    ``fields`` maps an extension to a STRING or BINARY column.
    """
    parts = [
        F.struct(
            F.concat(F.col(key), F.lit("." + ext)).alias("entry"),
            F.octet_length(column).cast("long").alias("bytes"),
        )
        for ext, column in fields.items()
    ]
    opened = df.select(key, F.explode(F.array(*parts)).alias("_e"))
    return opened.select(key, "_e.entry", "_e.bytes").where("bytes IS NOT NULL")
