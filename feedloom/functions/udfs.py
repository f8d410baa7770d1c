"""User functions over samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from feedloom.session import ship_package
from feedloom.sources.shardfiles import SLICE_ROWS


def map_samples(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """Apply a dict -> dict function to every sample, in Arrow batches.

    ``partitions`` sets how many tasks share the work (the size of the pool is
    tasks that run at once, so it is bounded by the cluster's cores).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS).to_pylist()
                yield pa.RecordBatch.from_pylist([fn(row) for row in rows], schema=arrow)

    ship_package(df.sparkSession)
    spread = df.repartition(partitions) if partitions else df
    return spread.mapInArrow(run, schema)
