"""A payload laid out once in buckets of its id, so that an epoch moves ids and no payload.

The write is the one exchange of payload. Every later join on the id scans the buckets where they are and brings
the other side's ids to them. The other side is hashed per bucket, so payload rows are not sorted either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAME = "feedloom_buckets_"


def write_buckets(df: DataFrame, path: str, ident: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under ``path``, a file per bucket of ``ident``, and open it.

    As many buckets as shuffle partitions unless told otherwise: an epoch's ids of one bucket must fit a task's memory (a million take
    about 100 MB). Ids should be unique: rows of one id share a bucket. Rows whose id is null are kept in the layout and no order meets them.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = NAME + uuid.uuid4().hex[:12]
    df.repartition(buckets, ident).write.format("parquet").bucketBy(buckets, ident).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return open_buckets(spark, path, ident, buckets, df.schema)


def open_buckets(spark: SparkSession, path: str, ident: str, buckets: int, schema: T.StructType) -> DataFrame:
    """A layout written before, also by another session; ``buckets`` as it was written with."""
    name = NAME + uuid.uuid4().hex[:12]
    columns = ", ".join(f"{_quoted(f.name)} {_ddl(f.dataType)}" for f in schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({_quoted(ident)}) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def fetch_bucketed(order: DataFrame, payload: DataFrame, ident: str) -> DataFrame:
    """Payload for an order of ids: the order's rows go to the payload's buckets, payload rows stay.

    Both sides must agree on column names but for the id; a name they share raises.
    """
    shared = sorted((set(order.columns) & set(payload.columns)) - {ident})
    if shared:
        raise ValueError(f"order and payload both have {', '.join(shared)}")
    return payload.join(order.hint("shuffle_hash"), ident)


def _ddl(kind: T.DataType) -> str:
    """A type in SQL, with the names inside it quoted."""
    if isinstance(kind, T.StructType):
        return f"struct<{', '.join(f'{_quoted(f.name)}: {_ddl(f.dataType)}' for f in kind)}>"
    if isinstance(kind, T.ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    return f"map<{_ddl(kind.keyType)}, {_ddl(kind.valueType)}>" if isinstance(kind, T.MapType) else kind.simpleString()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
