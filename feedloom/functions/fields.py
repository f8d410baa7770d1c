"""Picking the text or image field out of differently named schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.text import as_text
from feedloom.schemas import IMAGE_FIELDS, TEXT_FIELDS


def _holds_image(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return {"bytes", "data"} & set(dtype.fieldNames()) != set()
    return isinstance(dtype, (T.BinaryType, T.ArrayType))


def first_field(df: DataFrame, names: list[str], fits=None) -> str | None:
    """The first of ``names`` the schema has (and whose type fits)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return next((n for n in names if n in types and (fits is None or fits(types[n]))), None)


def text_column(df: DataFrame, names: list[str] = TEXT_FIELDS) -> Column:
    name = first_field(df, names)
    if name is None:
        raise ValueError(f"no text field among {names} in {df.columns}")
    return as_text(name, df.schema[name].dataType)


def image_column(df: DataFrame, names: list[str] = IMAGE_FIELDS) -> str:
    """Caption strings under an image name are passed over."""
    name = first_field(df, names, _holds_image)
    if name is None:
        raise ValueError(f"no image field among {names} in {df.columns}")
    return name


def first_present(*columns: Column | str) -> Column:
    """First value that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def image_bytes(df: DataFrame, field: str, into: str = "image_bytes", files: DataFrame | None = None) -> DataFrame:
    """One BINARY column from a BINARY field or a struct of bytes and path.

    Rows that hold only a path take their bytes from ``files`` (``path``,
    ``content``), an ordinary ``binaryFile`` DataFrame, by an equi-join.
    """
    dtype = df.schema[field].dataType
    if isinstance(dtype, T.BinaryType):
        return df.withColumn(into, F.col(field))
    inline = F.col(f"{field}.bytes")
    inline = F.when(F.octet_length(inline) > 0, inline)
    if files is None:
        return df.withColumn(into, inline)
    looked_up = files.select(F.col("path").alias("_path"), F.col("content").alias("_content"))
    wanted = F.when(inline.isNull(), F.col(f"{field}.path"))
    return (
        df.withColumn("_wanted", wanted)
        .join(looked_up, F.col("_wanted") == F.col("_path"), "left")
        .withColumn(into, F.coalesce(inline, F.col("_content")))
        .drop("_wanted", "_path", "_content")
    )
