"""Text columns: keys, UTF-8, JSON metadata and the character tokeniser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.schemas import KEY_FORMAT, SEQUENCE_LENGTH, VOCABULARY


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_key(ident: Column | str) -> Column:
    """Zero-padded sample key; longer ids keep all their digits."""
    return F.format_string(KEY_FORMAT, _col(ident).cast("long"))


def to_utf8(text: Column | str) -> Column:
    return F.encode(_col(text), "UTF-8")


def as_text(column: Column | str, dtype: T.DataType) -> Column:
    """Text from a STRING or BINARY column; only binary values are decoded."""
    column = _col(column)
    return F.decode(column, "UTF-8") if isinstance(dtype, T.BinaryType) else column.cast("string")


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(_col(text)).cast("long")


def meta_text(column: Column | str, dtype: T.DataType) -> Column:
    """Metadata as JSON text; text passes through unchanged."""
    column = _col(column)
    if isinstance(dtype, T.StringType):
        return column
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(column)
    # A bare scalar has no to_json of its own: wrap it, then strip the wrapper.
    wrapped = F.to_json(F.array(column))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def char_tokens(text: Column | str) -> Column:
    """Code points of all characters, folded into the vocabulary.

    Splitting once keeps the cost linear; indexing by position would rescan the
    text for every character.
    """
    text = _col(text)
    letters = F.split(text, "")
    folded = F.transform(letters, lambda c: F.ascii(c) % F.lit(VOCABULARY))
    return F.when(F.length(text) > 0, folded).otherwise(F.array().cast("array<int>"))


def token_sequences(df: DataFrame, tokens: str, width: int = SEQUENCE_LENGTH) -> DataFrame:
    """A row for every ``width`` tokens, numbered by ``chunk``; the last is filled with zeros, an empty list gives one of zeros."""
    last = F.greatest(F.expr(f"(size({tokens}) - 1) div {int(width)}"), F.lit(0).cast("long")).cast("int")
    cut = lambda i: F.slice(F.concat(F.slice(tokens, i * width + 1, width), F.array_repeat(F.lit(0), width)), 1, width)
    names = [c for c in df.columns if c != tokens]
    return df.select(*names, F.posexplode(F.transform(F.sequence(F.lit(0), last), cut)).alias("chunk", tokens))


def token_count(text: Column | str) -> Column:
    """Tokens of a whole text, without building them."""
    return F.length(_col(text)).cast("long")


def sequence_count(text: Column | str, width: int = SEQUENCE_LENGTH) -> Column:
    """Sequences of ``width`` tokens that a text fills, one at least."""
    return F.greatest(F.ceil(F.length(_col(text)) / width), F.lit(1)).cast("long")
