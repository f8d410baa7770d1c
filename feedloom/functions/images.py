"""Image columns: decode, resize, permute, normalise, encode.

Spark does the partitioning and hands Arrow batches to these helpers; each works
on one image at a time with NumPy.  PNG needs nothing else; other codecs are used
when Pillow can be imported, and fail per row, not per job, when it cannot.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.schemas import IMAGE_SIDE, TENSOR
from feedloom.session import ship_package

try:
    from PIL import Image as _pillow
except ImportError:
    _pillow = None

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PIECE_BYTES = 32 << 20


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Undo PNG row filters; ``step`` is the bytes per pixel."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            # These two depend on the pixel to the left; plain ints beat NumPy scalars here.
            up, done = [0] * step + above.tolist(), [0] * step
            for x, byte in enumerate(line.tolist()):
                left, high, corner = done[x], up[x + step], up[x]
                if kind == 3:
                    guess = (left + high) >> 1
                else:
                    by_left, by_high, by_corner = abs(high - corner), abs(left - corner), abs(left + high - 2 * corner)
                    guess = left if by_left <= by_high and by_left <= by_corner else high if by_high <= by_corner else corner
                done.append((byte + guess) & 255)
            out[y] = done[step:]
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        above = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """8-bit, non-interlaced PNG to RGB [H, W, 3]; gray and palette are expanded."""
    at, body, palette, head = len(PNG_SIGNATURE), b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("PNG without header")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlacing")
    step = _CHANNELS[colour]
    pixels = _unfilter(np.frombuffer(zlib.decompress(body), dtype=np.uint8), height, width * step, step)
    pixels = pixels.reshape(height, width, step)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    if colour in (0, 4):
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return pixels[:, :, :3]


def encode_png(pixels: np.ndarray) -> bytes:
    """Lossless PNG from gray [H, W] or RGB [H, W, 3]."""
    height, width = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.zeros((height, width * (3 if colour else 1) + 1), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_rgb(data: bytes) -> np.ndarray:
    if data[: len(PNG_SIGNATURE)] == PNG_SIGNATURE:
        return decode_png(data)
    if _pillow is None:
        raise ValueError("no codec for this image format")
    import io

    return np.asarray(_pillow.open(io.BytesIO(data)).convert("RGB"), dtype=np.uint8)


def encode_image(pixels: np.ndarray, codec: str = "png", quality: int = 95) -> bytes:
    if codec == "png":
        return encode_png(pixels)
    if _pillow is None:
        raise ValueError(f"no encoder for {codec}")
    import io

    out = io.BytesIO()
    _pillow.fromarray(pixels).save(out, format=codec.upper(), quality=quality)
    return out.getvalue()


@lru_cache(maxsize=64)
def resize_weights(source: int, target: int) -> np.ndarray:
    """[target, source] bilinear weights in units of 2**-22.

    Triangle filter on half-pixel centres, widened by the scale when shrinking.
    """
    scale = source / target
    reach = max(scale, 1.0)
    weights = np.zeros((target, source))
    for out in range(target):
        centre = (out + 0.5) * scale
        low = max(int(centre - reach + 0.5), 0)
        high = min(int(centre + reach + 0.5), source)
        spots = np.arange(low, high)
        near = np.maximum(0.0, 1.0 - np.abs((spots - centre + 0.5) / reach))
        weights[out, low:high] = near / near.sum()
    return np.floor(weights * (1 << 22) + 0.5)


def resize_planes(pixels: np.ndarray, height: int = IMAGE_SIDE, width: int = IMAGE_SIDE) -> np.ndarray:
    """Bilinear resize of RGB [H, W, 3] to channels-first [3, height, width].

    Two passes, across then down, each rounded to 8 bits.  All products stay
    below 2**53, so the float64 matrix products are exact.
    """

    def settle(planes):
        planes += 1 << 21
        planes *= 1 / (1 << 22)
        np.floor(planes, out=planes)
        return np.clip(planes, 0, 255, out=planes)

    planes = np.ascontiguousarray(pixels.transpose(2, 0, 1)).astype(np.float64)
    if planes.shape[2] != width:
        planes = settle(planes @ resize_weights(planes.shape[2], width).T)
    if planes.shape[1] != height:
        planes = settle(resize_weights(planes.shape[1], height) @ planes)
    return planes.astype(np.uint8)


def _tensor(array: np.ndarray) -> dict:
    return {"shape": list(array.shape), "dtype": str(array.dtype), "data": np.ascontiguousarray(array).tobytes()}


def _array(tensor: dict) -> np.ndarray:
    return np.frombuffer(tensor["data"], dtype=tensor["dtype"]).reshape([int(n) for n in tensor["shape"]])


def _map_images(df: DataFrame, field: str, into: str, work, result: T.DataType, partitions: int | None = None) -> DataFrame:
    """Add ``into`` and ``<into>_error`` by running ``work`` on each image of ``field``.

    Pictures grow on decoding, so results leave in pieces of bounded bytes however
    many rows an input batch has.  A bad image spoils its own row only.
    ``partitions`` spreads the still encoded images over that many tasks.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField(into, result), T.StructField(f"{into}_error", T.StringType())]
    )
    place = df.columns.index(field)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def piece(batch, start, values, errors):
            added = [pa.array(values, type=arrow.field(into).type), pa.array(errors, type=pa.string())]
            kept = batch.slice(start, len(values)).columns
            return pa.RecordBatch.from_arrays([*kept, *added], schema=arrow)

        for batch in batches:
            start, values, errors, size = 0, [], [], 0
            for item in batch.column(place):
                value, error = None, None
                try:
                    value = work(item.as_py()) if item.is_valid else None
                    error = None if item.is_valid else "missing"
                except Exception as problem:  # any codec error belongs to the row
                    error = f"{type(problem).__name__}: {problem}"
                values.append(value)
                errors.append(error)
                size += len(value["data"] if isinstance(value, dict) else value or b"")
                if size >= PIECE_BYTES:
                    yield piece(batch, start, values, errors)
                    start, values, errors, size = start + len(values), [], [], 0
            if values:
                yield piece(batch, start, values, errors)

    ship_package(df.sparkSession)
    spread = df.repartition(partitions) if partitions else df
    return spread.mapInArrow(run, schema)


def decode_images(df: DataFrame, field: str, into: str = "image", partitions: int | None = None) -> DataFrame:
    """Add ``into`` (RGB tensor) and ``<into>_error`` for encoded bytes."""
    return _map_images(df, field, into, lambda data: _tensor(decode_rgb(data)), TENSOR, partitions)


def decode_resize_images(df: DataFrame, field: str, into: str = "image", side: int = IMAGE_SIDE, partitions: int | None = None) -> DataFrame:
    """Decode, resize to side x side and move channels first, in one Python pass."""

    def work(data):
        return _tensor(resize_planes(decode_rgb(data), side, side))

    return _map_images(df, field, into, work, TENSOR, partitions)


def resize_images(df: DataFrame, field: str, into: str, side: int = IMAGE_SIDE) -> DataFrame:
    """Resize [H, W, 3] tensors and move channels first."""
    return _map_images(df, field, into, lambda t: _tensor(resize_planes(_array(t), side, side)), TENSOR)


def split_errors(df: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows whose image failed)."""
    bad = F.col(f"{field}_error").isNotNull()
    return df.where(~bad), df.where(bad)


def encode_images(df: DataFrame, field: str, into: str = "encoded", codec: str = "png", quality: int = 95) -> DataFrame:
    """Encode [H, W, 3] or [H, W] uint8 tensors."""
    return _map_images(df, field, into, lambda t: encode_image(_array(t), codec, quality), T.BinaryType())


def normalise_tensors(df: DataFrame, field: str, into: str) -> DataFrame:
    """uint8 tensors to float32 in 0..1."""
    return _map_images(df, field, into, lambda t: _tensor(_array(t).astype(np.float32) / np.float32(255)), TENSOR)


def from_image_source(df: DataFrame, field: str = "image", into: str = "tensor") -> DataFrame:
    """RGB tensors from Spark's ``image`` source, whose 3-channel pixels are BGR.

    Mode 16 is 3 x 8 bits, mode 0 one channel, mode 24 BGRA.
    """

    def work(image):
        flat = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], image["nChannels"])
        return _tensor(np.repeat(flat, 3, axis=2) if flat.shape[2] == 1 else flat[:, :, 2::-1])

    return _map_images(df, field, into, work, TENSOR)


def normalise_vector(vector: Column | str) -> Column:
    """x / 255 for every element of a numeric array, on the JVM."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(vector, lambda x: x.cast("double") / F.lit(255.0))


def vector_tensor(vector: Column | str, height: int, width: int) -> Column:
    """Gray tensor from an array of 0..255 numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    data = F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    return F.struct(
        F.array(F.lit(height), F.lit(width)).alias("shape"), F.lit("uint8").alias("dtype"), data.alias("data")
    )
