"""Words, word hashes and lookup tables over Arrow text columns, in NumPy.

Texts are worked on as the UTF-8 bytes of an Arrow buffer: a byte table says which
bytes separate words, and a polynomial over a random byte table, read off prefix
sums, gives every word a 64-bit hash without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import ship_package

PIECE_BYTES = 1 << 20
_BLOCK = 1 << 19

#: Kinds of bytes: what stands between ASCII white space; letters, digits and all beyond ASCII; both of these with signs as a third kind.
UNSPACED = np.ones(256, bool)
UNSPACED[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[128:] = True
for _a, _z in ("09", "AZ", "az"):
    LETTERS[ord(_a) : ord(_z) + 1] = True
WORDS_AND_SIGNS = np.where(LETTERS, 1, np.where(UNSPACED, 2, 0)).astype(np.uint8)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_BYTES = bytes(_LOWER)

_rng = np.random.default_rng(20_240_607)
_VALUES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER_VALUES = _VALUES[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIZE = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, np.uint64)
        have[0] = 1
        _POWERS[base] = np.multiply.accumulate(have)
    return _POWERS[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts. A byte of kind 0 (or false) separates, kinds 1 and 2 part where they meet, kind 3 goes with both. Word w is ``data[start[w]:end[w]]``, text t has words ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, texts: pa.Array, kinds: np.ndarray, lower: bool = False) -> None:
        data, offsets = utf8(texts)
        self.data, self.offsets, self.lower = data, offsets, lower
        kind = kinds[data] if len(data) else np.zeros(0, kinds.dtype)
        inside = kind != 0
        begin, stop = inside.copy(), inside.copy()
        turn = kind[1:] + kind[:-1] == 3 if kind.dtype != bool else np.zeros(max(0, len(kind) - 1), bool)
        begin[1:] &= turn | ~inside[:-1]
        stop[:-1] &= turn | ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end, self.lower)
        return self._hash

    def bytes_of(self, w: int) -> bytes:
        word = self.data[self.start[w] : self.end[w]].tobytes()
        return word.translate(LOWER_BYTES) if self.lower else word


_HELD: dict[str, object] = {}


def once(key: str, make: Callable[[], object]):
    """What ``make`` returns, made once in this worker for a key; a few such things are kept."""
    if key not in _HELD:
        if len(_HELD) >= 8:
            _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and the offset of every text and of the end."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the given spans, which are in ascending order and don't overlap."""
    values, out = (_LOWER_VALUES if lower else _VALUES), np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        origin = start[at]
        to = int(np.searchsorted(start, origin + _BLOCK))
        if end[to - 1] - origin > 2 * _BLOCK:
            to -= 1
            if to == at:
                at += 1
                continue
        last = end[to - 1]
        up, down = powers(_BASE, 2 * _BLOCK + 1), powers(_INVERSE, 2 * _BLOCK + 1)
        sums = np.zeros(last - origin + 1, np.uint64)
        np.cumsum(values[data[origin:last]] * up[: last - origin], out=sums[1:])
        s, e = start[at:to] - origin, end[at:to] - origin
        h = (sums[e] - sums[s]) * down[s]
        out[at:to] = mix(h + (e - s).astype(np.uint64) * _SIZE)
        at = to
    # The word's own length alone says which hash it gets.
    for at in np.flatnonzero(end - start > _BLOCK):
        word = data[start[at] : end[at]].tobytes()
        out[at] = xxhash.xxh64_intdigest(word.translate(LOWER_BYTES) if lower else word, 7)
    return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over bytes from which ``between`` reads the hash of any span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_BASE, max(len(data), 1))[: len(data)], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash that ``span_hash`` gives the spans."""
    h = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mix(h + (end - start).astype(np.uint64) * _SIZE)


def gather(words: Words, which: np.ndarray) -> pa.Array:
    """The bytes of some of the words as an Arrow column."""
    size = words.end[which] - words.start[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(words.start[which] - offsets[:-1], size) + np.arange(offsets[-1])
    data = words.data[at]
    data = _LOWER[data] if words.lower else data
    return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of every run of ``k`` consecutive entries of ``h`` (one row less ``k - 1``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    # Doubling: a run of 2m entries is made of two runs of m.
    width, runs, done, b = 1, h, 0, np.uint64(base)
    square = int(base)
    while True:
        if k & width:
            out = out * np.uint64(square) + runs[done : done + n]
            done += width
        if done == k:
            return mix(out)
        runs = runs[:-width] * np.uint64(square) + runs[width:]
        width, square = 2 * width, square * square % (1 << 64)


class Table:
    """An open-addressing table from 64-bit hashes to positions, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        size = 16
        while size < 3 * len(keys):
            size *= 2
        self.mask, self.slots, self.keys = np.uint64(size - 1), np.full(size, -1, np.int32), np.asarray(keys, np.uint64)
        pending, self.probes = np.arange(len(keys)), 0
        while len(pending):
            slot = self._slot(self.keys[pending], self.probes)
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            self.slots[slot[free[one]]] = pending[free[one]]
            pending = np.delete(pending, free[one])
            self.probes += 1

    def _slot(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h >> np.uint64(7)) + np.uint64(probe)) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash among the keys, -1 where it is none of them."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys) or not len(h):
            return out
        at = self.slots[self._slot(h, 0)]
        hit = (at >= 0) & (self.keys[at] == h)
        out[hit] = at[hit]
        rest = np.flatnonzero((at >= 0) & ~hit)
        for probe in range(1, self.probes):
            if not len(rest):
                break
            at = self.slots[self._slot(h[rest], probe)]
            hit = (at >= 0) & (self.keys[at] == h[rest])
            out[rest[hit]] = at[hit]
            rest = rest[(at >= 0) & ~hit]
        return out


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each text's values; the texts' values start at ``first``."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def pieces(batch: pa.RecordBatch, texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows with about ``limit`` bytes of text each, one row at least."""
    n, at = batch.num_rows, 0
    sizes = np.concatenate([[0], np.cumsum(np.diff(utf8(texts)[1]))]) if n else np.zeros(1)
    while at < n:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(
    docs: DataFrame, keep: list[str], fields: list[T.StructField], work: Callable[[pa.Array], list[pa.Array]], text: str = "text"
) -> DataFrame:
    """The kept columns of every row and, behind them, the new columns that ``work`` makes of a run of texts.

    A kept column that has the name of a new one gives way to it.
    """
    ship_package(docs.sparkSession)
    fresh = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in fresh or c == text]
    held = docs.select(F.struct(*[F.col(quoted(c)) for c in dict.fromkeys([*keep, text])]).alias("_row"))
    schema = T.StructType([held.schema["_row"], *[T.StructField("_" + f.name, f.dataType) for f in fields]])

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.column(0).field(text)):
                columns = [part.column(0), *work(texts)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = held.mapInArrow(run, schema)
    kept = [F.col("_row").getField(c).alias(c) for c in keep if c.lower() not in fresh]
    return out.select(*kept, *[F.col("_" + f.name).alias(f.name) for f in fields])


def rows_key(docs: DataFrame, id_column: str = "doc_id", text: str = "text"):
    """A column that is equal just for rows with the same id and text, used to bring results back to their rows."""
    return F.struct(F.col(quoted(id_column)).alias("id"), F.xxhash64(F.col(quoted(text))).alias("a"), F.md5(F.col(quoted(text))).alias("b"))
