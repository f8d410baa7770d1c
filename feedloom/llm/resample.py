"""Target-distribution importance resampling over hashed word n-grams.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A text's features
are all runs of one to ``ORDER`` words; the CRC-32 of a feature modulo ``BUCKETS`` is its bucket. A first
pass counts both corpora into an array of buckets per task; the log ratio of target to raw
counts is an array of gains, and a second pass scores every text by array lookups. Gumbel noise from
a hash of the id makes the highest scores a draw without replacement.

The draw's last key is found by weighted median-of-medians: every partition reports the median of
its remaining keys and their number, the median of these medians (weighted by the numbers) is
the pivot, and a quarter of what remains at least lies on its far side and is discarded. Keys
are unique but for rows equal in id and text. Rounds grow with the logarithm of the rows; when an eighth
or less remains it is written anew, so all rounds together read a few times the keys. The driver holds a row
per partition. Only the winners are sorted.

Null and empty texts have no words, no features and weight 0. A null id reads as empty text in the noise and
comes after all others. Very long texts are read whole. Equal scores go to the smaller id, then to a hash of the text. Rows equal
in all of these are interchangeable; each gets a rank of its own. An empty table gives no rows, an empty
target table counts as no features, and with too few eligible rows for a single draw all ranks are null. A kept column that has the name of a result gives way to it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.words import LETTERS, LOWER_BYTES, Words, pieces, quoted, sums_by
from feedloom.operators.numbering import number_source_rows
from feedloom.session import settle, ship_package

#: Longest run of words that makes a feature, and the number of buckets.
ORDER = 3
BUCKETS = 10_000
#: Percent of the eligible documents that are drawn, and the words that make one eligible.
PERCENT = 5
LEAST_WORDS = 20
SEED = 42

_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
#: Words up to this many bytes are worked on together, byte by byte.
_SHORT = 64


def _append_zero(c: np.ndarray) -> np.ndarray:
    """What a byte of zeros behind them makes of CRC registers."""
    return _BYTE[c & 255] ^ (c >> np.uint32(8))


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_BYTE = _byte_table()


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by what it does to each value of each byte."""
    out = table[0][c & 255]
    for k in (1, 2, 3):
        out = out ^ table[k][(c >> np.uint32(8 * k)) & 255]
    return out


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps for 0, 1 ... _SHORT bytes more, flattened for lookups, and for 1, 2, 4, 8 ... bytes more."""
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    small = [at]
    for _ in range(_SHORT):
        small.append(_append_zero(small[-1]))
    doubled = [small[1]]
    for _ in range(40):
        doubled.append(_through(doubled[-1], doubled[-1]))
    return np.stack(small).reshape(-1), np.stack(doubled)


_SMALL, _DOUBLED = _shift_tables()


def _shifted(c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part of a joint CRC that comes from ``c`` when ``size`` bytes follow."""
    base = np.minimum(size, _SHORT) * 1024
    out = _SMALL[base + (c & 255)]
    for k in (1, 2, 3):
        out = out ^ _SMALL[base + 256 * k + ((c >> np.uint32(8 * k)) & 255)]
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        rest, some = size[long] - _SHORT, out[long]
        for bit in range(int(rest.max()).bit_length()):
            some = np.where(rest >> bit & 1, _through(_DOUBLED[bit], some), some)
        out[long] = some
    return out


def word_crcs(words: Words) -> np.ndarray:
    """The CRC-32 of each (lower-cased) word's bytes."""
    size = words.end - words.start
    out = np.zeros(len(words), np.uint32)
    short = np.flatnonzero(size <= _SHORT)
    # Longest first, so that those with a byte in place j stand at the front.
    order = short[np.argsort(_SHORT - size[short].astype(np.uint8), kind="stable")]
    start, left = words.start[order], size[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j, side="left"))
        b = _LOWER[words.data[start[:n] + j]]
        c[:n] = _BYTE[(c[:n] ^ b) & 255] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    for w in np.flatnonzero(size > _SHORT):
        out[w] = zlib.crc32(words.bytes_of(int(w)))
    return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS, order: int = ORDER) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of some texts, and for 1, 2 ... words: where the feature's first word is, and its bucket."""
    words = Words(texts, LETTERS, lower=True)
    single, size = word_crcs(words), words.end - words.start
    text = np.repeat(np.arange(len(texts)), words.counts)
    found, run = [], single
    for k in range(1, order + 1):
        if k > 1:
            spaced = ~run[: len(run) - 1]
            spaced = ~(_BYTE[(spaced ^ np.uint32(32)) & 255] ^ (spaced >> np.uint32(8)))
            run = _shifted(spaced, size[k - 1 :]) ^ single[k - 1 :] if len(spaced) else spaced
        at = np.flatnonzero(text[: max(0, len(text) - k + 1)] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
        found.append((at, (run[at] % np.uint32(buckets)).astype(np.int64)))
    return words, found


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """The features of all texts, counted per bucket: an array per task, added up."""
    ship_package(docs.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in pieces(batch, batch.column(0)):
                for _, found in feature_buckets(texts, buckets, order)[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # a row per bucket
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of a bucket's smoothed shares, rounded down."""
    all_raw, all_target, b = float(raw.sum()), float(target.sum()), len(raw)
    ratio = [(t + 1) * (all_raw + b) / ((s + 1) * (all_target + b)) for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


_FOUND = [T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight", "score")]


def weighted(docs: DataFrame, gain: np.ndarray, keep: list[str], id_column: str = "doc_id", text: str = "text", seed: int = SEED, order: int = ORDER) -> DataFrame:
    """``_row`` (the kept columns), ``_id``, ``_print`` and the words, features, weight and noisy score of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    ident = F.col(quoted(id_column))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    noise = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    row = F.struct(*[F.col(quoted(c)) for c in keep], F.lit(1).alias("_one")).alias("_row")
    held = docs.select(row, ident.cast("long").alias("_id"), F.xxhash64(F.col(quoted(text))).alias("_print"), noise.alias("_h"), F.col(quoted(text)).alias("_text"))
    schema = T.StructType([held.schema["_row"], held.schema["_id"], held.schema["_print"], *_FOUND])

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.column(4)):
                words, found = feature_buckets(texts, len(shared.value), order)
                weights, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for at, bucket in found:
                    weights[at] += shared.value[bucket]
                    n[at] += 1
                weight = sums_by(weights, words.first)
                luck = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in part.column(3).to_pylist()]
                columns = [words.counts.astype(np.int64), sums_by(n, words.first), weight, weight + np.array(luck, np.int64)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, columns)], names=schema.names)

    return held.mapInArrow(run, schema)


def _nth(keys: list[np.ndarray], r: int) -> tuple[int, ...]:
    """The key in place ``r`` of the sorted keys, which are given column by column."""
    found = []
    for i in range(len(keys)):
        value = np.partition(keys[i], r)[r]
        r -= int((keys[i] < value).sum())
        equal = keys[i] == value
        keys = [k[equal] for k in keys]
        found.append(int(value))
    return tuple(found)


def _side(keys: list[np.ndarray], pivot: tuple[int, ...]) -> np.ndarray:
    """-1, 0 or 1 for keys before, at and behind the pivot."""
    out = np.zeros(len(keys[0]), np.int8)
    for column, p in zip(keys, pivot, strict=True):
        out += (out == 0) * ((column > p).astype(np.int8) - (column < p).astype(np.int8))
    return out


def _tallies(low, pivot, high):
    """Per partition: the keys between the bounds before, at and behind the pivot, and the medians before and behind."""

    def run(batches):
        parts = []
        for batch in batches:
            keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            inside = np.ones(len(keys[0]), bool)
            if low is not None:
                inside &= _side(keys, low) > 0
            if high is not None:
                inside &= _side(keys, high) < 0
            parts.append([k[inside] for k in keys])
        keys = [np.concatenate(k) for k in zip(*parts, strict=True)] if parts else []
        if not keys or not len(keys[0]):
            return
        side = _side(keys, pivot) if pivot is not None else np.full(len(keys[0]), -1, np.int8)
        row = [int((side == 0).sum())]
        for where in (-1, 1):
            some = [k[side == where] for k in keys]
            row += [len(some[0]), list(_nth(some, (len(some[0]) - 1) // 2)) if len(some[0]) else None]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["equal", "before", "median_before", "behind", "median_behind"])

    return run


def _weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    half, sofar = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        sofar += n
        if sofar >= half:
            return key
    raise ValueError("no keys")


def kth_key(keys: DataFrame, k: int) -> tuple[int, ...]:
    """The key in place ``k`` (from 1) of the ascending order of all rows, whose columns are longs without nulls."""
    ship_package(keys.sparkSession)
    names, low, high = keys.columns, None, None
    key = F.struct(*[F.col(quoted(c)) for c in names])
    literal = lambda values: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, values, strict=True)])

    def tally(pivot):
        rows = keys.mapInArrow(_tallies(low, pivot, high), "equal long, before long, median_before array<long>, behind long, median_behind array<long>").collect()
        before = [(tuple(r.median_before), r.before) for r in rows if r.before]
        behind = [(tuple(r.median_behind), r.behind) for r in rows if r.behind]
        return before, sum(r.equal for r in rows), behind

    remaining, _, _ = tally(None)
    written = sum(n for _, n in remaining)
    if not 1 <= k <= written:
        raise ValueError(f"place {k} of {written} keys")
    while True:
        pivot = _weighted_median(remaining)
        before, equal, behind = tally(pivot)
        n_before = sum(n for _, n in before)
        if n_before < k <= n_before + equal:
            return pivot
        if k <= n_before:
            high, remaining = pivot, before
        else:
            low, remaining, k = pivot, behind, k - n_before - equal
        left = sum(n for _, n in remaining)
        if 8 * left <= written and left > 1 << 16:
            inside = F.lit(True)
            inside = inside & (key > literal(low)) if low is not None else inside
            inside = inside & (key < literal(high)) if high is not None else inside
            keys, written = settle(keys.where(inside), "remaining-keys"), left


def _key() -> list[Column]:
    """Ascending longs: highest score first, then the smaller id, nulls last, then the text's hash."""
    return [(-F.col("score")).alias("k0"), F.col("_id").isNull().cast("long").alias("k1"), F.coalesce("_id", F.lit(0)).alias("k2"), F.col("_print").alias("k3")]


def resample(
    docs: DataFrame, target: DataFrame, keep: list[str] | None = None, id_column: str = "doc_id", text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """The kept columns of every row with its words, features, weight, noisy score, and the rank of those drawn (else null)."""
    fresh = {f.name for f in _FOUND} | {"rank"}
    keep = [c for c in (keep or [id_column]) if c.lower() not in fresh]
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, "text", buckets))
    scored = settle(weighted(docs, gain, keep, id_column, text, seed), "weights")
    eligible = scored.where(F.col("n_words") >= least_words)
    draws = percent * eligible.count() // 100
    names = [f.name for f in _FOUND]
    shown = [F.col("_row").getField(c).alias(c) for c in keep]
    none = F.lit(None).cast("long").alias("rank")
    if not draws:
        return scored.select(*shown, *names, none)
    last = kth_key(eligible.select(*_key()), draws)
    key = _key()
    won = (F.col("n_words") >= least_words) & (F.struct(*key) <= F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(last)]))
    winners = settle(scored.where(won).orderBy(*key), "winners")
    ranked = number_source_rows(winners, "_place").withColumn("rank", F.col("_place") + 1)
    # Rows equal to the last key come last; those beyond the draw have no rank.
    ranked = ranked.select("_row", *names, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return scored.where(~won).select("_row", *names, none).unionByName(ranked).select(*shown, *names, "rank")
