"""SimHash near-duplicates: exact tiled comparison of fingerprints with NumPy, then connected groups.

A fingerprint is the bitwise majority over the XXH64 values (seed 42) of a text's word
shingles. Only distinct fingerprints are compared. Tiles hold fingerprints with equal
population counts in each of four 16-bit parts; two fingerprints that differ in at most
r bits have parts whose counts differ by r in total at most, so only such pairs of tiles are
compared, every fingerprint pair in them by exclusive-or and bit count. Tiles over
``TILE`` rows are cut, and every pair of cuts is compared. Of the links found in a pair of
tiles a spanning forest leaves the task: nothing that connects is lost and the links of a group
of n stay near n.

Null and empty texts have no words and fingerprint zero, which links like any other; texts
with fewer words than a shingle have one shingle of all words. Rows with equal
fingerprints belong together. A null id never is a component's name unless all its members have none.
An empty table gives no rows. Very long texts are read whole. A kept column named ``fp`` or ``component_id`` comes back beside the result of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.components import connected, spanning_forest
from feedloom.llm.words import LOWER_BYTES, UNSPACED, Words, map_texts, quoted
from feedloom.session import settle, ship_package

SHINGLE = 3
RADIUS = 2
#: Fingerprints of one side of a comparison held at a time.
TILE = 2048
_PARTS, _PART_BITS = 4, 16


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    words = Words(texts, UNSPACED, lower=True)
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for t in range(len(texts)):
        a, b = words.first[t], words.first[t + 1]
        if a == b:
            continue
        text = words.data[words.offsets[t] : words.offsets[t + 1]].tobytes().translate(LOWER_BYTES)
        line = b" ".join(text.split())
        # Where words start in the joined line, read off the words' lengths.
        sizes = (words.end[a:b] - words.start[a:b]) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        k = min(shingle, b - a)
        spans = zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
        h = np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, b - a - k + 1)
        out[t] = majority(h)
    return out


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The kept columns of every row and ``fp``, its text's fingerprint as a signed long."""

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(fingerprints_of(texts, shingle).view(np.int64))]

    return map_texts(docs, keep or ["doc_id"], [T.StructField("fp", T.LongType())], work)


def _counts(fp: np.ndarray) -> np.ndarray:
    """The population counts of the four parts, one row per fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, _PARTS)).astype(np.int16)


def _offsets(radius: int) -> np.ndarray:
    """The differences of part counts with a sum of at most ``radius`` that come after zero, in lexical order."""
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * _PARTS, indexing="ij"), -1).reshape(-1, _PARTS)
    grid = grid[np.abs(grid).sum(axis=1) <= radius]
    return np.array([g for g in grid.tolist() if g > [0] * _PARTS], np.int16).reshape(-1, _PARTS)


_CELL_BASE = 17 ** np.arange(_PARTS - 1, -1, -1)


def _cells(radius: int):
    """Each fingerprint once for its own cell (side 0) and once for every later cell within the radius (side 1)."""
    later = _offsets(radius)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                own = _counts(fp)
                near = own[:, None, :] + later[None, :, :]
                fits = ((near >= 0) & (near <= _PART_BITS)).all(axis=2)
                rows = np.nonzero(fits)[0]
                cell = np.concatenate([own @ _CELL_BASE, near[fits] @ _CELL_BASE])
                side = np.repeat([0, 1], [len(fp), len(rows)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(side.astype(np.int8)), pa.array(np.concatenate([fp, fp[rows]]))],
                    names=["cell", "side", "fp"],
                )

    return run


def _compare(radius: int, tile: int):
    """Links inside runs of rows with one (cell, cut, with) key: side 0 with side 0 and with side 1."""

    def links_of(left: np.ndarray, right: np.ndarray, same: bool) -> list[np.ndarray]:
        found = []
        rows = max(1, (1 << 21) // max(1, len(right)))
        for at in range(0, len(left), rows):
            near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
            i, j = np.nonzero(near)
            i += at
            keep = i < j if same else slice(None)
            found.append(np.stack([left[i[keep]], right[j[keep]]], 1))
        return found

    def forest(left, right, own) -> pa.RecordBatch | None:
        found = []
        for at in range(0, len(left), tile):
            part = left[at : at + tile]
            if own:
                found += links_of(part, part, True)
                for more in range(at + tile, len(left), tile):
                    found += links_of(part, left[more : more + tile], False)
            for to in range(0, len(right), tile):
                found += links_of(part, right[to : to + tile], False)
        links = spanning_forest(np.concatenate(found).view(np.int64)) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"]) if len(links) else None

    def run(batches):
        key, sides = None, ([], [])
        for batch in batches:
            cell, cut, other, side = (batch.column(i).to_numpy() for i in range(4))
            fp = batch.column(4).to_numpy().view(np.uint64)
            if not len(fp):
                continue
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(cut) != 0) | (np.diff(other) != 0)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(fp)], strict=True):
                here = (cell[a], cut[a], other[a])
                if key is not None and here != key:
                    if (out := _done(forest, key, sides)) is not None:
                        yield out
                    sides = ([], [])
                key = here
                for s in (0, 1):
                    sides[s].append(fp[a:b][side[a:b] == s])
        if key is not None and (out := _done(forest, key, sides)) is not None:
            yield out

    return run


def _done(forest, key, sides):
    left, right = (np.concatenate(s) for s in sides)
    _, _, other = key
    return forest(left, right, own=other == -1)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A set of links (a, b) that connects just the fingerprints of ``distinct`` (column ``fp``) connected by links within the radius."""
    ship_package(distinct.sparkSession)
    cells = distinct.select("fp").mapInArrow(_cells(radius), "cell int, side byte, fp long")
    # At most 17 ** 4 cells, so this table is bounded whatever the size of the input.
    cuts = cells.groupBy("cell").agg(
        F.count(F.when(F.col("side") == 0, 1)).alias("own"), F.count(F.when(F.col("side") == 1, 1)).alias("near")
    )
    cuts = cuts.where("own > 0 AND own + near > 1").select(
        "cell", F.ceil(F.col("own") / tile).cast("int").alias("own_cuts"), F.ceil(F.col("near") / (2 * tile)).cast("int").alias("near_cuts")
    )
    placed = cells.join(F.broadcast(cuts), "cell")
    mine = F.pmod(F.xxhash64("fp"), F.col("own_cuts")).cast("int")
    theirs = F.pmod(F.xxhash64("fp"), F.greatest("near_cuts", F.lit(1))).cast("int")
    # Own cut i is compared with itself (-1), with each later own cut (-2 - j: those rows come as side 1), and with each near cut.
    targets = F.when(
        F.col("side") == 0,
        F.concat(
            F.array(F.struct(mine.alias("cut"), F.lit(-1).alias("other"), F.lit(0).cast("byte").alias("as"))),
            F.transform(F.sequence(F.lit(0), F.col("near_cuts")), lambda j: F.struct(mine.alias("cut"), j.alias("other"), F.lit(0).cast("byte").alias("as"))),
            F.transform(F.sequence(F.lit(0), F.col("own_cuts")), lambda j: F.struct(F.least(mine, j).alias("cut"), (F.lit(-1) * F.greatest(mine, j) - 2).alias("other"), F.when(j < mine, 1).otherwise(0).cast("byte").alias("as"))),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("own_cuts")), lambda i: F.struct(i.alias("cut"), theirs.alias("other"), F.lit(1).cast("byte").alias("as"))))
    spread = placed.select("cell", "fp", "side", "own_cuts", "near_cuts", F.explode(targets).alias("t")).where(
        "t.cut < own_cuts AND (t.other < near_cuts) AND (t.other >= -1 OR (-t.other - 2 < own_cuts AND -t.other - 2 != t.cut))"
    )
    keyed = spread.select("cell", F.col("t.cut").alias("cut"), F.col("t.other").alias("other"), F.col("t.as").alias("side"), "fp")
    dealt = keyed.repartition("cell", "cut", "other").sortWithinPartitions("cell", "cut", "other")
    return dealt.mapInArrow(_compare(radius, tile), "a long, b long")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None, shingle: int = SHINGLE, radius: int = RADIUS, id_column: str = "doc_id") -> DataFrame:
    """The kept columns of every row, its fingerprint ``fp`` and ``component_id``, the smallest id reachable over links."""
    keep = list(dict.fromkeys([*(keep or []), id_column]))
    held = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = settle(fingerprints(docs, keep, shingle).select(*held, "fp"), "fingerprints")
    lead = rows.groupBy("fp").agg(F.min(f"k{keep.index(id_column)}").alias("lead"))
    groups = settle(lead, "fingerprint-groups")
    found = links(groups, radius)
    labels = connected(found, groups)
    joined = rows.join(labels, "fp", "left")
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "fp", "component_id")
