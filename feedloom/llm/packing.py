"""Best-fit packing of documents into bins of several permitted lengths.

Documents longer than the largest length are cut into full bins and a rest. What is left is packed
best-fit, largest first: each piece goes to the open bin with the least room that holds it; where
none does, a bin is opened with the length whose cost per token it can fill is least. Every block
tries each permitted length as the largest to open, downsizes every bin to the smallest length that holds its contents,
and keeps the cheapest outcome. Blocks of about ``BLOCK`` documents are packed independently, so a block
leaves a few part-filled bins and no block grows with the input. A document's block follows from a hash of its id and tokens, so
the packing is the same under any partitioning.

Documents without tokens (null and empty texts) come back once, without a bin. Repeated rows are
packed each. Null ids are packed as others. Of pieces with equal sizes the one with the smaller id goes first (nulls before all). Very
long documents are cut, never dropped. An empty table gives no rows. Only ids and token counts are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import quoted
from feedloom.session import settle, ship_package

LENGTHS = (512, 1024, 2048, 4096)
BLOCK = 20_000
#: A bin costs this many tokens besides its length, and its length squared over this many.
OVERHEAD, SQUARE = 256, 16_384
_SCHEMA = "id long, piece int, piece_start long, piece_tokens long, bin_id long, bin_offset int, bin_size int"


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / SQUARE


def _best_fit(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bins for sizes in falling order: each piece's bin and offset, and what each bin holds."""
    room: dict[int, list[int]] = defaultdict(list)
    open_rooms, where, offset, held, length_of = 0, [], [], [], []
    left = sum(sizes)
    for size in sizes:
        fits = open_rooms >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_rooms &= ~(1 << free)
        else:
            # The bin can fill with this piece and what is still to come.
            free = min((n for n in lengths if n >= size), key=lambda n: (cost(n) / min(n, left), n))
            b = len(held)
            held.append(0)
            length_of.append(free)
        where.append(b)
        offset.append(held[b])
        held[b] += size
        left -= size
        if free > size:
            room[free - size].append(b)
            open_rooms |= 1 << (free - size)
    return where, offset, held


def pack_block(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Each piece's bin and offset, and each bin's length, for sizes in falling order."""
    best = None
    for top in range(1, len(lengths) + 1):
        if sizes and sizes[0] > lengths[top - 1]:
            continue
        where, offset, held = _best_fit(sizes, lengths[:top])
        fitted = [next(n for n in lengths if n >= h) for h in held]
        price = sum(map(cost, fitted))
        if best is None or price < best[0]:
            best = price, where, offset, fitted
    return best[1:] if best else ([], [], [])


def _rows(block: int, ids: list, tokens: list[int], lengths: tuple[int, ...]) -> pa.RecordBatch:
    out, rest, largest = [], [], lengths[-1]
    bins = 0
    for doc, n in zip(ids, tokens, strict=True):
        full = n // largest
        for piece in range(full):
            out.append((doc, piece, piece * largest, largest, (block << 32) + bins, 0, largest))
            bins += 1
        if n % largest:
            rest.append((n % largest, full, doc))
        elif not n:
            out.append((doc, 0, 0, 0, None, None, None))
    rest.sort(key=lambda r: -r[0])
    where, offset, fitted = pack_block([r[0] for r in rest], lengths)
    for (size, piece, doc), b, at in zip(rest, where, offset, strict=True):
        out.append((doc, piece, piece * largest, size, (block << 32) + bins + b, at, fitted[b]))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def pack(docs: DataFrame, tokens: str = "n_tokens", id_column: str = "doc_id", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """A row per piece of every document: its place in the document, its bin, its place there and the bin's length."""
    ship_package(docs.sparkSession)
    lengths = tuple(sorted(set(lengths)))
    counted = docs.select(F.col(quoted(id_column)).cast("long").alias("id"), F.coalesce(F.col(quoted(tokens)).cast("long"), F.lit(0)).alias("n"))
    # Equal rows are counted and numbered, so blocks follow from the rows alone, not from how they were partitioned.
    sizes = settle(counted.groupBy("id", "n").agg(F.count(F.lit(1)).alias("times")), "token-sizes")
    blocks = max(1, -(-(sizes.agg(F.sum("times")).first()[0] or 0) // BLOCK))
    each = sizes.select("id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("row"))
    dealt = each.withColumn("block", F.pmod(F.xxhash64("id", "n", "row"), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block", F.desc("n"), "id", "row").select("block", "id", "n")

    def run(batches) -> Iterator[pa.RecordBatch]:
        current, ids, tokens = None, [], []
        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(block)], strict=True):
                if a == b:
                    continue
                if ids and block[a] != current:
                    yield _rows(int(current), ids, tokens, lengths)
                    ids, tokens = [], []
                current = block[a]
                ids += batch.column(1).slice(a, b - a).to_pylist()
                tokens += batch.column(2).slice(a, b - a).to_pylist()
        if ids:
            yield _rows(int(current), ids, tokens, lengths)

    return dealt.mapInArrow(run, _SCHEMA).withColumnRenamed("id", id_column)
