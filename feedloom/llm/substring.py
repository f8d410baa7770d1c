"""Substring dedup by seed and extend.

Words stand between ASCII white space. Each window of ``LENGTH`` words picks the smallest
of its ``SEED``-word hashes as its anchor (winnowing), so equal windows pick equal anchors at
equal places. Neighbouring windows with one anchor form a stretch: the anchor extended both
ways to its first and last window. Anchors met in one document only are dropped. What is left
is joined on the anchor: stretches with equal words form a class, and all but those of the
class's smallest document are repeats from end to end. Where an anchor has classes that differ
somewhere, one stretch of each class is extended window by window and every window is
given to the smallest document that holds it. So no pairs are formed: a group of n copies costs n
rows, and the union of a document's repeated windows is its maximal repeats.

A window is repeated if its words also start in a document with a smaller id, judged on the input.
Rows with the same id never remove each other's words; a null id comes after all others. Null and
empty texts have no words; texts shorter than a window lose nothing. Rows repeated as a whole get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.words import UNSPACED, Words, mix, pieces, powers, quoted, rolling
from feedloom.session import settle, ship_package

#: Words in a window, and in a seed.
LENGTH = 50
SEED = 12
_GRAMS = LENGTH - SEED + 1
_PLACE = np.uint64((1 << 30) - 1)
_GRAM_BASE, _WINDOW_BASE, _STRETCH_BASE = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9
_LAST = (1 << 63) - 1


def stretches(words: Words) -> tuple[np.ndarray, ...]:
    """Each stretch's anchor hash, words' hash, first window, number of windows, and text."""
    h, n_windows = words.hash, len(words) - LENGTH + 1
    if n_windows <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    grams = rolling(h, SEED, _GRAM_BASE)
    least, width = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * width <= _GRAMS:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = _GRAMS - width
    place = (np.minimum(least[:n_windows], least[rest : rest + n_windows]) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    inside = text[:n_windows] == text[LENGTH - 1 :]
    begins, ends = inside.copy(), inside.copy()
    same = (place[1:] == place[:-1]) & inside[1:] & inside[:-1]
    begins[1:] &= ~same
    ends[:-1] &= ~same
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    at = place[first]
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_STRETCH_BASE, len(h)), out=sums[1:])
    inverse = powers(pow(_STRETCH_BASE, -1, 1 << 64), len(h))
    whole = (sums[last + LENGTH] - sums[first]) * inverse[first]
    shape = ((at - first) * 64 + (last - first)).astype(np.uint64)
    return grams[at], mix(whole + mix(shape + np.uint64(1))), first - words.first[text[first]], last - first + 1, text[first]


_FOUND = "anchor long, class long, doc long, print long, first int, n int"
_WINDOWS = f"{_FOUND}, index int, window long"


def _find(batches):
    for batch in batches:
        for part, texts in pieces(batch, batch.column(2)):
            anchor, class_, first, n, text = stretches(Words(texts, UNSPACED))
            if len(anchor):
                doc, print_ = (part.column(i).take(pa.array(text)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(class_.view(np.int64)), doc, print_, pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["anchor", "class", "doc", "print", "first", "n"],
                )


def _extend(batches):
    """The hash of every window of the listed stretches."""
    for batch in batches:
        for part, texts in pieces(batch, batch.column(0)):
            words = Words(texts, UNSPACED)
            windows = rolling(words.hash, LENGTH, _WINDOW_BASE)
            listed = part.column(1)
            row = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy(zero_copy_only=False))
            anchor, class_, doc, print_, first, n = (f.to_numpy(zero_copy_only=False) for f in listed.flatten().flatten())
            at = words.first[row] + first
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [*(np.repeat(c, n) for c in (anchor, class_, doc, print_, first, n)), index.astype(np.int32), windows[np.repeat(at, n) + index].view(np.int64)]
            for a in range(0, len(index), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], names=_WINDOWS.replace(",", "").split()[::2])


_KEPT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


def _cut(text: str | None, repeats: list[dict] | None) -> tuple[int, int, str, list[tuple[int, int]]]:
    words = (text or "").encode().split()
    if not repeats:
        return len(words), 0, b" ".join(words).decode(), []
    edges = np.zeros(len(words) + 1, np.int32)
    for r in repeats:
        mask = r["mask"]
        for i in range(r["n"]):
            if mask >> i & 1:
                edges[r["first"] + i] += 1
                edges[r["first"] + i + LENGTH] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    steps = np.diff(np.r_[0, gone.astype(np.int8), 0])
    runs = list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return len(words), int(gone.sum()), kept.decode(), runs


def _remove(batches):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part, texts in pieces(batch, batch.column(1)):
            cut = [_cut(t, r) for t, r in zip(texts.to_pylist(), part.column(2).to_pylist(), strict=True)]
            n, gone, kept, runs = zip(*cut, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], span)],
                names=["_row", "_n_words", "_n_removed", "_kept", "_repeats"],
            )


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept columns of every row with its words, those removed, what is kept (joined by one space) and the maximal repeats (in words).

    A kept column that has the name of a result column gives way to it.
    """
    ship_package(docs.sparkSession)
    fresh = {f.name for f in _KEPT}
    keep = [c for c in (keep or [id_column]) if c.lower() not in fresh]
    doc = F.coalesce(F.col(quoted(id_column)).cast("long"), F.lit(_LAST))
    # A row is known by its id and a hash of its text: rows equal in both have equal results.
    print_ = F.xxhash64(F.col(quoted(text)))
    texts = docs.select(doc.alias("doc"), print_.alias("print"), F.col(quoted(text)).alias("text"))
    found = texts.mapInArrow(_find, _FOUND)
    ends = found.select("anchor", "class", "doc").groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("class").alias("one"), F.max("class").alias("other")
    )
    # Written tables on the aggregated side of the joins leave the planner free to split anchors that many rows share.
    ends = settle(ends.where("low < high").select("anchor", (F.col("one") != F.col("other")).alias("several")), "anchors")
    shared = settle(found.join(ends, "anchor"), "shared-anchors")

    # Each stretch beside the first of its class: one that stands in a later document is repeated from end to end.
    row = F.struct("doc", "print", "first", "n")
    classes = settle(shared.groupBy("anchor", "class").agg(F.min(row).alias("lead")), "classes")
    placed = settle(shared.join(classes, ["anchor", "class"]).withColumn("leads", row == F.col("lead")), "class-members")
    places = ["doc", "print", "first", "n", "mask"]
    later = placed.where("doc > lead.doc").withColumn("mask", F.lit(-1).cast("long"))

    # Rows that are equal in id and text would extend the same stretches again; their windows' minima don't change.
    listed = placed.where("leads AND several").groupBy("doc", "print").agg(F.collect_set(F.struct("anchor", "class", "doc", "print", "first", "n")).alias("stretches"))
    windows = texts.join(listed, ["doc", "print"]).select("text", "stretches")
    windows = settle(windows.mapInArrow(_extend, _WINDOWS), "windows")
    lowest = windows.groupBy("anchor", "window").agg(F.min("doc").alias("lowest"), F.max("doc").alias("highest"))
    lowest = settle(lowest.where("lowest < highest").select("anchor", "window", "lowest"), "lowest")
    late = windows.join(lowest, ["anchor", "window"]).where("lowest < doc")
    # What was extended carries its place along.
    extended = settle(late.groupBy("anchor", "class", "doc", "print", "first", "n").agg(F.bit_or(F.expr("shiftleft(1L, index)")).alias("mask")), "extended")
    # Further places of the class in the document that was extended.
    again = placed.where("NOT leads AND doc = lead.doc").join(extended.select("anchor", "class", "mask"), ["anchor", "class"])
    hit = extended.select(places).unionByName(later.select(places)).unionByName(again.select(places))
    hit = hit.groupBy("doc", "print").agg(F.collect_set(F.struct("first", "n", "mask")).alias("_hit"))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep], F.lit(1).alias("_one")).alias("_row"), F.col(quoted(text)).alias("_text"), doc.alias("doc"), print_.alias("print"))
    held = rows.join(hit, ["doc", "print"], "left").select("_row", "_text", "_hit")
    schema = T.StructType([held.schema["_row"], *[T.StructField("_" + f.name, f.dataType) for f in _KEPT]])
    out = held.mapInArrow(_remove, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[F.col("_" + f.name).alias(f.name) for f in _KEPT])
