"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one scan of the texts.

Texts and items are lower-cased (A-Z) and read as words of letters, digits and
non-ASCII characters. Every word of the items gets a number, spelled with two digits from alphabets of their own, so a
window of ten words is a key of twenty characters that matches at word edges only, and a text is scanned once, two
characters per word. Hits are mapped back to code points of the original text.

Nulls and empty texts have no words and no hits. Items that are null or empty have no
windows; a null item id is left out. Repeated items with the same id count once.
Repeated rows each get their result. An empty table on either side gives no hits.

Very long texts and items are read whole: an item of many words is cut into parts that overlap by a window less a word.
A kept column that has the name of a result gives way to it.

Only the items travel to the workers, in blocks of about ``ITEM_CHARS`` characters; workers build a block's windows and automata (a
further one beyond ``_CODES`` words). ``BLOCKS_AT_ONCE`` blocks are one scan of the texts, and only these pass through the driver at a time. Where
there are more, each scan writes the rows it hit, and these are joined to the texts at the end.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.words import LETTERS, Table, Words, map_texts, once, pieces, quoted, rows_key
from feedloom.session import settle, ship_package

#: Words in a window.
WINDOW = 10
#: Characters of items in a block, blocks in one scan of the texts, and words of an item that stay together.
ITEM_CHARS = 500_000
BLOCKS_AT_ONCE = 4
PART_WORDS = 50_000
#: Words that one automaton numbers at most, and the code points of the two digits of a number.
_CODES = 1 << 20
_HIGH, _LOW = 0x10000, 0x20000

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hits", T.ArrayType(SPAN)),
]


def _spelled(codes: np.ndarray, radix: int) -> str:
    """Two characters per word: the digits of its number, from alphabets of their own; blanks for a word without one."""
    digits = np.stack([codes // radix + _HIGH, codes % radix + _LOW], 1).astype("<u4")
    digits[codes < 0] = 0x20
    return digits.tobytes().decode("utf-32-le")


def _radix(vocabulary: np.ndarray) -> int:
    """Digits are balanced, since an automaton's step looks through what can follow."""
    return math.isqrt(len(vocabulary)) + 1


def windows_of(items: list[tuple[str, str]], window: int = WINDOW) -> tuple[np.ndarray, list[tuple[str, list[str]]]]:
    """The hashes of the items' distinct words, and every distinct window, spelled, with the ids of its items."""
    words = Words(pa.array([text for _, text in items], pa.large_string()), LETTERS, lower=True)
    vocabulary, codes = np.unique(words.hash, return_inverse=True)
    found: dict[str, set[str]] = defaultdict(set)
    line = _spelled(codes, _radix(vocabulary))
    for i, (item, _) in enumerate(items):
        a, b = int(words.first[i]), int(words.first[i + 1])
        for at in range(a, max(a + 1, b - window + 1) if b > a else a):
            found[line[2 * at : 2 * min(b, at + window)]].add(item)
    return vocabulary, [(key, sorted(ids)) for key, ids in sorted(found.items())]


def _alphabets(items: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The items in runs whose words fit one automaton's code points, each word counted as often as it occurs."""
    counts = Words(pa.array([text for _, text in items], pa.large_string()), LETTERS).counts.tolist()
    runs, held = [], _CODES + 1
    for item, n in zip(items, counts, strict=True):
        if held + n > _CODES:
            runs.append([])
            held = 0
        runs[-1].append(item)
        held += n
    return runs


def _automata(items: list[tuple[str, str]], window: int) -> list[tuple[Table, int, ahocorasick.Automaton]]:
    made = []
    for run in _alphabets(items):
        vocabulary, keys = windows_of(run, window)
        automaton = ahocorasick.Automaton()
        for key, ids in keys:
            automaton.add_word(key, (len(key) // 2, ids))
        if keys:
            automaton.make_automaton()
            made.append((Table(vocabulary), _radix(vocabulary), automaton))
    return made


def item_parts(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Items as (item, words, block): long ones in parts that together have all the item's windows."""
    ship_package(items.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words")).where("item IS NOT NULL AND words IS NOT NULL").distinct()

    def cut(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.column(1)):
                words, names, lines = Words(texts, LETTERS, lower=True), [], []
                for t, item in enumerate(part.column(0).to_pylist()):
                    a, b = words.first[t], words.first[t + 1]
                    for at in range(a, max(a + 1, b - window + 1) if b > a else a, PART_WORDS):
                        end = min(b, at + PART_WORDS + window - 1)
                        names.append(item)
                        lines.append(words.data[words.start[at] : words.end[end - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["item", "words"])

    return rows.mapInArrow(cut, "item string, words string")


def _load(parts: DataFrame, window: int):
    """What gives a worker the automata of these parts; they reach it as one broadcast."""
    shared, key = parts.sparkSession.sparkContext.broadcast([(r.item, r.words) for r in parts.collect()]), uuid.uuid4().hex
    return lambda: once(key, lambda: _automata(shared.value, window))


def _scan(automata, texts: pa.Array) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of some texts, which of them are hit, and each text's items."""
    words = Words(texts, LETTERS, lower=True)
    hit_edges = np.zeros(len(words) + 1, np.int32)
    items_of: list[set[str]] = [set() for _ in range(len(texts))]
    for table, radix, automaton in automata:
        line = _spelled(table.find(words.hash).astype(np.int64), radix)
        for t in range(len(texts)):
            a, b = int(words.first[t]), int(words.first[t + 1])
            for last, (length, ids) in automaton.iter(line, 2 * a, 2 * b):
                end = last // 2 + 1
                hit_edges[end - length] += 1
                hit_edges[end] -= 1
                items_of[t].update(ids)
    return words, np.cumsum(hit_edges)[:-1] > 0, items_of


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _columns(words: Words, hit: np.ndarray, items_of: list[set[str]]) -> list[pa.Array]:
    totals = np.concatenate([[0], np.cumsum(hit)])
    n_hit = totals[words.first[1:]] - totals[words.first[:-1]]
    hits = [_stretches(words, hit, t) if n_hit[t] else [] for t in range(len(items_of))]
    return [
        pa.array(words.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
        pa.array([sorted(x) for x in items_of], pa.list_(pa.string())), pa.array(hits, _HITS),
    ]


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its words, the words inside item windows, the items met and the hit stretches of its text.

    ``hits`` holds code point offsets (end exclusive) of the stretches of hit words.
    """
    parts = settle(item_parts(items, window), "item-parts")
    chars = parts.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // ITEM_CHARS))
    if blocks <= BLOCKS_AT_ONCE:
        automata = _load(parts, window)
        found = map_texts(docs, keep or ["doc_id"], FIELDS, lambda texts: _columns(*_scan(automata(), texts)))
    else:
        found = _in_several_scans(docs, parts, blocks, keep or ["doc_id"], window)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _in_several_scans(docs: DataFrame, parts: DataFrame, blocks: int, keep: list[str], window: int) -> DataFrame:
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    runs = T.StructField("runs", T.ArrayType(SPAN))
    met = None
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        automata = _load(parts.where(block.between(first, first + BLOCKS_AT_ONCE - 1)), window)

        def work(texts: pa.Array, automata=automata) -> list[pa.Array]:
            words, hit, items_of = _scan(automata(), texts)
            return [pa.array([sorted(x) for x in items_of], pa.list_(pa.string())), pa.array([_runs(words, hit, t) for t in range(len(texts))], _HITS)]

        part = map_texts(docs.select(rows_key(docs).alias("key"), "text"), ["key"], [FIELDS[2], runs], work)
        part = settle(part.where("size(items) > 0").distinct(), "hits")
        met = part if met is None else met.unionByName(part)
    met = met.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    fresh = {f.name for f in FIELDS}
    keep = [c for c in keep if c.lower() not in fresh]
    row = F.struct(*[F.col(quoted(c)) for c in keep], F.lit(1).alias("_one")).alias("_row")
    held = docs.select(row, F.col("text").alias("_text"), rows_key(docs).alias("key")).join(settle(met, "merged-hits"), "key", "left").select("_row", "_text", "items", "runs")
    schema = T.StructType([held.schema["_row"], *[T.StructField("_" + f.name, f.dataType) for f in FIELDS]])

    def finish(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.column(1)):
                words = Words(texts, LETTERS, lower=True)
                edges, named = np.zeros(len(words) + 1, np.int32), part.column(2).to_pylist()
                for t, some in enumerate(part.column(3).to_pylist()):
                    for r in some or []:
                        edges[words.first[t] + r["start"]] += 1
                        edges[words.first[t] + r["end"]] -= 1
                columns = _columns(words, np.cumsum(edges)[:-1] > 0, [set(x or []) for x in named])
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    out = held.mapInArrow(finish, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[F.col("_" + f.name).alias(f.name) for f in FIELDS])


def _runs(words: Words, hit: np.ndarray, t: int) -> list[dict[str, int]]:
    """The stretches of hit words of a text, in words."""
    flags = np.concatenate([[0], hit[words.first[t] : words.first[t + 1]].astype(np.int8), [0]])
    begins, ends = np.flatnonzero(np.diff(flags) == 1), np.flatnonzero(np.diff(flags) == -1)
    return [{"start": int(i), "end": int(j)} for i, j in zip(begins, ends, strict=True)]


def _stretches(words: Words, hit: np.ndarray, t: int) -> list[dict[str, int]]:
    """The same in code points of the text."""
    a = words.first[t]
    origin, stop = words.offsets[t], words.offsets[t + 1]
    points = np.concatenate([[0], np.cumsum((words.data[origin:stop] & 0xC0) != 0x80)])
    return [{"start": int(points[words.start[a + r["start"]] - origin]), "end": int(points[words.end[a + r["end"] - 1] - origin])} for r in _runs(words, hit, t)]
