"""Ranked lexical search with no random access (NRA) over document shards.

Terms are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. One scan keeps, per
document, its number of terms and the counts of terms that some item asks for; document
frequencies come from that table. Documents are then read again in shards of at most ``SHARD_DOCS``
documents or about ``SHARD_POSTINGS`` postings. A shard sorts its postings by term and falling impact, and each item
reads its lists from the top, in depths that grow fourfold. What was read gives every document
a lower bound of its score; the next unread impact of the lists it was not met in adds up to the
upper bound. Reading goes on until no document whose upper bound reaches the limit has an open interval: then
membership, ties and scores are all exact. The limit is the score in place ``top`` found
so far, here or in the task's earlier shards, so later shards stop sooner. Per task the
best ``top`` of each item leave, and are merged through salted ranks.

Items are looked up by 64-bit hashes of their terms. They travel to the workers in blocks of about ``ITEM_CHARS`` characters (one
item at least), one pass over the documents each.

Null and empty texts have no terms and take no part; so do documents without a term of an item (their score is 0).
Very long texts are read whole; a document's terms stay together. Equal scores go to the smaller id, a null id last; rows equal in both
are interchangeable and each takes a place. Rows repeated as a whole count as documents of their own. Items equal in id and text are one item; a null
item id is an item like any other. Empty tables give no rows. Extra columns are never read.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from feedloom.llm.words import LETTERS, Table, Words, once, pieces, quoted
from feedloom.session import settle, ship_package

TOP = 50
ITEM_CHARS = 2_000_000
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 2_000_000
FIRST_DEPTH = 64
_SALTS = 16


def _terms_of(texts: pa.Array) -> Words:
    return Words(texts, LETTERS, lower=True)


def postings(docs: DataFrame, terms: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with a term: its id, its number of terms, and places in ``terms`` with their counts."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    key = uuid.uuid4().hex

    def run(batches):
        table = once(key, lambda: Table(shared.value))
        v = max(1, len(shared.value))
        for batch in batches:
            for part, texts in pieces(batch, batch.column(1)):
                words = _terms_of(texts)
                code = table.find(words.hash).astype(np.int64)
                at = np.repeat(np.arange(len(texts)), words.counts)
                pair, tf = np.unique((at * v + code)[code >= 0], return_counts=True)
                first = np.searchsorted(pair, np.arange(len(texts) + 1) * v).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in ((pair % v).astype(np.int32), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts.astype(np.int64)), *lists], names=["doc", "n", "codes", "tfs"])
                yield out.filter(pa.array(words.counts > 0))

    held = docs.select(F.col(quoted(id_column)).cast("long").alias("doc"), F.col(quoted(text)).alias("text"))
    return held.mapInArrow(run, "doc long, n long, codes array<int>, tfs array<long>")


def impacts(weight: np.ndarray, codes: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each posting adds to a score; ``m`` is its document's length norm."""
    return weight[codes] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m))


class Shard:
    """The postings of some documents by term, highest impact first."""

    def __init__(self, codes: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        some = np.flatnonzero(impact > 0)
        some = some[np.lexsort((-impact[some], codes[some]))]
        self.codes, self.docs, self.impact, self.n_docs = codes[some], docs[some], impact[some], n_docs

    def search(self, terms: np.ndarray, top: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may be among the best ``top`` with ``limit`` at least, and their scores."""
        begin, end = np.searchsorted(self.codes, terms), np.searchsorted(self.codes, terms, side="right")
        depth = FIRST_DEPTH
        while True:
            stop = np.minimum(begin + depth, end)
            open_ = stop < end
            frontier = np.where(open_, self.impact[np.minimum(stop, len(self.impact) - 1)], 0) if len(self.impact) else np.zeros(len(terms), np.int64)
            size = stop - begin
            read = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            lower, met = np.zeros(self.n_docs, np.int64), np.zeros(self.n_docs, np.int64)
            np.add.at(lower, self.docs[read], self.impact[read])
            np.add.at(met, self.docs[read], np.repeat(frontier, size))
            upper = lower + frontier.sum() - met
            least = max(limit, int(np.partition(lower, -top)[-top])) if self.n_docs >= top else limit
            if not ((upper >= least) & (lower < upper)).any():
                found = np.flatnonzero((lower >= least) & (lower == upper))
                return found, lower[found]
            depth *= 4


def _best(score: np.ndarray, ident: np.ndarray, null: np.ndarray, top: int) -> list[np.ndarray]:
    order = np.lexsort((ident, null, -score))[:top]
    return [score[order], ident[order], null[order]]


def _search(shared, top: int, n_all: int, terms_all: int, schema: T.StructType):
    """The best documents of each item among a task's rows."""
    kind = to_arrow_type(schema["item_id"].dataType)

    def run(batches):
        names, asked, weight = shared.value
        best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)] for _ in asked]

        def finish(rows: list[pa.RecordBatch]) -> None:
            ident = np.concatenate([r.column(0).fill_null(0).to_numpy() for r in rows])
            null = np.concatenate([r.column(0).is_null().to_numpy(zero_copy_only=False) for r in rows])
            m = np.array([50 + 50 * n * n_all // terms_all for r in rows for n in r.column(1).to_pylist()], np.int64)
            size = np.concatenate([r.column(2).value_lengths().to_numpy() for r in rows])
            codes, tfs = (np.concatenate([r.column(c).flatten().to_numpy() for r in rows]) for c in (2, 3))
            docs = np.repeat(np.arange(len(ident), dtype=np.int32), size)
            shard = Shard(codes, docs, impacts(weight, codes, tfs, m[docs]), len(ident))
            for i, terms in enumerate(asked):
                limit = int(best[i][0][-1]) if len(best[i][0]) == top else 1
                found, score = shard.search(terms, top, limit)
                if len(found):
                    more = [score, ident[found], null[found]]
                    best[i] = _best(*[np.concatenate(x) for x in zip(best[i], more, strict=True)], top)

        rows, n_docs, n_postings = [], 0, 0
        for batch in batches:
            ends, at = np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                held = ends[at - 1] if at else 0
                to = min(max(at + 1, int(np.searchsorted(ends, held + SHARD_POSTINGS // 8, side="right"))), at + 1024, batch.num_rows)
                rows.append(batch.slice(at, to - at))
                n_docs, n_postings, at = n_docs + to - at, n_postings + int(ends[to - 1] - held), to
                if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    finish(rows)
                    rows, n_docs, n_postings = [], 0, 0
        if rows:
            finish(rows)
        for i, (score, ident, null) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(score), pa.int32()), pa.array([names[i]] * len(score), kind), pa.array(ident, mask=null), pa.array(score)],
                    names=schema.names,
                )

    return run


def _one_block(docs: DataFrame, items: DataFrame, top: int, id_column: str, text: str) -> DataFrame:
    """The ranked documents of a bounded number of items."""
    spark = docs.sparkSession
    rows = items.collect()
    words = _terms_of(pa.array([r.text for r in rows], pa.large_string()))
    terms, code = np.unique(words.hash, return_inverse=True)
    asked = [np.unique(code[words.first[i] : words.first[i + 1]]) for i in range(len(rows))]
    found = settle(postings(docs, terms, id_column, text), "postings")
    n_all, terms_all = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # A row per term of the block.
    df = {r.code: r.df for r in found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).collect()}
    weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * df.get(c, 0) + 1))) for c in range(len(terms))], np.int64)
    shared = spark.sparkContext.broadcast(([r.item_id for r in rows], asked, weight))
    schema = T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"], T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    best = found.mapInArrow(_search(shared, top, n_all, max(1, terms_all), schema), schema)
    # The best of each part of an item's rows first, so that no task orders what all others found.
    for part in (F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)), F.lit(0)):
        order = Window.partitionBy("item", "_part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("_part", part).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """Per item: its ``top`` documents with the highest scores above 0, ranked."""
    ship_package(docs.sparkSession)
    asked = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // item_chars))
    if blocks == 1:
        return _one_block(docs, asked, top, id_column, text)
    dealt = settle(asked.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = None
    for b in range(blocks):
        part = settle(_one_block(docs, dealt.where(F.col("_block") == b).drop("_block"), top, id_column, text), "ranked")
        found = part if found is None else found.unionByName(part)
    return found
