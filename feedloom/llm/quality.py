"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words and runs of signs are the tokens; a token equal to the one before it becomes one
repetition token. One-grams and two-grams are hashed to ``2 ** BITS`` weights; a text's
vector holds their shares, times ``SCALE``, and a score is the logistic of a sparse dot product. Training
takes a sample of at most ``SAMPLE`` labelled rows (those with the smallest hash of their id)
and goes over it ``EPOCHS`` times in one task; scoring reads every whole text.

Null and empty texts have the score of the bias alone. Labels that are null, or whose document is
missing, are left out. Without any labels every score is a half. An id is learned from once, however often its rows or its labels
are repeated; repeated rows each get their result. Very long texts are read whole. A kept column named ``score`` gives way to the result.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.words import WORDS_AND_SIGNS, Words, map_texts, mix, pieces, quoted, sums_by
from feedloom.session import ship_package

BITS = 18
SCALE = 20.0
SAMPLE = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.05
_REPEAT, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9FB21C651E98DF25)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The weights' places of all one-grams and two-grams, and where each text's begin."""
    words = Words(texts, WORDS_AND_SIGNS)
    h = words.hash
    inner = np.ones(len(h), bool)
    starts = words.first[:-1]
    inner[starts[starts < len(h)]] = False
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & inner[1:]
    h = np.where(again, _REPEAT, h)
    pairs = mix(np.r_[np.zeros(1, np.uint64), h[:-1]][: len(h)] * _PAIR + h)
    both = np.empty(2 * len(h), np.uint64)
    both[0::2], both[1::2] = mix(h), pairs
    keep = np.ones(len(both), bool)
    keep[1::2] = inner
    places = (both[keep] >> np.uint64(64 - BITS)).astype(np.int32)
    counts = 2 * words.counts - (words.counts > 0)
    return places, np.concatenate([[0], np.cumsum(counts)])


class FollowTheLeader:
    """Per-coordinate follow-the-regularised-leader with both penalties; the last weight is the bias."""

    def __init__(self, n: int) -> None:
        self.z, self.n = np.zeros(n + 1), np.zeros(n + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def learned(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
    """The weights learned from rows of order, label, places and counts, taken by their order.

    Places and counts stay in the batches' buffers, four bytes a number; as Python objects they would take ten times that.
    """
    found = []
    for batch in batches:
        lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[2:]]
        for i, (order, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            found.append((order, y, *[values[ends[i] : ends[i + 1]] for values, ends in lists]))
    found.sort(key=lambda f: f[0])
    model = FollowTheLeader(1 << BITS)
    for _ in range(EPOCHS):
        for _, y, at, count in found:
            x = SCALE * count / max(1, int(count.sum(dtype=np.int64)))
            model.learn(np.append(at, 1 << BITS), np.append(x, 1.0), y)
    return model.weights(slice(None)).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """The weights learned from the labelled rows that ``train`` (over doc_id) admits."""
    ship_package(docs.sparkSession)
    chosen = labels.where(train & F.col(quoted(label)).isNotNull() & F.col("doc_id").isNotNull())
    # One row per id, so that no id counts twice: of labels that disagree the smaller one.
    chosen = chosen.groupBy("doc_id").agg(F.min(F.col(quoted(label)).cast("int")).alias("label")).withColumn("order", F.xxhash64("doc_id"))
    # Most of what can't be among the smallest hashes goes before rows are ordered.
    share = min(1.0, (1.2 * sample + 200) / max(1, chosen.count()))
    chosen = chosen.where(F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod("order", F.lit(1 << 30)), "order").limit(sample)
    # The sample is at most ``sample`` rows of three numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", F.xxhash64("text").alias("print"), "text")

    def vectors(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.column(3)):
                places, first = features(texts)
                found = [np.unique(places[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                ends = pa.array(np.cumsum([0, *[len(f[0]) for f in found]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]), pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=["order", "label", "print", "at", "count"])

    # Features are made where the texts are; of several rows with one id the text with the smallest hash counts, so the task below gets a vector per id.
    made = rows.mapInArrow(vectors, "order long, label int, print long, at array<int>, count array<int>")
    made = made.groupBy("order").agg(F.min("label").alias("label"), F.min_by(F.struct("at", "count"), "print").alias("x")).select("order", "label", "x.*")

    def train_on(batches):
        yield pa.RecordBatch.from_arrays([pa.array([learned(batches).tobytes()], pa.binary())], names=["weights"])

    # One task, one row: the sample's bound is the bound of both.
    fitted = made.repartition(1).mapInArrow(train_on, "weights binary").first()
    return np.frombuffer(fitted["weights"]) if fitted else np.zeros((1 << BITS) + 1)


def quality_scores(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every row and ``score``, from 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def work(texts: pa.Array) -> list[pa.Array]:
        w = shared.value
        places, first = features(texts)
        n = np.diff(first)
        sums = sums_by(w[places], first) * (SCALE / np.maximum(n, 1)) + w[-1]
        return [pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))]

    return map_texts(docs, keep or ["doc_id"], [T.StructField("score", T.DoubleType())], work)
