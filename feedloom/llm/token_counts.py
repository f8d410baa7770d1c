"""Token counts of whole texts: a shared table of frequent pre-token lengths, worker caches for the rest, no shuffle.

The tokenizer drops white space, reads A-Z as a-z, and parts letters and digits from signs, so a
text is cut into pre-tokens at ASCII white space and between an ASCII letter or digit and an ASCII sign; it has as many tokens
as its pre-tokens have together. Apostrophes (they begin endings of their own), the signs of the special
tokens, control characters and all beyond ASCII are never cut next to; pre-tokens with ``<`` keep their case.

Lengths of frequent pre-tokens (from the first rows of a few partitions; they
only decide what is fast) are broadcast as two arrays of at most ``FREQUENT`` entries;
each worker looks all pre-tokens of a run of texts up at once by 64-bit hash, encodes the distinct misses with
the library itself, and remembers up to ``CACHED`` of them.

Null and empty texts have no bytes and no tokens. Repeated rows each get their result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from feedloom.llm.words import LETTERS, UNSPACED, Table, Words, map_texts, mix, once, pieces, span_hash, sums_by

FREQUENT = 65_536
#: Tasks that look at texts for the table, and texts that each looks at.
SAMPLE_TASKS, SAMPLE_ROWS = 8, 256
CACHED = 1_000_000

_KINDS = np.where(LETTERS, 1, np.where(UNSPACED, 2, 0)).astype(np.uint8)
_KINDS[128:] = 3
_KINDS[[*b"'<|>"]] = 3
_KINDS[[c for c in [*range(32), 127] if UNSPACED[c]]] = 3
_CASED = np.uint64(0xC2B2AE3D27D4EB4F)

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


def _lengths(tokenizer: Tokenizer, words: list[str]) -> list[int]:
    # One by one: Spark has a worker per core, and the library's own threads only add to the time.
    return [len(tokenizer.encode(word, add_special_tokens=False)) for word in words]


def _tokenizer(vocabulary: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pre_tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The pre-tokens of some texts and a hash that tells pre-tokens of different lengths apart."""
    words = Words(texts, _KINDS, lower=True)
    h = words.hash
    cased = np.flatnonzero(words.data == ord("<"))
    if len(cased):
        at = np.unique(np.searchsorted(words.start, cased, side="right") - 1)
        h = h.copy()
        h[at] = mix(span_hash(words.data, words.start[at], words.end[at]) ^ _CASED)
    return words, h


def _spelled(words: Words, at: np.ndarray) -> list[str]:
    """Pre-tokens as they stand in their texts."""
    return [words.data[a:b].tobytes().decode() for a, b in zip(words.start[at], words.end[at], strict=True)]


class Lengths:
    """Token counts by pre-token hash: a table that doubles, and a small one for what came since."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        self.first = self.old = (Table(hashes), np.append(lengths, -1).astype(np.int64))
        self.new = (Table(hashes[:0]), np.full(1, -1, np.int64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The length of each pre-token, -1 where it isn't known."""
        out = self.old[1][self.old[0].find(h)]
        rest = np.flatnonzero(out < 0)
        out[rest] = self.new[1][self.new[0].find(h[rest])]
        return out

    def add(self, h: np.ndarray, lengths: np.ndarray) -> None:
        keys, values = np.concatenate([self.new[0].keys, h]), np.concatenate([self.new[1][:-1], lengths])
        if len(keys) > max(30_000, len(self.old[0].keys) // 3):
            old = self.first if len(self.old[0].keys) + len(keys) > CACHED else self.old
            keys, values = np.concatenate([old[0].keys, keys]), np.concatenate([old[1][:-1], values])
            keys, one = np.unique(keys, return_index=True)
            self.old, keys, values = (Table(keys), np.append(values[one], -1)), keys[:0], values[:0]
        self.new = Table(keys), np.append(values, -1).astype(np.int64)


def frequent(docs: DataFrame, vocabulary: str, entries: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the pre-tokens that a sample of the texts repeats most."""

    def count(batches):
        if TaskContext.get().partitionId() >= SAMPLE_TASKS:
            return
        tokenizer, left = _tokenizer(vocabulary), SAMPLE_ROWS
        for batch in batches:
            for _, texts in pieces(batch.slice(0, left), batch.column(0).slice(0, left)):
                words, h = _pre_tokens(texts)
                hashes, at, n = np.unique(h, return_index=True, return_counts=True)
                top = np.argsort(-n, kind="stable")[:entries]
                lengths = _lengths(tokenizer, _spelled(words, at[top]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[top].view(np.int64)), pa.array(lengths, pa.int32()), pa.array(n[top])], names=["hash", "tokens", "n"]
                )
            left -= batch.num_rows
            if left <= 0:
                return

    counted = docs.select("text").mapInArrow(count, "hash long, tokens int, n long").groupBy("hash", "tokens").agg(F.sum("n").alias("n"))
    # At most SAMPLE_TASKS tasks have rows, so the table is bounded before it is cut.
    table = counted.orderBy(F.desc("n"), "hash").limit(entries).toArrow()
    return table["hash"].to_numpy().view(np.uint64), table["tokens"].to_numpy()


def token_counts(docs: DataFrame, vocabulary_path: str, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the UTF-8 bytes and the tokens of its text, as the library for the vocabulary file counts them."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    context = docs.sparkSession.sparkContext
    # Lengths depend on the vocabulary alone, so a worker keeps one cache for it whatever the table.
    key, shared = hashlib.sha256(vocabulary.encode()).hexdigest(), context.broadcast((vocabulary, *frequent(docs, vocabulary)))

    def work(texts: pa.Array) -> list[pa.Array]:
        tokenizer, known = once(key, lambda: (_tokenizer(shared.value[0]), Lengths(*shared.value[1:])))
        words, h = _pre_tokens(texts)
        tokens = known.find(h)
        missed = np.flatnonzero(tokens < 0)
        if len(missed):
            new, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            spelled = _spelled(words, missed[one])
            # In runs, so that the library's own results for them stay small.
            lengths = np.concatenate([np.array(_lengths(tokenizer, spelled[i : i + 2048]), np.int64) for i in range(0, len(spelled), 2048)])
            known.add(new, lengths)
            tokens[missed] = lengths[back]
        return [pa.array(np.diff(words.offsets).astype(np.int64)), pa.array(sums_by(tokens, words.first).astype(np.int64))]

    return map_texts(docs, keep or ["doc_id"], FIELDS, work)
