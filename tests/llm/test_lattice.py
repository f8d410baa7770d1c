"""Operator 10 against a plain recursion over all segmentations."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import lattice, queries


def by_hand(word, spelled, logs):
    """The probability of a word as a sum over all segmentations, and the expected counts."""
    n = len(word)
    ways = [(p, s) for p, s in enumerate(spelled)] + [(len(spelled) + b, bytes([b])) for b in range(256)]
    front, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i in range(n):
        for p, s in ways:
            if word.startswith(s, i):
                front[i + len(s)] += front[i] * math.exp(logs[p])
    for i in range(n - 1, -1, -1):
        for p, s in ways:
            if word.startswith(s, i):
                back[i] += math.exp(logs[p]) * back[i + len(s)]
    counts = np.zeros(len(logs))
    for i in range(n):
        for p, s in ways:
            if word.startswith(s, i):
                counts[p] += front[i] * math.exp(logs[p]) * back[i + len(s)] / front[n]
    return front[n], counts


def test_forward_and_expected_counts():
    rng = random.Random(3)
    spelled = ["▁a", "▁ab", "b", "ab", "é", "▁", "ba", "abé"]
    spelled = [s.encode() for s in spelled]
    logs = np.log(np.array([rng.random() for _ in range(len(spelled) + 256)]) / 99)
    model = lattice.Lattice(spelled, logs)
    words = [("▁" + "".join(rng.choice(["a", "b", "é", "𝄞"]) for _ in range(rng.randrange(0, 9)))).encode() for _ in range(40)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    weights = np.arange(40) + 1.0
    total, expected = model.forward(data, np.r_[0, ends[:-1]], ends, weights)
    hand = [by_hand(w, spelled, logs) for w in words]
    assert np.allclose(total, np.log([h[0] for h in hand]))
    assert np.allclose(expected, sum(c * w for (_, c), w in zip(hand, weights, strict=True)))


def test_long_words_and_chunks(monkeypatch):
    spelled, logs = lattice.read_pieces(queries.vocabulary_path(queries.PIECES))
    model = lattice.Lattice(spelled, logs - np.logaddexp.reduce(logs))
    words = pa.array([b"the", b"x" * 3000, b"", "é".encode(), b"the"], pa.binary())
    out = []
    for chunk in (1 << 19, 4):
        monkeypatch.setattr(lattice, "_CHUNK", chunk)
        score = np.zeros(len(words))
        for span, data, start, end in lattice._chunks(words):
            score[span] = model.forward(data, start, end)[0]
        out.append(score)
    assert np.allclose(*out) and np.isfinite(out).all() and out[0][0] == out[0][4]


DOCS = [(i, t) for i, t in enumerate(["The cat sat", "the CAT ran off", "a\tdog\nsat", None, "", "the the the zebra", "unseen wörds here", "x " * 300 + "y" * 2000, "cat dog cat", "The cat sat"])]
DOCS += [(3, "the cat"), (3, "the cat"), (3, "the cat"), (None, "null id cat"), (None, None), (40, "the dog"), (41, "one more"), (42, "zebra")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


@pytest.mark.parametrize("frequent", [131_072, 2])
def test_scores(docs_of, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    path = queries.vocabulary_path(queries.PIECES)
    group_of = lambda i: None if i is None or i % 3 == 2 else f"g{i % 3}"
    docs = docs_of(DOCS).withColumn("g", F.when(F.col("doc_id") % 3 == 0, "g0").when(F.col("doc_id") % 3 == 1, "g1"))
    got = lattice.text_scores(docs, ~queries.held_out(7), path, F.col("g")).collect()
    train = [(i, t) for i, t in DOCS if not held(i)]
    counts, by_group, ends = {}, {}, {}
    for i, t in train:
        g = group_of(i)
        ends[g] = ends.get(g, 0) + 1
        for w in words_of(t):
            counts[w] = counts.get(w, 0) + 1
            by_group.setdefault(g, {})[w] = by_group.get(g, {}).get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    spelled, logs = lattice.read_pieces(path)
    logs = logs - np.logaddexp.reduce(logs)
    marked = lambda w: "▁".encode() + w
    for _ in range(lattice.ROUNDS):
        model, sums = lattice.Lattice(spelled, logs), np.zeros(len(logs))
        for w in counts:
            data = np.frombuffer(marked(w), np.uint8)
            sums += model.forward(data, np.array([0]), np.array([len(data)]), np.ones(1))[1]
        total = sums.sum() + 0.001 * len(sums)
        logs = np.log((sums + 0.001) / (total + 1))
    model = lattice.Lattice(spelled, logs)

    def spell(w):
        data = np.frombuffer(marked(w), np.uint8)
        return math.exp(model.forward(data, np.array([0]), np.array([len(data)]))[0][0])

    want, d = [], lattice.DISCOUNT
    for i, t in DOCS:
        words, parts = words_of(t), []
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        for g, e in ends.items():
            tokens, kinds = e + sum(by_group.get(g, {}).values()), 1 + len(by_group.get(g, {}))
            p = math.log10(e / len(train)) + math.log10((e - d) / tokens + d * kinds / tokens * math.exp(-math.log(total + 1)))
            parts.append(p + sum(math.log10(max(by_group.get(g, {}).get(w, 0) - d, 0) / tokens + d * kinds / tokens * spell(w)) if spell(w) > 0 else -1e9 for w in words))
        best = max(parts)
        score = best + math.log10(sum(10 ** (p - best) for p in parts))
        want.append((i, len(words) + 1, sum(w in counts for w in words) + 1, n, base, score))
    key = lambda r: (repr(r[0]), r[1], r[2], round(r[4], 4))
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        if b[5] > -1e8:
            assert a[5] == pytest.approx(b[5], rel=1e-6)


def test_no_texts_and_no_training(docs_of):
    path = queries.vocabulary_path(queries.PIECES)
    assert lattice.text_scores(docs_of([]), F.lit(True), path).count() == 0
    rows = lattice.text_scores(docs_of([(1, "a b"), (2, None)]), F.lit(False), path, F.col("lang")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 3, 0, 0), (2, 1, 0, 0)} and all(math.isfinite(r.score) for r in rows)


def test_better_than_the_base_on_held_out_texts(spark):
    rows = queries.op10_lm_scores(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
