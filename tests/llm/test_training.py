"""The classifier's learner and the packing against plain Python, hot ids, and other partitionings."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.llm import chat, packing, quality


def plain_learner(rows, bits=quality.BITS):
    """Follow-the-regularised-leader coordinate by coordinate, over (label, {place: value}) rows."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for y, x in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def vector(text):
    places, _ = quality.features(pa.array([text], pa.string()))
    counts = Counter(places.tolist())
    total = max(1, len(places))
    return {**{i: quality.SCALE * c / total for i, c in counts.items()}, 1 << quality.BITS: 1.0}


def labelled(n=60):
    pick = random.Random(1)
    texts = [" ".join(pick.choice("good fine words here and there".split() if i % 2 else "bad!! spam $$ buy now".split()) for _ in range(20)) for i in range(n)]
    return list(enumerate(texts)), [(i, i % 2) for i in range(n)]


def test_weights_are_those_of_a_plain_learner(spark, docs_of):
    docs, labels = labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.fit(docs_of(docs), table, F.lit(True))
    order = {r.doc_id: r.h for r in table.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = plain_learner([(y, vector(docs[i][1])) for i, y in sorted(labels, key=lambda r: order[r[0]])])
    dense = np.zeros(len(got))
    for i, w in want.items():
        dense[i] = w
    assert np.allclose(got, dense, rtol=1e-9, atol=1e-12) and (got != 0).sum() > 10


def test_vectors_to_learn_from_stay_in_their_buffers():
    n, each = 60, 40_000
    pick = np.random.default_rng(5)
    ends, places = pa.array(range(0, n * each + 1, each), pa.int32()), np.tile(np.arange(0, 6 * each, 6, dtype=np.int32), n)
    columns = [pa.array(range(n)), pa.array([i % 2 for i in range(n)]), *[pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (places, pick.integers(1, 900, n * each))]]
    batch = pa.RecordBatch.from_arrays(columns, names=["order", "label", "at", "count"])
    tracemalloc.start()
    weights = quality.learned([batch.slice(30), batch.slice(0, 30)])
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # 2.4 million places with their counts, the learner's own arrays among it; as Python numbers they took 126 MB.
    assert most < 40e6 and (weights == quality.learned([batch])).all() and (weights != 0).sum() > 1000


def test_a_hot_id_is_learned_from_once(spark, docs_of):
    docs, labels = labelled()
    once = quality.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    hot = [(7, docs[7][1])] * 40
    again = quality.fit(docs_of(docs + hot, 7), spark.createDataFrame(labels * 3, "doc_id long, quality int"), F.lit(True))
    assert (once == again).all()
    other = docs_of(docs + [(7, f"other text {k}") for k in range(30)], 5)
    assert (quality.fit(other, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
            == quality.fit(other.repartition(2), spark.createDataFrame(labels[::-1], "doc_id long, quality int"), F.lit(True))).all()


def test_packing_does_not_follow_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    pick = random.Random(2)
    rows = [(pick.choice([None, i, i, i]), pick.choice([None, 0, 5000, 9000, *range(1, 900, 7)])) for i in range(300)] + [(3, 100)] * 60
    tables = [spark.createDataFrame(r, "doc_id long, n_tokens long").repartition(p) for r, p in ((rows, 1), (rows[::-1], 5), (rows, 9))]
    packed = [sorted(packing.pack(t).collect(), key=repr) for t in tables]
    assert packed[0] == packed[1] == packed[2]
    assert sum(r.piece_tokens for r in packed[0]) == sum(n or 0 for _, n in rows)


def best_cost(sizes, lengths):
    """The least cost of any split of the sizes into bins."""
    best = {0: 0.0}
    n = len(sizes)
    fits = {}
    for mask in range(1, 1 << n):
        held = sum(s for i, s in enumerate(sizes) if mask >> i & 1)
        if held <= lengths[-1]:
            fits[mask] = packing.cost(next(length for length in lengths if length >= held))
    for mask in range(1, 1 << n):
        low, options, part = mask & -mask, [], mask
        while part:
            if part & low and part in fits:
                options.append(fits[part] + best[mask ^ part])
            part = (part - 1) & mask
        best[mask] = min(options)
    return best[(1 << n) - 1]


def test_small_blocks_are_near_the_optimum():
    pick, lengths, ratios = random.Random(4), packing.LENGTHS, []
    for _ in range(60):
        sizes = sorted((pick.randint(1, 3000) for _ in range(pick.randint(1, 8))), reverse=True)
        where, offset, fitted = packing.pack_block(sizes, lengths)
        for b, length in enumerate(fitted):
            inside = sorted((offset[i], s) for i, s in enumerate(sizes) if where[i] == b)
            assert sum(s for _, s in inside) <= length and all(x[0] + x[1] == y[0] for x, y in zip(inside, inside[1:], strict=False))
        ratios.append(sum(map(packing.cost, fitted)) / best_cost(sizes, lengths))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.06


def test_templates_that_look_at_place_or_start():
    for n in (33, 100):
        turns = [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
        numbered = lambda some: "".join(f"Turn {i + 1}: {t}\n" for i, (_, t) in enumerate(some))

        def strict(some):
            if some and some[0][0] != "user":
                raise ValueError("a conversation starts with the user")
            return "".join(f"[{r}]{t}[/]" for r, t in some)

        for template in (numbered, strict, chat.Appending(lambda r, t: f"<{r}>{t}</>")):
            whole, spans, texts, rewrites = chat.locate(turns, template)
            assert not rewrites and [whole[a:b] for a, b in texts] == [t for _, t in turns]
            assert "".join(whole[a:b] for a, b in spans) == whole


def test_parts_and_prefixes_agree():
    turns = [(("user", "assistant")[i % 2], f"t{i}</s>|") for i in range(60)]
    assert chat.locate(turns, chat.marked_turns) == chat.locate(turns, chat.appended_turns)
    many = turns * 500
    whole, _, texts, rewrites = chat.locate(many, chat.appended_turns)
    assert not rewrites and [chat.unescape(whole[a:b]) for a, b in texts[-3:]] == [t for _, t in many[-3:]]


def test_lists_within_a_ratio_are_all_found():
    from feedloom.llm import ann

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for n in (1, 2, 5, 60, 3000):
        points, vectors = unit(rng.normal(size=(n, 16))), unit(rng.normal(size=(40, 16)))
        graph = ann.Centroids(points)
        far = np.sqrt(2 - 2 * (vectors @ points.T))
        for ratio, most in ((1.0, None), (1.3, None), (9.0, None), (1.1, 4)):
            row, found = graph.within(vectors, ratio, most)
            want = [set(np.flatnonzero(f <= f.min() * ratio + 1e-9)) for f in far]
            got = [set(found[row == i].tolist()) for i in range(40)]
            assert len(row) == len(set(zip(row.tolist(), found.tolist(), strict=True)))
            if most is None:
                assert sum(len(g & w) for g, w in zip(got, want, strict=True)) >= 0.95 * sum(map(len, want))
            assert all(1 <= len(g) <= (most or n) for g in got)


def test_the_fitted_ratio_prunes_where_there_is_structure():
    from feedloom.llm import ann

    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    middles = rng.normal(size=(40, 32))
    sample = unit(np.repeat(middles, 100, 0) + 0.2 * rng.normal(size=(4000, 32)))
    centroids = ann.balanced_centroids(sample, 64)
    ratio = ann.fitted_ratio(sample, centroids, 5)
    row, _ = ann.Centroids(centroids).within(sample[::10], ratio)
    assert len(row) / 400 < 64 / 4
    assert ann.fitted_ratio(sample[:1], centroids[:1], 5) == 1.0
