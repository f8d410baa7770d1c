"""Operators 5, 6 and 9 and the pipeline: held-out accuracy, recall, invariants and small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import ann, packing, quality, queries

SF = "/root/testdata/sf0.1"


def test_features_are_counted_per_text():
    texts = ["a a a b!", None, "", "x", "a b!! ## c"]
    places, first = quality.features(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [9, 0, 0, 1, 9] and len(places) == first[-1]
    alone = [quality.features(pa.array([t], pa.string()))[0].tolist() for t in texts]
    assert [places[first[i] : first[i + 1]].tolist() for i in range(5)] == alone


def test_held_out_quality(spark):
    scored = queries.op5_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = scored.where("held_out").select("score", "predicted", "quality").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 500 and right / len(rows) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.quality == 1 and r.predicted == 0 for r in rows) <= 0.01 * len(rows)


def test_quality_edges(spark, docs_of):
    docs = docs_of([(1, "fine words here"), (2, "bad!! bad!!"), (3, None), (4, ""), (None, "x"), (1, "fine words here"), (5, "long " * 100_000)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 0), (1, 1)], "doc_id long, quality int")
    weights = quality.fit(docs, labels, F.lit(True))
    got = quality.quality_scores(docs, weights, ["doc_id", "score", "a b.c"]).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and by[1] > by[2] and by[3] == by[4] and all(0 <= r.score <= 1 for r in got)
    assert (quality.fit(docs, labels, F.lit(True)) == weights).all()
    none = quality.fit(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs_of([]), weights).count() == 0


def brute_nearest(rows, k):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (v * v[i]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[i] * v[i]).sum()))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("lists", [200, 8])
def test_recall_and_scores(spark, monkeypatch, lists):
    monkeypatch.setattr(ann, "LIST_SIZE", lists)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 5)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    met = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert met >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(s == exact[q, i] for q in got for i, s in got[q].values() if (q, i) in exact)


def test_nearest_with_copies_and_bad_vectors(spark):
    rng = random.Random(4)
    hot = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, hot) for i in range(0, 700)] + [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(700, 1500)]
    bad = [(2000, None), (2050, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6), (2150, [float("nan")] * 8), (2200, [float("inf")] + [1.0] * 7), (2250, [1.0] * 3), (None, hot), (50, hot)]
    table = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, id string").repartition(5)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 1500, 50))
    for q in range(0, 700, 50):
        assert [i for _, i in sorted(got[q])] == [i for i in range(7) if i != q][:5]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    found = ann.nearest(few, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0 and ann.nearest(few.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [20_000, 7])
def test_packing(spark, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    rng = random.Random(9)
    sizes = [(i, rng.choice([0, 1, 3, 511, 512, 513, 700, 1025, 4096, 4097, 20_000, rng.randrange(1, 3000)])) for i in range(120)] + [(7, 50), (7, 50), (None, 60), (8, None)]
    docs = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id long, n_tokens long, bin_id string").repartition(4)
    rows = packing.pack(docs).collect()
    bins, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece_start, r.piece_tokens))
        if r.bin_id is None:
            assert r.piece_tokens == 0
        else:
            bins.setdefault(r.bin_id, []).append(r)
    for i in {i for i, _ in sizes}:
        assert sum(n for _, n in pieces[i]) == sum(n or 0 for j, n in sizes if j == i)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        used, at = sum(r.piece_tokens for r in held), 0
        for r in held:
            assert r.bin_offset == at
            at += r.piece_tokens
        assert {r.bin_size for r in held} == {min(n for n in packing.LENGTHS if n >= used)}
    once = {i: sorted(p) for i, p in pieces.items() if i not in (7, None)}
    assert all(a + n == b for p in once.values() for (a, n), (b, _) in zip(p, p[1:], strict=False))
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_is_no_worse_than_one_length():
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 1500) for _ in range(3000)), reverse=True)
    where, offset, fitted = packing.pack_block(sizes)
    assert len(where) == len(sizes)
    for length in (2048, 4096):
        _, _, held = packing._best_fit(sizes, (length,))
        assert sum(map(packing.cost, fitted)) <= len(held) * packing.cost(length)
    assert sum(sizes) / sum(fitted) > 0.97
    assert packing.pack_block([]) == ([], [], [])


def test_pipeline_stages(spark, tmp_path, docs_of):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = corpus_pipeline.quality_filter(spark, docs, sf)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert first.columns == docs.columns and sum(q == 1 and i not in kept for i, q in labels.items()) <= 3
    odd = docs_of([(1, "a b c d"), (2, "a b c d"), (3, None), (3, None), (4, ""), (None, "p q r"), (5, "zz " * 60), (6, "yy " + "zz " * 59)])
    near = corpus_pipeline.near_dedup(spark, odd, sf)
    assert near.columns == odd.columns and {1, 3} <= {r.doc_id for r in near.collect()} and not {2, 4} & {r.doc_id for r in near.collect()}
    assert near.count() == len({(r.doc_id, r.text) for r in near.collect()})
    cut = corpus_pipeline.repeats_removed(spark, odd, sf)
    by = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == odd.columns and by[6].text == "yy" and by[6].n_chars == 2 and by[5].text == "zz " * 60 and by[1].n_words == "x"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    leaked = docs_of([(1, "before " + item.upper() + " after"), (2, "clean"), (3, None)])
    clean = corpus_pipeline.decontaminated(spark, leaked, sf)
    assert clean.columns == leaked.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.packed(spark, leaked, sf).collect()) == [1, 2, 3]
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near_dedup"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
