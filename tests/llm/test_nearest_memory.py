import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_search_of_all_lists_holds_little():
    rng = np.random.default_rng(1)
    graph, vectors = ann.Centroids(unit(rng.normal(size=(2048, 64)))), unit(rng.normal(size=(256, 64)))
    assert peak_mb(lambda: graph.within(vectors, 9.0)) < 120  # 700 when 512 vectors searched together whatever their width


def best_of(q, q_ids, reach, v, ids, lists, centroids, k):
    score = (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1))
    probed = np.sqrt(np.maximum(2 - 2 * (unit(q) @ centroids.T), 0)) <= reach[:, None]
    out = {}
    for i in range(len(q)):
        may = [j for j in range(len(v)) if ids[j] != q_ids[i] and any(x >= 0 and probed[i, x] for x in lists[j])]
        out[int(q_ids[i])] = [int(ids[j]) for j in sorted(may, key=lambda j: (-round(score[i, j], 12), ids[j]))[:k]]
    return out


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_groups_find_the_best_rows_of_the_lists_in_reach(kind, monkeypatch):
    monkeypatch.setattr(ann, "_ROWS", 16)
    monkeypatch.setattr(ann, "_PAIRS", 7)
    rng = np.random.default_rng(2)
    centroids, k = unit(rng.normal(size=(30, 8))), 4
    v = (rng.normal(size=(300, 8)) * rng.choice([1e-3, 1, 1e6], (300, 1))).astype(kind)
    v[40:160] = v[40]
    lists = rng.integers(-1, 30, (300, ann.COPIES)).astype(np.int32)
    lists[:, 0] = np.sort(np.abs(lists[:, 0]))
    ids = rng.permutation(300).astype(np.int64) - 100
    q = np.concatenate([v[::9], rng.normal(size=(10, 8)).astype(kind)])
    q_ids = np.concatenate([ids[::9], np.arange(1000, 1010)])
    reach = rng.choice([0.3, 0.9, 1.2, np.inf], len(q))
    group = ann.Group(centroids, k)
    for at in range(0, 300, 23):
        group.add(lists[at : at + 23], ids[at : at + 23], v[at : at + 23])
    got = {int(i): [] for i in q_ids}
    for i, j, _ in zip(*group.search(q_ids, q, reach), strict=True):
        got[int(i)].append(int(j))
    assert got == best_of(q.astype(float), q_ids, reach, v.astype(float), ids, lists, centroids, k)


def test_a_query_on_its_centroid_searches_its_own_list():
    rng = np.random.default_rng(6)
    centroids = unit(rng.normal(size=(40, 64)))
    lists = np.full((40 * 3, ann.COPIES), -1, np.int32)
    lists[:, 0] = np.repeat(np.arange(40), 3)
    v = np.repeat(centroids, 3, axis=0) * 3.7
    group = ann.Group(centroids, 2)
    group.add(lists, np.arange(120), v)
    q, vec, _ = group.search(np.arange(120), v, np.full(120, 1e-12), lists[:, 0])
    assert sorted(zip(q.tolist(), vec.tolist(), strict=True)) == [(i, j) for i in range(120) for j in range(i // 3 * 3, i // 3 * 3 + 3) if i != j]


def test_rows_that_only_share_a_mark_stay():
    v = np.repeat(np.arange(1, 4, dtype=np.float32)[:, None] * np.ones((1, 4), np.float32), 5, axis=0)
    lists, ids = np.zeros((15, ann.COPIES), np.int32), np.arange(15)[::-1].copy()
    assert sorted(ids[ann._first_of_same(lists, ids, v, 2)]) == [0, 1, 5, 6, 10, 11]
    other = lists.copy()
    other[::5] = 1
    assert sorted(ids[ann._first_of_same(other, ids, v, 2)]) == [0, 1, 4, 5, 6, 9, 10, 11, 14]


def test_memory_follows_the_group_and_not_the_queries():
    rng = np.random.default_rng(3)
    centroids = unit(rng.normal(size=(40, 32)))
    shared = type("Shared", (), {"value": centroids})
    hot = rng.normal(size=(1, 32)).astype(np.float32)

    def batch(side, first, m):
        n = len(m)
        whole = lambda x, size: pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(x.ravel()))
        lists = np.tile(np.arange(ann.COPIES, dtype=np.int32), (n, 1))
        columns = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, side, np.int8)), pa.array(np.zeros(n, np.int64)), whole(lists, ann.COPIES),
                   pa.array(np.full(n, 9.0)), pa.array(np.arange(first, first + n)), whole(m, 32)]
        return pa.RecordBatch.from_arrays(columns, names=["group", "side", "first", "lists", "reach", "id", "v"])

    def rows():
        for i in range(2):
            yield batch(0, 4000 * i, np.where(np.arange(4000)[:, None] % 2, hot, rng.normal(size=(4000, 32)).astype(np.float32)))
        for i in range(50):
            yield batch(1, 10_000 + 4000 * i, np.repeat(hot, 4000, 0))

    def run():
        n = 0
        for found in ann._search_groups(5, 32, shared)(rows()):
            n += found.num_rows
            assert found["vec_id"].to_pylist()[:5] == [1, 3, 5, 7, 9]
        assert n == 50 * 4000 * 5

    assert peak_mb(run) < 60  # the queries alone are 51 MB in double precision, their ties with rows a thousand times that


def test_many_groups_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ann, "LIST_SIZE", 20)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 12)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = []
    for size in (1, 40, 900):
        monkeypatch.setattr(ann, "GROUP_BYTES", 48 * size)
        found.append(sorted(map(tuple, ann.nearest(table, F.col("vec_id") % 50 == 0, 5).collect())))
    assert len(found[0]) == 18 * 5 and found[0] == found[1] == found[2]
