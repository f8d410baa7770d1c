"""Inversions, batch mixes and batches of one shape against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from feedloom.operators import batching, inversions


def plain(rows):
    rows = [r for r in rows if None not in r]
    return sum(1 for a in rows for b in rows if a[0] < b[0] and a[1] > b[1])


def test_merge_count():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7, 64, 100, 257):
        for spread in (1, 3, 1000):
            values = [rng.randrange(spread) for _ in range(n)]
            assert inversions.count_turned(np.array(values, dtype=np.int64)) == plain(list(enumerate(values)))


@pytest.mark.parametrize("bits", [2, 4, 18])
def test_every_pair_is_counted_once(spark, bits):
    rng = random.Random(2)
    ids = list(range(150))
    orders = {
        "same": ids, "back": ids[::-1], None: rng.sample(ids, 150), "blocks": [(i // 10 * 70 % 150) + i % 10 for i in ids],
        "wide": rng.sample(range(1 << 20), 150), "one": [5],
    }
    rows = [(m, i, p) for m, places in orders.items() for i, p in enumerate(places)]
    holes = [("same", None, 3), ("back", 900, None)]
    frame = spark.createDataFrame(rows + holes, "method string, id long, pos long").repartition(5)
    got = {r.method: r for r in inversions.order_inversions(frame, ["method"], bits=bits).collect()}
    for method, places in orders.items():
        want = plain(list(enumerate(places)))
        assert (got[method].n, int(got[method].inversions)) == (len(places), want)
    assert got["same"].turned_share == 0 and got["back"].turned_share == 1 and got["one"].turned_share is None


def test_counted_rows_grow_as_the_rows(spark, monkeypatch):
    """What is summed along the id ranges is a few rows per row, however many id and position ranges there are."""
    n, met, window = 4096, [], inversions.bucketed_window

    def watched(df, *args, **more):
        met.append(df.count())
        return window(df, *args, **more)

    monkeypatch.setattr(inversions, "bucketed_window", watched)
    places = random.Random(6).sample(range(n), n)
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(places)], "id long, pos long")
    (got,) = inversions.order_inversions(frame, [], bits=1).collect()
    assert int(got.inversions) == inversions.count_turned(np.array(places)) and 0 < sum(met) <= 4 * n


def test_repeated_ids_and_no_keys(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(40)) for _ in range(120)]
    frame = spark.createDataFrame(rows, "id long, pos long")
    (got,) = inversions.order_inversions(frame, [], bits=3).collect()
    assert int(got.inversions) == plain(rows) and got.n == 120


def test_empty_orders(spark):
    frame = spark.createDataFrame([], "method string, id long, pos long")
    assert inversions.order_inversions(frame, ["method"]).collect() == []


def test_batch_mix(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 2, None]), rng.choice(["a", "b", "c", None])) for _ in range(200)] + [(7, "a")]
    got = {r.batch: r for r in inversions.batch_mix(spark.createDataFrame(rows, "batch int, lang string"), "batch", "lang").collect()}
    whole = Counter(l for _, l in rows)
    assert set(got) == {b for b, _ in rows}
    for batch in got:
        own = Counter(l for b, l in rows if b == batch)
        n = sum(own.values())
        want = sum(abs(own[l] / n - whole[l] / len(rows)) for l in whole) / 2
        assert got[batch].mix_distance == pytest.approx(want, abs=1e-6) and got[batch].n_rows == n and got[batch].n_labels == len(own)


@pytest.mark.parametrize("size", [1, 4, 500])
def test_shape_batches(spark, size):
    rng = random.Random(5)
    shapes = [rng.choice(["8x8", "8x8", "8x8", "4x4", "9x9", None]) for _ in range(203)]
    rows = [(p, s) for p, s in enumerate(shapes)]
    frame = spark.createDataFrame(rows, "pos long, shape string").repartition(4)
    got = {r.pos: r for r in batching.shape_batches(frame, "shape", size).collect()}
    filling, done, want = {}, [], {}
    for pos, shape in rows:
        filling.setdefault(shape, []).append(pos)
        if len(filling[shape]) == size:
            done.append(filling.pop(shape))
    for number, batch in enumerate(done):
        want.update(dict.fromkeys(batch, (number, False)))
    for place, pos in enumerate(sorted(p for left in filling.values() for p in left)):
        want[pos] = (len(done) + place // size, True)
    assert {p: (r.batch_id, r.resize) for p, r in got.items()} == want
