import numpy as np
import pytest

from feedloom.operators import greedy


def plain(rows, limit):
    shards = []
    for ident, n in sorted(rows):
        n = n or 0
        if shards and shards[-1][1] + n <= limit:
            s = shards[-1]
            shards[-1] = (s[0] + 1, s[1] + n, s[2], ident)
        else:
            shards.append((1, n, ident, ident))
    return [(i, *s) for i, s in enumerate(shards)]


def got(spark, rows, limit, bits):
    sizes = spark.createDataFrame(rows, "__id__ long, bytes long").repartition(3)
    return sorted(tuple(r) for r in greedy.greedy_manifest(sizes, "__id__", "bytes", limit, bits).collect())


def cases():
    rng = np.random.default_rng(5)
    yield [(i, 10) for i in range(100)], 35
    yield [(i, int(n)) for i, n in enumerate(rng.integers(0, 40, 300))], 100
    yield [(i, 0) for i in range(50)] + [(50, 200), (51, 0), (52, 1)], 100
    yield [(i, 1000 if i % 7 == 3 else 1) for i in range(120)], 100
    yield [(i, 1) for i in range(200)], 10_000
    yield [(i, [51, 50, 49][i % 3]) for i in range(150)], 100
    yield [(i * 37 - 3000, int(n)) for i, n in enumerate(rng.integers(0, 5000, 150))], 6000
    yield [(i, None if i % 5 else 60) for i in range(60)], 0
    yield [(7, 5)], 3


@pytest.mark.parametrize("case", range(9))
def test_equal_to_the_plain_rule(spark, case):
    rows, limit = list(cases())[case]
    assert got(spark, rows, limit, 4) == plain(rows, limit)


def test_one_range_and_no_rows(spark):
    rows, limit = list(cases())[1]
    assert got(spark, rows, limit, 18) == plain(rows, limit)
    assert got(spark, [], 10, 4) == []
    assert got(spark, [(None, 5)], 10, 4) == []


def test_composition_is_the_steps_of_both():
    rng = np.random.default_rng(9)
    for _ in range(300):
        limit = int(rng.integers(0, 60))
        sizes = [rng.integers(0, rng.integers(2, 80), rng.integers(1, 12)) for _ in range(4)]
        steps = [greedy.steps_of(s, limit) for s in sizes]
        one = steps[0].then(steps[1]).then(steps[2].then(steps[3]))
        brought = np.arange(0, 120)
        leaves, cuts = brought, np.zeros(120, np.int64)
        for s in steps:
            leaves, more = s(leaves)
            cuts = cuts + more
        assert (one(brought)[0] == leaves).all() and (one(brought)[1] == cuts).all()
        for b in range(0, 120, 7):
            open_, begun = b, 0
            for n in np.concatenate(sizes).tolist():
                open_, begun = (open_ + n, begun) if open_ + n <= limit else (n, begun + 1)
            assert (leaves[b], cuts[b]) == (open_, begun)


def test_tables_stay_small():
    sizes = np.ones(100_000, np.int64)
    steps = greedy.steps_of(sizes, 50)
    assert len(steps.above) <= 52
    for _ in range(12):
        steps = steps.then(steps)
        assert len(steps.above) <= 60
