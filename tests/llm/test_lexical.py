import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(docs, items, top=50):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all, l_all = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 50 + (50 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(out, key=repr)


def some(n, seed, longest=40):
    pick = random.Random(seed)
    vocabulary = [f"w{int(pick.paretovariate(0.7))}" for _ in range(300)] + ["The", "É", "漢字"]
    return [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, longest)))) for i in range(n)]


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("top", [1, 7, 50])
def test_search_equals_brute_force(spark, docs_of, monkeypatch, top):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 100)
    monkeypatch.setattr(lexical, "FIRST_DEPTH", 2)
    docs = some(900, 1) + [(None, "w1 w2 w3"), (901, None), (902, ""), (903, "w2 " * 60_000), (904, "W1 w1 THE the"), (905, "W1 w1 THE the")]
    items = some(12, 2, 25) + [(100, None), (101, ""), (102, "nowhere found"), (103, "w1 w1 w1"), (None, "w2 w5"), (103, "the")]
    found = got(lexical.ranked(docs_of(docs, 5), items_of(spark, items), top))
    assert found == brute(docs, [i for i in items if i[1] is not None], top)


def test_ties_repeated_rows_and_blocks(spark, docs_of):
    docs = [(i, "alpha beta") for i in range(90, 0, -1)] + [(500, "alpha gamma")] * 70 + some(50, 4)
    items = [(1, "alpha"), (1, "alpha"), (2, "beta gamma"), (3, "w1 alpha")]
    whole = got(lexical.ranked(docs_of(docs, 4), items_of(spark, items)))
    assert whole == brute(docs, items)
    assert got(lexical.ranked(docs_of(docs, 9), items_of(spark, items), item_chars=6)) == whole


def test_empty_tables(spark, docs_of):
    items = items_of(spark, [(1, "a b")])
    assert got(lexical.ranked(docs_of([(1, "x")]).where("false"), items)) == []
    assert got(lexical.ranked(docs_of([(1, "a")]), items.where("false"))) == []
    assert got(lexical.ranked(docs_of([(1, None), (2, "")]), items)) == []


def test_lists_are_left_early():
    """With a limit from earlier shards, what can't reach it is not read to the end."""
    rng = np.random.default_rng(0)
    n, terms = 20_000, 6
    docs = np.concatenate([rng.permutation(n) for _ in range(terms)])
    codes = np.repeat(np.arange(terms), n)
    shard = lexical.Shard(codes, docs, rng.integers(1, 1000, n * terms), n)
    totals = np.zeros(n, np.int64)
    np.add.at(totals, shard.docs, shard.impact)
    found, score = shard.search(np.arange(terms), 50, 1)
    assert set(np.argsort(-totals)[:50].tolist()) <= set(found.tolist()) and (totals[found] == score).all()
    reads = []
    repeat = np.repeat
    try:
        np.repeat = lambda a, size: reads.append(int(np.sum(size))) or repeat(a, size)
        none, _ = shard.search(np.arange(terms), 50, terms * 1000)
    finally:
        np.repeat = repeat
    assert len(none) == 0 and max(reads) < n
