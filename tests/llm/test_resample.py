import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least=20, seed=42, b=10_000):
    s, t = np.zeros(b, int), np.zeros(b, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs_of(text)[1]:
                counts[zlib.crc32(f.encode()) % b] += 1
    gain = [math.floor(1000 * math.log((float(t[i]) + 1) * (float(s.sum()) + b) / ((float(s[i]) + 1) * (float(t.sum()) + b)))) for i in range(b)]
    rows = []
    for i, text in docs:
        words, features = runs_of(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % b] for f in features)
        rows.append((i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    n = percent * len(able) // 100
    drawn = [(*r, k + 1) for k, r in enumerate(able[:n])] + [(*r, None) for r in able[n:]] + [(*r, None) for r in rows if r[1] < least]
    return sorted(drawn, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


def some_docs(n, seed=3):
    pick = random.Random(seed)
    return [(i, " ".join(pick.choice("ab Cd ef, gh x9 zzz é 漢字".split()) for _ in range(pick.randint(0, 60)))) for i in range(n)]


def test_buckets_are_crcs_of_whole_words():
    pick = random.Random(1)
    texts = ["", None, "a b c", "Hello, World é漢字 " + "z" * 500 + " y " + "漢" * 300 + " q", " ".join("k" * pick.randint(1, 90) for _ in range(300))]
    words, found = resample.feature_buckets(pa.array(texts))
    flat = [w for t in texts for w in runs_of(t)[0]]
    assert len(flat) == len(words)
    for k, (at, bucket) in enumerate(found, 1):
        assert [zlib.crc32(" ".join(flat[a : a + k]).encode()) % 10_000 for a in at.tolist()] == bucket.tolist()
    assert [len(a) for a, _ in found] == [sum(max(0, len(runs_of(t)[0]) - k + 1) for t in texts) for k in (1, 2, 3)]


def test_draw_equals_brute_force(spark, docs_of):
    docs = some_docs(400) + [(None, "null id " * 30), (401, None), (402, ""), (403, "x" * 200_000), (404, "word " * 70_000)]
    target = ["ab cd ef", "gh x9 zzz zzz", None, ""]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    frame = docs_of(docs)
    out = resample.resample(frame, goal, keep=["doc_id", "a b.c", "score", "_row", "lang"])
    assert out.columns == ["doc_id", "a b.c", "_row", "lang", "n_words", "n_features", "weight", "score", "rank"]
    assert got(out) == brute(docs, target)
    for percent in (0, 1, 50, 100):
        assert got(resample.resample(frame, goal, percent=percent)) == brute(docs, target, percent)


def test_repeated_rows_share_ranks_out(spark, docs_of):
    docs = [(7, "same words " * 15)] * 300 + some_docs(100)
    out = got(resample.resample(docs_of(docs, 7), spark.createDataFrame([(1, "same words")], "item_id long, text string"), percent=20))
    ranks = sorted(r[5] for r in out if r[5])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 20 * sum(r[1] >= 20 for r in out) // 100
    assert out == brute(docs, ["same words"], 20)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = some_docs(60)
    assert got(resample.resample(docs_of(docs), none)) == brute(docs, [])
    assert got(resample.resample(docs_of([(1, None)]).where("false"), none)) == []


@pytest.mark.parametrize("parts", [1, 5, 12])
def test_kth_key_of_skewed_partitions(spark, parts):
    pick = random.Random(parts)
    rows = [(pick.choice([0, 0, 0, pick.randint(-50, 50)]), pick.randint(0, 400)) for _ in range(1500)]
    keys = spark.createDataFrame(rows, "a long, b long").repartition(parts, F.col("a"))
    ordered = sorted(rows)
    for k in (1, 2, 700, 1499, 1500):
        assert resample.kth_key(keys, k) == ordered[k - 1]
    with pytest.raises(ValueError):
        resample.kth_key(keys, 1501)


def test_rounds_discard_a_quarter_each():
    pick = np.random.default_rng(5)
    parts = [np.sort(pick.integers(0, 1 << 40, n)) for n in (1, 3, 400, 5000, 17)]
    total = sum(map(len, parts))
    pivot = resample._weighted_median([((int(p[(len(p) - 1) // 2]),), len(p)) for p in parts])[0]
    below, above = sum(int((p < pivot).sum()) for p in parts), sum(int((p > pivot).sum()) for p in parts)
    assert max(below, above) <= 0.75 * total + len(parts)
