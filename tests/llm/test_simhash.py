"""Operator 7 against a comparison of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from feedloom.llm import simhash
from feedloom.llm.components import spanning_forest


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in names}


TEXTS = ["a b c", "A  b\tc", "a b", "", None, " \n", "é ÉÉ x\u00a0y z " * 40, "w" * 50000, "p q r s " * 30, "p q r s " * 31, "one"]


def test_fingerprints():
    got = simhash.fingerprints_of(pa.array(TEXTS, pa.string()), 3)
    assert got.tolist() == [brute_fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("tile", [2048, 3])
def test_links_connect_what_all_pairs_connect(spark, tile):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = {int(b) for b in base} | {0, (1 << 64) - 1, 1, 3, 7}
    for b in base[:10]:
        at = int(b)
        for _ in range(30):
            at ^= 1 << int(rng.integers(64))
            fps.add(at)
            fps.add(at ^ (1 << int(rng.integers(64))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = np.array([(r.a, r.b) for r in simhash.links(table, 2, tile).collect()], np.int64).view(np.uint64).tolist()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    want = brute_components(fps)
    same = {}
    for f in fps:
        same.setdefault(want[f], set()).add(find(f))
    assert all(len(s) == 1 for s in same.values()) and len({find(f) for f in fps}) == len(same)


def test_components(docs_of):
    pairs = list(enumerate([*TEXTS, *TEXTS, "p q r s " * 29 + "t"])) + [(3, "a b c"), (None, "only here"), (None, "")]
    got = simhash.near_duplicates(docs_of(pairs), ["doc_id", "n_words", "fp", "a b.c"]).collect()
    prints = {f: [i for i, t in pairs if brute_fingerprint(t) == f] for f in {brute_fingerprint(t) for _, t in pairs}}
    names, want = brute_components(prints), []
    for f, ids in prints.items():
        members = [i for g, m in prints.items() if names[g] == names[f] for i in m if i is not None]
        want += [(i, f, min(members) if members else None) for i in ids]
    assert sorted([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_spanning_forest():
    rng = np.random.default_rng(1)
    links = rng.integers(0, 400, (300, 2)) * 1_000_003
    forest = spanning_forest(links)
    assert len(np.unique(forest[:, 1])) == len(forest)
    root = {int(x): int(x) for x in np.unique(links)}
    for a, b in forest.tolist():
        root[b] = a
    assert all(root[a] == root[b] for a, b in links.tolist())
    assert len(spanning_forest(np.zeros((0, 2), np.int64))) == 0
