"""Operator 4 against a comparison of all windows."""

import random

from feedloom.llm import substring


def brute(pairs):
    last, first_of, out = (1 << 63) - 1, {}, []
    for i, t in pairs:
        words = (t or "").encode().split()
        for s in range(len(words) - 49):
            key = tuple(words[s : s + 50])
            first_of[key] = min(first_of.get(key, last), last if i is None else i)
    for i, t in pairs:
        words, gone = (t or "").encode().split(), set()
        for s in range(len(words) - 49):
            if first_of[tuple(words[s : s + 50])] < (last if i is None else i):
                gone |= set(range(s, s + 50))
        out.append((i, len(words), len(gone), b" ".join(w for p, w in enumerate(words) if p not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (49, 50, 51, 70, 130, 300)]
    docs = []
    for i in range(60):
        words = fresh(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(shared) + fresh(rng.choice([0, 1, 30]))
        if docs and rng.random() < 0.4:
            words = list(rng.choice(docs)[1].split())
            for _ in range(rng.randrange(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = "edit"
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    docs += [(100, "same word " * 200), (101, "same word " * 120), (102, "é " * 60), (103, "é " * 61), (103, "é " * 61), (103, "other " * 70), (None, "é " * 60), (None, "same word " * 90),
             (104, None), (105, ""), (106, "a b " * 55), (99, "a b " * 54), (98, " ".join(fresh(9000))), (1, docs[7][1]), (2, "é " * 60)]
    rng.shuffle(docs)
    return docs


def test_repeats_are_those_of_all_windows(docs_of):
    for seed in (1, 2):
        pairs = corpus(seed)
        got = substring.remove_repeats(docs_of(pairs), ["doc_id", "n_words", "a b.c", "_row"]).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr) == brute(pairs)
        assert all(sum(s.end - s.start for s in r.repeats) == r.n_removed and all(s.end - s.start >= 50 for s in r.repeats) for r in got)


def test_empty_table(docs_of):
    assert substring.remove_repeats(docs_of([])).count() == 0
    assert [r.kept for r in substring.remove_repeats(docs_of([(1, None)])).collect()] == [""]
