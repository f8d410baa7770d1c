"""Benchmark items beyond one automaton's alphabet, and more blocks than one scan takes."""

import random

from feedloom.llm import decontaminate


def rows_of(found):
    return sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items), tuple(map(tuple, r.hits)), r.contaminated) for r in found.collect())


def test_an_item_of_over_a_million_distinct_words(spark, docs_of):
    words = [f"w{i:x}" for i in range(1_100_000)]
    items = spark.createDataFrame([(5, " ".join(words)), (6, "a few words")], "item_id long, text string")
    inside = " ".join(words[549_990:550_010])
    across = " ".join(words[decontaminate.PART_WORDS - 6 : decontaminate.PART_WORDS + 6])
    docs = docs_of([(1, "x " + inside + " y"), (2, across), (3, " ".join(words[100:109])), (4, "A few, words"), (5, None), (6, " ".join(words[-10:]))])
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (22, 20, ["5"]), 2: (12, 12, ["5"]), 3: (9, 0, []), 4: (3, 3, ["6"]), 5: (0, 0, []), 6: (10, 10, ["5"])}


def test_twenty_blocks_are_as_one(spark, docs_of, monkeypatch):
    pick = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)]
    lines = [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 30))) for _ in range(60)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(2, lines[2]), (70, lines[3])], "item_id long, text string")
    docs = docs_of([(i, " , ".join(pick.sample(lines, 3)) if i % 3 else "v1 v2") for i in range(50)] + [(3, None)] * 2 + [(4, lines[3])] * 3)
    whole = rows_of(decontaminate.contamination(docs, items, ["doc_id", "n_words", "a b.c", "_row"]))
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", sum(map(len, lines)) // 20)
    assert rows_of(decontaminate.contamination(docs, items, ["doc_id", "n_words", "a b.c", "_row"])) == whole
    monkeypatch.setattr(decontaminate, "PART_WORDS", 3)
    assert rows_of(decontaminate.contamination(docs, items)) == whole
    monkeypatch.setattr(decontaminate, "_CODES", 40)
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 1_000_000)
    assert rows_of(decontaminate.contamination(docs, items)) == whole
