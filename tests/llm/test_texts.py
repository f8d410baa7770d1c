"""Operators 1, 2, 3 and 8 against plain Python."""

import functools
import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import chat, decontaminate, queries, token_counts, urls
from feedloom.llm.words import LETTERS, UNSPACED, Table, Words, span_hash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t-1\u00a0𝄞", max_size=12)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((LETTERS, WORD), (UNSPACED, SPACED)):
        words = Words(pa.array(texts, pa.string()), table, lower=True)
        got = [[words.bytes_of(w).decode() for w in range(words.first[t], words.first[t + 1])] for t in range(len(texts))]
        assert got == [pattern.findall((t or "").translate(LOW)) for t in texts]
        named = {}
        for w in range(len(words)):
            named.setdefault(words.bytes_of(w), set()).add(int(words.hash[w]))
        assert all(len(h) == 1 for h in named.values()) and len({*map(frozenset, named.values())}) == len(named)


def test_hash_does_not_depend_on_the_place():
    long = "x" * 1_200_000
    words = Words(pa.array([f"a {long} b", f"b {long}", "a"]), UNSPACED)
    assert words.hash[0] == words.hash[5] and words.hash[1] == words.hash[4] and words.hash[2] == words.hash[3]
    table = Table(words.hash[:3])
    assert table.find(words.hash).tolist() == [0, 1, 2, 2, 1, 0]
    assert len(span_hash(words.data, words.start[:0], words.end[:0])) == 0


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOW))
        for at in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[at : at + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, ids = WORD.findall((text or "").translate(LOW)), set(), set()
        for at in range(len(words)):
            for n in range(1, 11):
                if (key := tuple(words[at : at + n])) in windows and at + n <= len(words):
                    hit |= set(range(at, at + n))
                    ids |= windows[key]
        out.append((doc, len(words), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven."), (2, "short Étude"), (3, None), (4, "..."), (5, "short étude"), (5, "short étude"), (None, "zz")]
HITS = [
    (1, "xx ONE two-three four; five six seven eight nine ten eleven yy"), (2, "one two three four five six seven eight nine"),
    (3, None), (4, ""), (5, "a short Étude b"), (5, "a short Étude b"), (6, "short étude short étude"), (None, "two three four five six seven eight nine ten eleven"),
    (7, "zz " + "filler " * 20000 + "short Étude"),
]


def test_contamination(spark, docs_of, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute_hits(HITS, [i for i in ITEMS if i[0] is not None])
    for chars in (4_000_000, 20):
        monkeypatch.setattr(decontaminate, "ITEM_CHARS", chars)
        rows = decontaminate.contamination(docs_of(HITS), items, ["doc_id", "text", "n_words", "a b.c"]).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows], key=repr) == want
    for r in rows:
        hit = [r.text[s.start : s.end] for s in r.hits]
        assert sum(len(WORD.findall(h.translate(LOW))) for h in hit) == r.n_hit
    assert ["short Étude"] in [[r.text[s.start : s.end] for s in r.hits] for r in rows]
    assert decontaminate.contamination(docs_of([]), items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs_of(HITS), items.where("false")).collect()} == {0}


TOKENS = [(1, "Hello, world it's"), (2, None), (3, ""), (4, "  \n "), (5, "<|endoftext|>a<|startoftext|> b<|endoftext|> <|ENDOFTEXT|>"), (6, "e\u0301 É\u00a0x ΑΣ 123 don't"), (6, "𝄞 \x00 x"), (None, "word " * 5000 + "y" * 30000)]


def test_token_counts(docs_of, monkeypatch):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path(queries.WORD_BPE)
    library = Tokenizer.from_file(path)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TOKENS), key=repr)
    for cached in (300_000, 1):
        monkeypatch.setattr(token_counts, "CACHED", cached)
        got = token_counts.token_counts(docs_of(TOKENS), path, ["doc_id", "a b.c"]).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=repr) == want
    assert token_counts.token_counts(docs_of([]), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "re", "'", "'s", "1", "!", "=", "\u0338", "é", "e\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", "—", " ", "\u00a0", "\x1c", "\x00", "ß", "Σ", "İ", "½"]), max_size=9).map("".join), max_size=4))
def test_pre_tokens_have_the_texts_tokens(texts):
    tokenizer = library()
    words, _ = token_counts._pre_tokens(pa.array(texts, pa.string()))
    spelled = token_counts._spelled(words, slice(None))
    got = [sum(token_counts._lengths(tokenizer, spelled[words.first[t] : words.first[t + 1]])) for t in range(len(texts))]
    assert got == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path(queries.WORD_BPE))


def test_token_counts_of_the_tables(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path(queries.WORD_BPE))
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (n, n > 2048)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us|%7C<\\>/\n", max_size=6), st.lists(st.sampled_from(["<", "s>", "/", "\\", "[", "INST]", "|", "é", "</s>", "\n", "<|"]), max_size=8).map("".join)), max_size=6))
def test_template_is_reversible_and_located(turns):
    whole, spans, texts, rewrites = chat.locate(turns, chat.marked_turns)
    assert not rewrites and chat.read_back(whole) == turns
    assert [chat.unescape(whole[a:b]) for a, b in texts] == [t for _, t in turns]
    assert "".join(whole[a:b] for a, b in spans) == whole


def test_long_conversations_and_history():
    turns = [("user", f"t{i}") for i in range(100)]
    whole, spans, texts, rewrites = chat.locate(turns, chat.marked_turns)
    assert not rewrites and [whole[a:b] for a, b in texts] == [t for _, t in turns] and len(spans) == 100
    counted = lambda some: "".join(f"{len(some)}{t}" for _, t in some)
    last_only = lambda some: "".join(f"<{t if i == len(some) - 1 else ''}>" for i, (_, t) in enumerate(some))
    far_back = lambda some: "".join(f"<{t}{'!' if i >= 40 else ''}>" for i, (_, t) in enumerate(some))
    at_fifty = lambda some: "".join(f"<{t.upper() if len(some) == 50 else t}>" for _, t in some)
    for template in (counted, last_only, at_fifty):
        assert chat.locate(turns, template)[3]
    whole, _, texts, rewrites = chat.locate(turns, far_back)
    assert not rewrites and [whole[a:b].rstrip("!") for a, b in texts] == [t for _, t in turns]
    assert chat.locate([], chat.marked_turns) == ("", [], [], False)


def test_conversations(spark):
    rows = [(1, 0, "user", "a<s>"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "assistant", "n"), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
            (2, 0, "system", "é\n"), (2, 1, "assistant", "</s>[INST] ok [/INST]"), (3, None, "a|%\n<|", "")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] or -1, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(table)).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == len(chat.marked_turns(turns))
    assert chat.format_conversations(table.where("false")).count() == 0


URLS = ["http://a.EXAMPLE.org/es/x?q", "https://example.org/en/12", "https://example.org/en/2", "x://badexample.org/es/", "http://org/", "http://org", None, "", "nourl",
        "a://b://example.org/es/", "http://s.com/de/1#f", "http://s.com/fr", "http://s.com/fr/", "http://éx.example.org/es/\n", "http://user@x.com:80/de/", "http://" + "a." * 3000 + "com/de/" + "p" * 20000]


def brute_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    rows = [(i // 2, u, "h") for i, u in enumerate(URLS * 2)] + [(None, URLS[0], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(pages, urls.rule_table(spark, urls.RULES), ["page_id", "host"]).collect()
    want = sorted([(i, *brute_verdict(u)) for i, u, _ in rows], key=repr)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], key=repr) == want
    assert urls.judge(pages.where("false"), urls.rule_table(spark, urls.RULES)).count() == 0
    assert {r.rule for r in urls.judge(pages, urls.rule_table(spark, urls.RULES).where("false")).collect()} == {None}
