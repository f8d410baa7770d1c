"""License scans: template markup compiled into one token automaton, run over whole texts.

A template is wording with two marks: ``<<beginOptional>> ... <<endOptional>>`` around what may be left
out, and ``<<var;name=x;words=0-20>>`` (any words) or ``<<var;name=x;match=a|b>>`` (one of these words)
for what may be replaced. Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters, so signs,
line breaks and case don't matter. Every word of the wording becomes a place of the automaton, a region of up to
n words n places; optional regions add ways around. A text is accepted where the mandatory words
follow one another exactly. The scan starts only at words that can begin a template, and state sets met
once are kept as single states. From each beginning the longest accepted run of each template counts.

``score`` is the share of the text's words inside accepted runs and named phrases.

Null and empty texts have no words, no labels and score 0. Very long texts are read whole; a run never reads
on beyond its template's longest form. Labels are a set, so ties and repeated rows need no rule; repeated rows each get their
result. An empty table gives no rows. A kept column that has the name of a result gives way to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.words import LETTERS, Table, Words, map_texts, once, sums_by

#: Names of licenses, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The wording of license notices and texts, by label.
TEMPLATES = {
    "apache-2.0-notice": "<<beginOptional>>This <<var;name=what;match=work|file|program|software>> is<<endOptional>> Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0",
    "mit-notice": "<<var;name=verb;match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "gpl-3-notice": "<<beginOptional>>This <<var;name=what;match=work|file|program|software>> is<<endOptional>> licensed under the <<beginOptional>>GNU<<endOptional>> General Public License, version 3 <<beginOptional>>or <<beginOptional>>any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>>",
    "cc-by-nc-notice": "<<beginOptional>>This <<var;name=what;match=work|file|text>> is<<endOptional>> Licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<var;name=version;match=1|2|3|4>>.0",
    "mit-text": """
        <<beginOptional>><<beginOptional>>The<<endOptional>> MIT License<<endOptional>> <<beginOptional>>Copyright <<var;name=holder;words=0-20>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
        shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1-20>> BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies""",
}

_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text: str) -> str:
    return text.encode().lower().decode()


def words_of(text: str) -> list[str]:
    return _WORD.findall(_lower(text))


@dataclass(frozen=True)
class Region:
    """``least`` to ``most`` words, any ones if ``words`` is empty."""

    least: int
    most: int
    words: tuple[str, ...] = ()


def parse(markup: str) -> list:
    """A template as words, regions, and lists for optional parts."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        stack[-1] += words_of(markup[at : mark.start() if mark else len(markup)])
        if mark is None:
            break
        kind, *rest = [x.strip() for x in mark.group(1).split(";")]
        facts = dict(x.split("=", 1) for x in rest if "=" in x)
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional" and len(stack) > 1:
            part = stack.pop()
            stack[-1].append(part)
        elif kind == "var" and "match" in facts:
            stack[-1].append(Region(1, 1, tuple(w for x in facts["match"].split("|") for w in words_of(x))))
        elif kind == "var" and "words" in facts:
            least, most = map(int, facts["words"].split("-"))
            stack[-1].append(Region(least, most))
        else:
            raise ValueError(f"unknown mark <<{mark.group(1)}>>")
        at = mark.end()
    if len(stack) > 1:
        raise ValueError("an optional region has no end")
    return stack[0]


@dataclass
class Automaton:
    """All templates' places as bits of one number; place 0 is where a run begins."""

    takes: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    follows: list[int] = field(default_factory=lambda: [0])
    labels: list[str] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def _place(self, words: tuple[str, ...], before: set[int]) -> int:
        self.takes.append(words)
        self.follows.append(0)
        place = len(self.takes) - 1
        for p in before:
            self.follows[p] |= 1 << place
        return place

    def _chain(self, parts: list, before: set[int]) -> set[int]:
        """Adds the parts behind the given places; returns the places after which they are over."""
        for part in parts:
            if isinstance(part, list):
                before = before | self._chain(part, before)
            elif isinstance(part, Region):
                over = set(before) if part.least == 0 else set()
                for i in range(part.most):
                    before = {self._place(part.words, before)}
                    if i + 1 >= part.least:
                        over |= before
                before = over
            else:
                before = {self._place((part,), before)}
        return before

    def add(self, label: str, markup: str) -> None:
        known = len(self.takes)
        ends = self._chain(parse(markup), {0})
        starts = [p for p in range(known, len(self.takes)) if self.follows[0] >> p & 1]
        if 0 in ends or not all(self.takes[p] for p in starts):
            raise ValueError(f"{label}: a template begins with a word and has mandatory wording")
        self.labels.append(label)
        self.ends.append(sum(1 << p for p in ends))

    def vocabulary(self) -> list[str]:
        return sorted({w for words in self.takes for w in words})


def compiled(templates: dict[str, str]) -> Automaton:
    automaton = Automaton()
    for label, markup in templates.items():
        automaton.add(label, markup)
    return automaton


class Scanner:
    """Runs an automaton over arrays of word codes (-1: a word that no template has)."""

    _MOST_STATES = 50_000

    def __init__(self, automaton: Automaton, words: list[str]) -> None:
        self.automaton = automaton
        code = {w: i for i, w in enumerate(words)}
        anything = sum(1 << p for p, w in enumerate(automaton.takes) if not w and p)
        self.admits = {c: anything for c in range(-1, len(words))}
        for p, taken in enumerate(automaton.takes):
            for w in taken:
                self.admits[code[w]] |= 1 << p
        self.begins = np.array([bool(self.admits[c] & automaton.follows[0]) for c in range(len(words))] + [False])
        self.steps: dict[tuple[int, int], int] = {}
        self.over: dict[int, tuple[int, ...]] = {}

    def step(self, places: int, code: int) -> int:
        key = (places, code)
        if key not in self.steps:
            if len(self.steps) >= self._MOST_STATES:
                self.steps.clear()
                self.over.clear()
            after, rest = 0, places
            while rest:
                low = rest & -rest
                after |= self.automaton.follows[low.bit_length() - 1]
                rest ^= low
            self.steps[key] = after & self.admits[code]
        return self.steps[key]

    def accepted(self, places: int) -> tuple[int, ...]:
        if places not in self.over:
            self.over[places] = tuple(i for i, ends in enumerate(self.automaton.ends) if places & ends)
        return self.over[places]

    def runs(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """The longest accepted run of each template from each word that begins one: (template, first word, end)."""
        found = []
        line = codes.tolist()
        for begin in np.flatnonzero(self.begins[codes]).tolist():
            places, at, longest = 1, begin, {}
            while at < len(line) and (places := self.step(places, line[at])):
                at += 1
                for template in self.accepted(places):
                    longest[template] = at
            found += [(template, begin, end) for template, end in longest.items()]
        return found


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType()),
]


def scan(
    docs: DataFrame, keep: list[str] | None = None, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, text: str = "text"
) -> DataFrame:
    """Per row: its words, the places of named phrases, the labels by phrase (``base``) and by both (``found``), and the score."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    named = [(words_of(phrase), label) for phrase, label in phrases.items()]
    key = f"licenses-{hash((tuple(templates.items()), tuple(phrases.items())))}"

    def prepared() -> tuple[Scanner, Table, list[tuple[list[int], str]]]:
        automaton = compiled(templates)
        vocabulary = sorted({*automaton.vocabulary(), *(w for words, _ in named for w in words)})
        code = {w: i for i, w in enumerate(vocabulary)}
        table = Table(Words(pa.array(vocabulary, pa.large_string()), LETTERS, lower=True).hash)
        return Scanner(automaton, vocabulary), table, [([code[w] for w in words], label) for words, label in named]

    def work(texts: pa.Array) -> list[pa.Array]:
        scanner, table, wanted = once(key, prepared)
        words = Words(texts, LETTERS, lower=True)
        codes, counts = table.find(words.hash), words.counts
        owner = np.repeat(np.arange(len(texts)), counts)
        edges, n_base = np.zeros(len(codes) + 1, np.int64), np.zeros(len(codes), np.int64)
        base: list[set[str]] = [set() for _ in range(len(texts))]
        for wording, label in wanted:
            k = len(wording)
            places = np.ones(max(0, len(codes) - k + 1), bool)
            for i, c in enumerate(wording):
                places &= codes[i : len(codes) - k + 1 + i] == c
            places = np.flatnonzero(places & (owner[: len(places)] == owner[k - 1 :][: len(places)]))
            np.add.at(n_base, places, 1)
            np.add.at(edges, places, 1)
            np.add.at(edges, places + k, -1)
            for t in np.unique(owner[places]).tolist():
                base[t].add(label)
        found = [set(b) for b in base]
        for t in np.unique(owner[scanner.begins[codes]]).tolist():
            a = words.first[t]
            for template, begin, end in scanner.runs(codes[a : words.first[t + 1]]):
                found[t].add(scanner.automaton.labels[template])
                edges[a + begin] += 1
                edges[a + end] -= 1
        covered = sums_by((np.cumsum(edges)[:-1] > 0).astype(np.int64), words.first)
        named_at = np.flatnonzero(n_base)
        lo, hi = np.searchsorted(named_at, words.first[:-1]), np.searchsorted(named_at, words.first[1:])
        none = lo == hi
        first, last = (np.where(none, 0, np.append(named_at, 0)[np.minimum(i, len(named_at))] - words.first[:-1]) for i in (lo, hi - 1))
        return [
            pa.array(counts.astype(np.int64)), pa.array(sums_by(n_base, words.first)), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
            *(pa.array([sorted(x) for x in labels], pa.list_(pa.string())) for labels in (base, found)), pa.array(covered / np.maximum(counts, 1)),
        ]

    return map_texts(docs, keep or ["doc_id"], FIELDS, work, text)


def labelled(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """The scan's results with both label sets as comma-joined text."""
    joined = [F.array_join("base", ",").alias("base_labels"), F.array_join("found", ",").alias("labels")]
    return scanned.select(*keep, "n_words", "n_base", "first_word", "last_word", *joined, "score")


def as_pattern(markup: str) -> str:
    """A template as a regular expression over words that each have a space behind them."""

    def of(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, list):
                out += f"(?:{of(part)})?"
            elif isinstance(part, Region):
                word = f"(?:{'|'.join(part.words)}) " if part.words else "[^ ]+ "
                out += f"(?:{word}){{{part.least},{part.most}}}"
            else:
                out += part + " "
        return out

    return of(parse(markup))


def longest(markup: str) -> int:
    """The most words of a template."""

    def of(part) -> int:
        return sum(map(of, part)) if isinstance(part, list) else part.most if isinstance(part, Region) else 1

    return of(parse(markup))


def beginnings(markup: str) -> list[str]:
    """The words that a template can begin with."""
    automaton = compiled({"": markup})
    return sorted({w for p, words in enumerate(automaton.takes) if automaton.follows[0] >> p & 1 for w in words})
