import random
import re

import pytest

from feedloom.llm import licenses

NOTICES = [
    "Licensed under the Apache License, Version 2.0.", "this file is licensed under the apache license 2 0", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the general public license version 3 or any later version",
    "Licensed under CC BY-NC 4.0.", "licensed under the Apache License", "MIT LICENSE", "the mit license and the mit license",
]


def brute(text):
    """Phrases and templates by regular expressions over the words."""
    words = licenses.words_of(text or "")
    covered, base, found, places = set(), set(), set(), []
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                base.add(label)
                covered.update(range(i, i + len(wanted)))
    for label, markup in licenses.TEMPLATES.items():
        pattern = re.compile(licenses.as_pattern(markup))
        for i in range(len(words)):
            fits = [n for n in range(1, licenses.longest(markup) + 1) if i + n <= len(words) and pattern.fullmatch("".join(w + " " for w in words[i : i + n]))]
            if fits:
                found.add(label)
                covered.update(range(i, i + max(fits)))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)),
        len(covered) / max(1, len(words)),
    )


def plain(markup, words="Some Holder"):
    """The wording with all optional parts and replaceable words filled in."""
    text = re.sub(r"<<var;[^>]*match=([^|>;]*)[^>]*>>", r"\1", markup)
    return re.sub(r"<<(begin|end)Optional>>", " ", re.sub(r"<<var;[^>]*words=[^>]*>>", words, text))


def scanned(docs):
    out = licenses.labelled(licenses.scan(docs), ["doc_id"])
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def test_scan_equals_brute_force(docs_of):
    pick = random.Random(2)
    filler = "the this license mit work is under copyright apache public general 2 0 word é".split()
    texts = [None, "", "...", *NOTICES, *(plain(m) for m in licenses.TEMPLATES.values())]
    mit = plain(licenses.TEMPLATES["mit-text"])
    texts += [mit.replace("KIND", "SORT"), mit.replace("Some Holder", ""), "Copyright " + "x " * 25 + mit, mit.split("THE SOFTWARE")[0]]
    for _ in range(120):
        parts = [pick.choice([*NOTICES, *filler, *filler, "\n"]) for _ in range(pick.randint(1, 30))]
        texts.append(" ".join(parts))
    got = scanned(docs_of(list(enumerate(texts))))
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(brute(text)) if text is None else got[i] == brute(text), text


def test_long_texts_and_repeated_beginnings(docs_of):
    texts = ["this " * 200_000, "copyright the " * 60_000, "a" * 1_500_000 + " mit license", ("word " * 50_000) + NOTICES[0]]
    got = scanned(docs_of(list(enumerate(texts))))
    assert got[0][:3] == (200_000, 0, None) and got[1][0] == 120_000
    assert got[2][:6] == (3, 1, 1, 1, "mit", "mit")
    assert got[3][4:6] == ("apache", "apache,apache-2.0-notice") and got[3][2] == 50_003


def test_mandatory_wording_and_regions():
    automaton = licenses.compiled({"t": "use <<var;name=n;words=0-2>> of <<beginOptional>>the <<beginOptional>>big<<endOptional>><<endOptional>> thing"})
    scanner = licenses.Scanner(automaton, sorted({*automaton.vocabulary()}))
    code = {w: i for i, w in enumerate(sorted({*automaton.vocabulary()}))}
    ends = lambda text: scanner.runs(__import__("numpy").array([code.get(w, -1) for w in text.split()]))
    assert ends("use of thing") == [(0, 0, 3)] and ends("use a b of the big thing") == [(0, 0, 7)]
    assert ends("use a b c of thing") == [] and ends("use of big thing") == [] and ends("use of the") == []
    for bad in ("<<beginOptional>>a<<endOptional>>", "<<var;name=x;words=1-2>> a", "<<beginOptional>>a", "a <<odd>> b"):
        with pytest.raises(ValueError):
            licenses.compiled({"bad": bad})


def test_repeated_rows_and_empty_table(docs_of):
    docs = docs_of([(1, NOTICES[0])] * 3 + [(None, NOTICES[2])])
    rows = licenses.scan(docs, ["doc_id", "a b.c", "found", "score"] if "found" in docs.columns else ["doc_id", "a b.c", "score"]).collect()
    assert [r["score"] for r in rows].count(1.0) == 4 and len(rows) == 4
    assert licenses.scan(docs.where("false")).collect() == []
