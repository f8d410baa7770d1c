"""Chat formatting: render growing prefixes of a conversation, compare them, and so find each turn and its loss mask.

The template is a black box from turns to text. Rendering one turn more must leave
what was there before as it was; then the new part is that turn's span. Where it
doesn't, the template rewrites history and the conversation is marked so. Two more
renderings of the turn, with one-letter texts, show where inside the span its text
begins. All prefixes start at the first turn, whatever the number of turns, so a black-box template costs about
2 * n * n renderings of a turn for a conversation of n turns. A template that is an ``Appending`` renders each turn by itself, so its
prefixes grow by one part and cost what the text costs.

Turns are ordered by turn, then role, then text; nulls count as empty text, a null turn
comes first, a null role reads as empty. A null conv_id is a conversation of its own.
Repeated rows are turns of their own, equal rows in any order. Very long texts are rendered whole; a conversation is one text and so one task's work, and
only one is held at a time. An empty table gives no rows. Other columns than the four are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import ship_package

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|\|)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|\|)")
_MARKED = re.compile(r"<\|([^|]*)\|>(.*?)</s>", re.DOTALL)

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("loss", T.ArrayType(SPAN)), T.StructField("rewrites", T.BooleanType()),
])


def escape(text: str) -> str:
    """The text without control strings: each gets one backslash more behind its first character."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Appending:
    """A template that renders every turn by itself and puts the parts one behind the other."""

    def __init__(self, turn: Callable[[str, str], str]) -> None:
        self.turn = turn

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(self.turn(role, text) for role, text in turns)


def _marked(role: str, text: str) -> str:
    return f"<|{escape(role).replace('%', '%25').replace('|', '%7C')}|>{escape(text)}</s>"


def marked_turns(turns: list[Turn]) -> str:
    """The built-in template, a black box like any other: ``<|role|>``, the escaped text, ``</s>`` for each turn."""
    return "".join(_marked(role, text) for role, text in turns)


#: The same, known to append; for conversations of many thousands of turns.
appended_turns = Appending(_marked)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a text that the built-in template made."""
    return [(unescape(role.replace("%7C", "|").replace("%25", "%")), unescape(text)) for role, text in _MARKED.findall(formatted)]


def _common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The formatted text, each turn's span and the span of its text in it, and whether the template rewrites history."""
    found = _by_parts(turns, template) if isinstance(template, Appending) else _by_prefixes(turns, template)
    whole = template(turns)
    return (whole, *found, False) if found else (whole, [], [], True)


def _text_in(part: str, empty: str, a: str, b: str) -> tuple[int, int]:
    """Where a turn's text lies in its part, from the parts that an empty text and two one-letter texts make."""
    head = _common(a, b)
    return head, len(part) - (len(empty) - head)


def _by_parts(turns: list[Turn], template: Appending) -> tuple[list, list]:
    """The spans of turns and texts where each prefix is the one before and a part more."""
    spans, texts, at = [], [], 0
    for role, text in turns:
        part = template.turn(role, text)
        a, b = _text_in(part, *(template.turn(role, x) for x in ("", "a", "b")))
        spans.append((at, at + len(part)))
        texts.append((at + a, at + b))
        at += len(part)
    return spans, texts


def _by_prefixes(turns: list[Turn], template: Template) -> tuple[list, list] | None:
    """The spans of turns and texts from all prefixes; None where a turn more changes what was there before."""
    spans, texts, before = [], [], template([]) if not turns else ""
    for i, (role, _) in enumerate(turns):
        after = template(turns[: i + 1])
        if not after.startswith(before):
            return None
        at, part = len(before), after[len(before) :]
        a, b = _text_in(part, *(template([*turns[:i], (role, x)])[at:] for x in ("", "a", "b")))
        spans.append((at, len(after)))
        texts.append((at + a, at + b))
        before = after
    return spans, texts


def format_conversations(conversations: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: the formatted text, the spans of its turns, and the loss mask as spans of the trained texts (code points).

    Where the template rewrites history, ``rewrites`` is true and both lists are empty.
    Conversations are read in order from sorted partitions; only one is held at a time.
    """
    ship_package(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        made, size = [], 0
        for conv_id, turns in _grouped(batches):
            whole, spans, texts, rewrites = locate(turns, template)
            loss = [texts[i] for i, (role, _) in enumerate(turns) if role in loss_roles and not rewrites]
            made.append((conv_id, whole, _spans(spans), _spans(loss), rewrites))
            size += len(whole)
            if size > 1 << 22:
                yield _batch(made)
                made, size = [], 0
        if made:
            yield _batch(made)

    return parts.mapInArrow(run, SCHEMA)


def _spans(pairs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in pairs]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.string(), span, span, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)


def _grouped(batches) -> Iterator[tuple[int | None, list[Turn]]]:
    current, turns = None, []
    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if turns and conv_id != current:
                yield current, turns
                turns = []
            current = conv_id
            turns.append((role, text))
    if turns:
        yield current, turns


def digest(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation: what is read back from the text alone and from its loss mask, as counts and digests."""
    ship_package(formatted.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for conv_id, whole, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(whole)
                trained = "".join(unescape(whole[s["start"] : s["end"]]) for s in loss)
                all_turns = hashlib.sha256()
                for role, text in turns:
                    all_turns.update(f"{role}\n{text}\n".encode())
                out.append((conv_id, len(turns), all_turns.hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(whole)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=_DIGEST.names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, _DIGEST)


_DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])
