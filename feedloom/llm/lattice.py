"""Language-model scores: the marginal probability of a text over all its segmentations into subwords.

The pieces are those of an existing subword vocabulary; their scores there are ranks, which
give the first probabilities (one over one more than the rank), and ``ROUNDS`` rounds of expectation
maximisation over the words of all training texts refine them, in which each distinct word counts once. A text is its
words (lower-cased A-Z, ASCII white space between) and an end; no piece crosses words, so its probability
is the product over words of the sum over all segmentations, by forward recursion in log space
over bytes. Single bytes are pieces as well, so every text has a probability above zero. A word seen in
training may also be taken whole: that segmentation has the word's discounted share, and all
others together have what the discount (``DISCOUNT`` per distinct word) leaves.

Where training texts come in groups (such as languages), shares are learned per group, and a
text's probability is the sum over groups; the group of a text is never looked at to score it.

Words are counted over all training texts and each distinct word is segmented once. Values of the
``FREQUENT`` commonest words travel to the workers as a table; the rest meets the texts in a
join whose keys are all rare. The base is the add-one unigram model over whole words.

Null and empty texts have just the end. A null id is trained on unless the rule says otherwise. Repeated rows count
as often as they stand and each get their result. An empty table gives no rows; without training texts all
counts are zero.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import UNSPACED, Table, Words, between, gather, once, pieces, prefix_sums, quoted, span_hash, sums_by
from feedloom.session import settle, ship_package

FREQUENT = 131_072
ROUNDS = 2
DISCOUNT = 0.6
#: Groups with shares of their own, the largest ones; further groups share one more.
GROUPS = 8
_MARK = "▁"
_LN10 = np.log(10.0)
_LAST = (1 << 63) - 1
_CHUNK = 1 << 19


def read_pieces(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a vocabulary file that can stand in a word, the 256 bytes behind them, and their first log weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    spelled, ranks = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        if plain and _MARK not in piece[1:] and not any(c in " \t\n\v\f\r" for c in piece):
            spelled.append(piece.encode())
            ranks.append(abs(model.get_score(i)))
    worst = max(ranks, default=0.0) + 1
    return spelled, -np.log1p(np.array(ranks + [worst] * 256))


class Lattice:
    """Pieces with log probabilities, the last 256 of them the single bytes."""

    def __init__(self, spelled: list[bytes], logs: np.ndarray) -> None:
        self.logs, self.n = np.asarray(logs, np.float64), len(spelled)
        sizes = np.array([len(s) for s in spelled], np.int64)
        ends = np.cumsum(sizes)
        self.table = Table(span_hash(np.frombuffer(b"".join(spelled), np.uint8), ends - sizes, ends)) if spelled else Table(np.zeros(0, np.uint64))
        self.sizes = sorted(set(sizes.tolist()))

    def _edges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Edges grouped by where they end and how long they are: from-state, to-state, piece, and the groups' bounds."""
        sums, word = prefix_sums(data), np.repeat(np.arange(len(start)), end - start)
        place = np.arange(len(data))
        left, ahead = place - start[word], end[word] - place
        found = [(place, np.ones(len(place), np.int64), data.astype(np.int64) + self.n)]
        for size in self.sizes:
            at = place[ahead >= size]
            if not len(at):
                break
            piece = self.table.find(between(sums, at, at + size))
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), size, np.int64), piece[hit].astype(np.int64)))
        at, size, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        # A one-byte piece and its byte edge end at the same state, so they are in groups of their own.
        group = ((left[at] + size) * 1024 + size) * 2 + (piece >= self.n)
        order = np.argsort(group, kind="stable")
        at, size, piece, group = at[order], size[order], piece[order], group[order]
        source = at + word[at]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
        return source, source + size, piece, bounds

    def forward(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The log probability of each span of ``data`` (they follow one another without gaps); with weights, also every piece's expected count."""
        source, target, piece, bounds = self._edges(data, start, end)
        logs, n = self.logs[piece], len(start)
        first, last = start + np.arange(n), end + np.arange(n)
        alpha = np.full(len(data) + n, -np.inf)
        alpha[first] = 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            to = target[a:b]
            alpha[to] = np.logaddexp(alpha[to], alpha[source[a:b]] + logs[a:b])
        total = alpha[last]
        if weights is None:
            return total, None
        beta = np.full(len(data) + n, -np.inf)
        beta[last] = 0.0
        for a, b in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
            at = source[a:b]
            beta[at] = np.logaddexp(beta[at], beta[target[a:b]] + logs[a:b])
        word = np.searchsorted(first, source, side="right") - 1
        share = np.exp(alpha[source] + logs + beta[target] - total[word]) * weights[word]
        return total, np.bincount(piece, share, len(self.logs))


def _chunks(words: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of words, each behind the mark that begins a word, as bytes with starts and ends."""
    mark, at = np.frombuffer(_MARK.encode(), np.uint8), 0
    sizes = pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + len(mark))
    while at < len(words):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK)))
        spelled = b"".join(_MARK.encode() + w for w in words.slice(at, to - at).to_pylist())
        end = ends[at:to] - base
        yield slice(at, to), np.frombuffer(spelled, np.uint8), np.concatenate([[0], end[:-1]]), end
        at = to


def word_counts(docs: DataFrame, group: Column, groups: int, text: str = "text") -> DataFrame:
    """Every distinct word of the texts: its hash, its bytes, how often it stands in training texts of each group (c0, c1, ...) and in all (n).

    ``group`` numbers the training texts' groups and is below zero for texts not trained on.
    """
    columns = [f"c{z}" for z in range(groups)]

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, batch.column(0)):
                words = Words(texts, UNSPACED, lower=True)
                if not len(words):
                    continue
                of = np.repeat(part.column(1).to_numpy().astype(np.int64), words.counts)
                hashes, one, at, n = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
                c = np.bincount(at * (groups + 1) + of + 1, minlength=len(n) * (groups + 1)).reshape(len(n), groups + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), gather(words, one), *[pa.array(c[:, z + 1].astype(np.int64)) for z in range(groups)], pa.array(n.astype(np.int64))],
                    names=["hash", "word", *columns, "n"],
                )

    rows = docs.select(F.col(quoted(text)).alias("text"), group.cast("int").alias("group"))
    counted = rows.mapInArrow(run, "hash long, word binary, " + ", ".join(f"{c} long" for c in columns) + ", n long")
    return counted.groupBy("hash", "word").agg(*[F.sum(c).alias(c) for c in [*columns, "n"]]).withColumn("c", sum(F.col(c) for c in columns))


def trained_logs(words: DataFrame, spelled: list[bytes], logs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, fitted to the counted words."""
    context = words.sparkSession.sparkContext
    logs = logs - np.logaddexp.reduce(logs)
    # A word counts once however often it stands: pieces must spell new words, not repeat known ones.
    counted, total = words.where("c > 0").select("word", F.lit(1.0).alias("weight")), 0.0
    for _ in range(rounds):
        key, shared = uuid.uuid4().hex, context.broadcast((spelled, logs))

        def run(batches, key=key, shared=shared):
            lattice, sums = once(key, lambda: Lattice(*shared.value)), np.zeros(len(shared.value[1]))
            for batch in batches:
                weights = batch.column(1).to_numpy()
                for span, data, start, end in _chunks(batch.column(0)):
                    sums += lattice.forward(data, start, end, weights[span])[1]
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["piece", "expected"])

        # One row per piece of the vocabulary at most.
        expected = counted.mapInArrow(run, "piece long, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).toArrow()
        sums = np.zeros(len(logs))
        sums[expected["piece"].to_numpy()] = expected["expected"].to_numpy()
        # A thousandth of a count for every piece keeps the unseen ones possible.
        total = sums.sum() + 0.001 * len(sums)
        logs = np.log((sums + 0.001) / (total + 1))
    return logs, float(-np.log(total + 1))


def _groups(docs: DataFrame, train: Column, group: Column | None) -> tuple[Column, list[int]]:
    """The number of each training text's group (below zero: not trained on), and the training texts of every group."""
    trained = F.coalesce(train, F.lit(True))
    if group is None:
        return F.when(trained, 0).otherwise(-1), [docs.where(trained).count()]
    sizes = docs.where(trained).groupBy(group.cast("string").alias("name")).count().orderBy(F.desc("count"), "name")
    named = [(r["name"], r["count"]) for r in sizes.where("name IS NOT NULL").limit(GROUPS).collect()]
    number = F.lit(len(named))
    for z, (name, _) in enumerate(named):
        number = F.when(group.cast("string") == name, z).otherwise(number)
    rest = docs.where(trained).count() - sum(n for _, n in named)
    return F.when(trained, number).otherwise(-1), [*[n for _, n in named], rest]


def _most_frequent(values: DataFrame) -> DataFrame:
    """The words whose counts lie in the highest classes that hold ``FREQUENT`` words together at most."""
    # Counts fall into 32 classes per doubling, so about 2,000 at most come to the driver.
    values = values.withColumn("height", F.floor(F.log2("n") * 32).cast("int"))
    least, held = 1 << 30, 0
    for height, size in sorted(((r["height"], r["count"]) for r in values.groupBy("height").count().collect()), reverse=True):
        held += size
        if held > FREQUENT:
            break
        least = height
    return values.where(F.col("height") >= least).drop("height")


def text_scores(
    docs: DataFrame, train: Column, model_path: str, group: Column | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and score."""
    session = docs.sparkSession
    context = session.sparkContext
    ship_package(session)
    number, ends = _groups(docs, train, group)
    groups = range(len(ends))
    words = settle(word_counts(docs, number, len(ends), text), "words")
    sums = words.agg(F.count(F.when(F.col("c") > 0, 1)), *[F.coalesce(F.sum(f"c{z}"), F.lit(0)) for z in groups], *[F.count(F.when(F.col(f"c{z}") > 0, 1)) for z in groups]).first()
    all_ends = sum(ends)
    tokens = np.array([sums[1 + z] + ends[z] for z in groups], np.float64)
    kinds = np.array([sums[1 + len(ends) + z] + (ends[z] > 0) for z in groups], np.float64)
    n_train, distinct = int(tokens.sum()), sums[0] + (all_ends > 0)
    # What the discount leaves goes to the segmentations; a group without texts has nothing else.
    left = np.divide(DISCOUNT * kinds, tokens, out=np.ones(len(ends)), where=tokens > 0)
    whole = lambda c: np.divide(np.maximum(c - DISCOUNT, 0), tokens, out=np.zeros_like(c), where=tokens > 0)
    spelled, first = read_pieces(model_path)
    logs, end_log = trained_logs(words, spelled, first)
    key, shared = uuid.uuid4().hex, context.broadcast((spelled, logs))
    columns, shares = [f"c{z}" for z in groups], [f"s{z}" for z in groups]

    def measure(batches):
        lattice = once(key, lambda: Lattice(*shared.value))
        for batch in batches:
            apart = np.empty(batch.num_rows)
            for span, data, start, end in _chunks(batch.column(1)):
                apart[span] = lattice.forward(data, start, end)[0]
            c = np.stack([batch.column(4 + z).to_numpy() for z in groups], 1).astype(np.float64)
            with np.errstate(divide="ignore"):
                score = np.logaddexp(np.log(whole(c)), np.log(left) + apart[:, None]) / _LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *map(pa.array, score.T)], names=["hash", "c", "n", *shares])

    listed = words.select("hash", "word", "c", "n", *columns)
    values = settle(listed.mapInArrow(measure, "hash long, c long, n long, " + ", ".join(f"{s} double" for s in shares)), "word-values")
    top = _most_frequent(values).toArrow()
    at_end = whole(np.array(ends, np.float64)) + left * np.exp(end_log)
    common = (*(top[c].to_numpy() for c in ("hash", "c")), np.stack([top[s].to_numpy() for s in shares]))
    common_key, held = uuid.uuid4().hex, context.broadcast((*common, all_ends, np.log10(at_end)))

    def spread(batches):
        hashes, c, scores, ends, end_scores = held.value
        table = once(common_key, lambda: Table(hashes.view(np.uint64)))
        known = np.append(c > 0, False).astype(np.int64)
        base, scores = np.append(np.log10(c + 1.0), 0.0), [np.append(s, 0.0) for s in scores]
        for batch in batches:
            for part, texts in pieces(batch, batch.column(2)):
                some = Words(texts, UNSPACED, lower=True)
                at, rows = table.find(some.hash), len(texts)
                per_text = [
                    some.counts.astype(np.int64) + 1,
                    sums_by(known[at], some.first) + int(ends > 0),
                    sums_by(base[at], some.first) + np.log10(ends + 1.0),
                    *[sums_by(s[at], some.first) + e for s, e in zip(scores, end_scores, strict=True)],
                ]
                # Words without a place in the table, once per text; and a row for the text itself.
                missed = np.flatnonzero(at < 0)
                of = np.repeat(np.arange(rows), some.counts)[missed]
                order = np.lexsort((some.hash[missed], of))
                h, of = some.hash[missed][order], of[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(h)])
                row = pa.array(np.concatenate([np.arange(rows), of[new]]))
                zeros = np.zeros(len(new))
                own = part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row),
                     pa.array(np.concatenate([own, h[new].view(np.int64)])), pa.array(np.concatenate([np.zeros(rows, np.int64), n])),
                     *[pa.array(np.concatenate([x, zeros.astype(x.dtype)])) for x in (np.ones(rows, np.int64), *per_text)]],
                    names=["doc", "print", "hash", "m", "copies", "tokens", "known", "base", *shares],
                )

    doc = F.coalesce(F.col(quoted(id_column)).cast("long"), F.lit(_LAST)).alias("doc")
    rows = docs.select(doc, F.xxhash64(F.col(quoted(text))).alias("print"), F.col(quoted(text)).alias("text"))
    schema = "doc long, print long, hash long, m long, copies long, tokens long, known long, base double, " + ", ".join(f"{s} double" for s in shares)
    worth = values.select("hash", F.col("c").alias("wc"), *[F.col(s).alias(f"w{s}") for s in shares])
    met = rows.mapInArrow(spread, schema).join(worth, "hash", "left")
    times = lambda x: F.col("m") * F.when(F.col("m") > 0, x).otherwise(0)
    rated = met.select(
        "doc", "print", "copies", "tokens", (F.col("known") + times((F.col("wc") > 0).cast("long"))).alias("known"),
        (F.col("base") + times(F.log10(F.col("wc") + 1.0))).alias("base"), *[(F.col(s) + times(F.col(f"w{s}"))).alias(s) for s in shares],
    )
    total = rated.groupBy("doc", "print").agg(*[F.sum(c).alias(c) for c in ("copies", "tokens", "known", "base", *shares)])
    # Rows equal in id and text were summed together: each gets its share.
    each = total.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    size, count = float(np.log10(n_train + distinct + 1.0)), F.col("tokens") / F.col("copies")
    prior = [float(np.log10(n / all_ends)) if n else float("-inf") for n in ends] if all_ends else [0.0] + [float("-inf")] * (len(ends) - 1)
    in_group = [F.col(s) / F.col("copies") + F.lit(p) for s, p in zip(shares, prior, strict=True) if p > float("-inf")]
    best = F.greatest(*in_group) if len(in_group) > 1 else in_group[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in in_group), F.lit(0.0)))
    return each.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias(id_column), count.cast("long").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - count * size).alias("base_score"), score.alias("score"),
    )
