"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is split in halves again and again until its parts are small; the
parts' means are the lists' centroids, so lists are balanced. A graph over the centroids,
searched best-first from a few entries, finds the lists near a vector. Every vector goes to
its nearest list and, if it lies near a boundary, to further lists within a ratio of that distance; queries
search all lists within a larger ratio, which is fitted to a stated recall on the sample. A query that finds fewer neighbours
than it could is answered from all rows instead.

A row is stored once, under its nearest list and with the names of its further ones. Neighbouring lists form groups of so many
bytes as a task may hold; long lists are cut. Queries go to every group, not to every list, and stream past its rows in blocks, so memory follows
the size of a group and not the number of queries or of lists that they search.

Nearness is the cosine in double precision; ties go to the smaller id, and a row never is its own
neighbour (rows that share the query's id aren't either). Other columns are never read, so their names can't clash; a vector is read whole. Vectors that are null, zero, of another than the commonest length, or
hold null or non-finite components take no part, nor do null ids. Repeated rows count once per id. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.words import once, quoted
from feedloom.session import settle, ship_package

#: Numbers in the sample that places centroids, vectors in a list, and lists at most.
SAMPLE_NUMBERS = 2_000_000
LIST_SIZE, MAX_LISTS = 200, 16_384
#: Lists that a vector may go to, and the distance over the nearest list's within which they lie.
COPIES, COPY_RATIO = 4, 1.10
#: Queries go to all lists within a ratio that finds this share of the nearest rows for so many of the sample's rows, searched in the sample.
RECALL, TRIALS = 0.95, 256
_NEAR, _FAR, _ENTRIES, _EXPAND, _FIRST = 14, 2, 24, 6, 32
#: Bytes of vectors in a group, queries that search it together, rows compared at once, pairs scored exactly at once, and numbers gathered at once in the graph.
GROUP_BYTES = 96 << 20
_BLOCK, _ROWS, _PAIRS, _GATHERED = 1024, 2048, 16_384, 1 << 22


class Centroids:
    """Unit centroids and a graph over them: each knows its nearest others and a few at random."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.single, n = points, points.astype(np.float32), len(points)
        rng = np.random.default_rng(7)
        near = np.empty((n, min(_NEAR, n)), np.int64)
        for at in range(0, n, 128):
            close = points[at : at + 128] @ points.T
            near[at : at + 128] = np.argpartition(-close, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        self.links = np.concatenate([near, rng.integers(0, n, (n, _FAR))], axis=1)
        self.entries = rng.permutation(n)[:_ENTRIES]

    def search(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids found for each vector and their cosines, nearest first; all pad places are -1."""
        found = max(_EXPAND, max(k, 2 * _EXPAND) // 16) * self.links.shape[1]
        some = max(1, min(512, _GATHERED // (max(found, k) * max(1, self.points.shape[1]))))
        out = [self._search(vectors[a : a + some], k) for a in range(0, len(vectors), some)]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _search(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # All of the best are expanded before the search ends, so its work follows k.
        # The way there is in single precision, the centroids found are scored in double precision.
        n, width, single = len(self.points), max(k, 2 * _EXPAND), vectors.astype(np.float32)
        expand = max(_EXPAND, width // 16)
        ids, close = np.full((len(vectors), width), -1), np.full((len(vectors), width), -np.inf, np.float32)
        done, live = np.zeros(ids.shape, bool), np.arange(len(vectors))
        # Every centroid is scored once for a vector; those that fell out of the best stay out.
        seen, owner = np.zeros(len(vectors) * n, bool), np.empty(len(vectors) * n, np.int32)
        flat = (live[:, None] * n + self.entries).ravel()
        while len(live):
            flat = flat[~seen[flat]]
            owner[flat] = np.arange(len(flat))
            flat = flat[owner[flat] == np.arange(len(flat))]
            seen[flat] = True
            row, centroid = np.divmod(flat, n)
            score = np.einsum("nd,nd->n", single[row], self.single[centroid])
            better = np.flatnonzero(score > close.min(axis=1)[row])
            if len(better):
                row, centroid = row[better], centroid[better]
                met, first, count = np.unique(row, return_index=True, return_counts=True)
                at = np.repeat(np.arange(len(met)), count), width + np.arange(len(row)) - np.repeat(first, count)
                some, scores = np.full((len(met), width + count.max()), -1), np.full((len(met), width + count.max()), -np.inf, np.float32)
                some[:, :width], scores[:, :width], some[at], scores[at] = ids[met], close[met], centroid, score[better]
                over = np.zeros(some.shape, bool)
                over[:, :width] = done[met]
                order = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                ids[met], close[met], done[met] = (np.take_along_axis(x, order, 1) for x in (some, scores, over))
            todo = np.where(done[live], -np.inf, close[live])
            pick = np.argpartition(-todo, expand - 1, axis=1)[:, :expand]
            fresh = np.take_along_axis(todo, pick, 1) > -np.inf
            more = fresh.any(1)
            live, pick, fresh = live[more], pick[more], fresh[more]
            done[live[:, None], pick] = True
            row, place = np.nonzero(fresh)
            row, place = live[row], pick[row, place]
            flat = (row[:, None] * n + self.links[ids[row, place]]).ravel()
        close = np.where(ids < 0, -np.inf, np.einsum("bd,bnd->bn", vectors, self.points[np.maximum(ids, 0)]))
        order = np.argsort(-close, axis=1, kind="stable")[:, :k]
        ids, close = np.take_along_axis(ids, order, 1), np.take_along_axis(close, order, 1)
        return np.where(np.isinf(close), -1, ids), close

    def within(self, vectors: np.ndarray, ratio: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vector, centroid) pairs whose distance is at most ``ratio`` times that to the nearest centroid, at most ``most`` each.

        The search is widened for vectors whose last centroid found is still inside.
        """
        n, rows, pairs = len(self.points), np.arange(len(vectors)), []
        k, most = min(n, most or _FIRST), min(n, most or n)
        while len(rows):
            ids, close = self.search(vectors[rows], k)
            far = np.sqrt(np.maximum(2 - 2 * close, 0))
            fits = (ids >= 0) & (far <= far[:, :1] * ratio + 1e-12)
            again = fits[:, -1] & (k < most)
            row, place = np.nonzero(fits & ~again[:, None])
            pairs.append((rows[row], ids[row, place]))
            rows, k = rows[again], min(most, 4 * k)
        return tuple(np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


def fitted_ratio(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The ratio within which queries meet ``recall`` of their k nearest rows, tried on rows of the sample among the rows of the sample.

    The sample is thinner than the table, so its nearest rows lie farther off and the ratio errs on the wide side.
    """
    if len(sample) < 2 or len(centroids) < 2:
        return 1.0
    graph, tried = Centroids(centroids), np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(np.int64)
    row, list_ = graph.within(sample, COPY_RATIO, COPIES)
    order = np.argsort(row, kind="stable")
    row, list_ = row[order], list_[order]
    close = sample[tried] @ sample.T
    close[np.arange(len(tried)), tried] = -np.inf
    k = min(k, len(sample) - 1)
    nearest_rows = np.argpartition(-close, k - 1, axis=1)[:, :k]
    far = np.sqrt(np.maximum(2 - 2 * (sample[tried] @ centroids.T), 0))
    far = far / np.maximum(far.min(axis=1, keepdims=True), 1e-12)
    needed = [far[i, list_[np.searchsorted(row, j) : np.searchsorted(row, j, side="right")]].min() for i in range(len(tried)) for j in nearest_rows[i]]
    return float(np.quantile(needed, recall, method="higher"))


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of parts of about equal size: each part is halved along the line between two of its far points."""
    rng, parts = np.random.default_rng(11), [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        some = sample[part]
        a = some[rng.integers(len(part))]
        b = some[np.argmin(some @ a)]
        for _ in range(3):
            side = some @ (a - b)
            half = side >= np.median(side)
            if half.all() or not half.any():
                break
            a, b = some[half].mean(0), some[~half].mean(0)
        order = np.argsort(some @ (a - b), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    means = np.stack([sample[p].mean(0) for p in parts])
    length = np.linalg.norm(means, axis=1, keepdims=True)
    means = means / np.where(length > 0, length, 1)
    return np.unique(means, axis=0)


def side_by_side(centroids: np.ndarray) -> np.ndarray:
    """The centroids' places in an order in which near ones stand together: halved along the line between two far ones, again and again."""
    parts, out = [np.arange(len(centroids))], []
    while parts:
        part = parts.pop()
        if len(part) < 3:
            out += part.tolist()
            continue
        some = centroids[part]
        a = some[np.argmin(some @ some[0])]
        b = some[np.argmin(some @ a)]
        order = np.argsort(some @ (a - b), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    places = np.empty(len(out), np.int64)
    places[out] = np.arange(len(out))
    return places


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _clean(vectors: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, once per id, as (id, v), and the length of their vectors."""
    # Floats stay floats; they are compared in double precision.
    kind = vectors.select(F.col(quoted(vector)).alias("v")).schema["v"].dataType
    kind = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    v = F.col(quoted(vector))
    rows = vectors.select(F.col(quoted(id_column)).cast("long").alias("id"), v.cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = size[0]["n"] if size else 0
    # Of rows that share an id the smallest vector counts.
    return rows.where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v")), size


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for every query row: query_id, rank (from 1), vec_id, score.

    ``queries`` is a condition over ``id_column``.
    """
    session = vectors.sparkSession
    context = session.sparkContext
    ship_package(session)
    # The rows are written once, with their lists; what comes before reads ids, the sample or the queries only.
    rows, size = _clean(vectors, id_column, vector)
    is_query = F.expr("true") if queries is None else queries
    n = rows.count()
    if n < 2:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    take = max(1, SAMPLE_NUMBERS // size)
    # Most of what can't be among the smallest hashes goes before rows are ordered.
    draw, share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)), min(1.0, (1.2 * take + 200) / n)
    sample = rows.where(draw < int(share * (1 << 30))).orderBy(draw, "id").limit(take).select("v").toArrow()["v"].combine_chunks()
    sample = _unit(_matrix(sample, size))
    centroids = balanced_centroids(sample, max(1, min(MAX_LISTS, n // LIST_SIZE, len(sample) // 4)))
    probe_ratio = fitted_ratio(sample, centroids, k)
    key, shared = uuid.uuid4().hex, context.broadcast(centroids)

    def lists(batches):
        graph = once(key, lambda: Centroids(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, list_ = graph.within(_unit(_matrix(part.column(1), size)), COPY_RATIO, COPIES)
                yield pa.RecordBatch.from_arrays([_padded(row, list_, part.num_rows), *part.columns], names=["lists", "id", "v"])

    def reach(batches):
        graph = once(key, lambda: Centroids(shared.value))
        for batch in batches:
            ids, close = graph.search(_unit(_matrix(batch.column(1), size)), min(_FIRST, len(graph.points)))
            far = np.sqrt(np.maximum(2 - 2 * close[:, 0], 0)) * probe_ratio + 1e-12
            yield pa.RecordBatch.from_arrays([_padded(np.arange(len(ids)), ids[:, 0], len(ids)), pa.array(far), *batch.columns], names=["lists", "reach", "id", "v"])

    kind = f"id long, v {rows.schema['v'].dataType.simpleString()}"
    postings = settle(rows.mapInArrow(lists, f"lists array<int>, {kind}"), "postings")
    asked = rows.withColumn(id_column, F.col("id")).where(is_query).select("id", "v")
    asked = settle(asked.mapInArrow(reach, f"lists array<int>, reach double, {kind}"), "queries")
    best = settle(_searched(postings, asked, n, k, size, shared), "neighbours")
    short = asked.join(best.groupBy(F.col("query_id").alias("id")).count(), "id", "left").where(F.coalesce("count", F.lit(0)) < min(k, n - 1))
    short = settle(short.select("lists", F.lit(float("inf")).alias("reach"), "id", "v"), "short-queries")
    if short.isEmpty():
        return best
    redone = _searched(postings, short, n, k, size, shared)
    return best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(redone)


def _padded(row: np.ndarray, list_: np.ndarray, n: int) -> pa.Array:
    """The lists of every row, nearest first, and -1 in places left over."""
    order = np.argsort(row, kind="stable")
    row, list_ = row[order], list_[order]
    out = np.full((n, COPIES), -1, np.int32)
    out[row, np.arange(len(row)) - np.searchsorted(row, row)] = list_
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * COPIES + 1, COPIES, dtype=np.int32)), pa.array(out.ravel()))


def _searched(postings: DataFrame, asked: DataFrame, n: int, k: int, size: int, shared) -> DataFrame:
    """The k best rows for every query among those with a list in its reach."""
    context = postings.sparkSession.sparkContext
    wide = 4 if postings.schema["v"].dataType.simpleString() == "array<float>" else 8
    # More groups than memory asks for only while queries sent to all of them are fewer than rows.
    groups = max(-(-n * size * wide // GROUP_BYTES), min(2 * context.defaultParallelism, n // max(1, asked.count())), 1)
    # One row per list: at most MAX_LISTS. A row's place in its list is drawn by its id.
    counts = postings.groupBy(F.col("lists")[0].alias("list")).agg(F.count("*").alias("rows")).toArrow()
    counted = np.zeros(len(shared.value), np.int64)
    counted[counts["list"].to_numpy()] = counts["rows"].to_numpy()
    order = np.argsort(side_by_side(shared.value), kind="stable")
    first = np.empty(len(order), np.int64)
    first[order] = np.cumsum(counted[order]) - counted[order]
    table = pa.table({"list": pa.array(np.arange(len(order), dtype=np.int32)), "first": pa.array(first), "rows": pa.array(counted)})
    table = F.broadcast(postings.sparkSession.createDataFrame(table))
    place = F.col("first") + F.pmod(F.xxhash64("id"), F.col("rows"))
    mine = postings.join(table, F.col("lists")[0] == F.col("list"))
    mine = mine.select((place * groups / n).cast("int").alias("group"), F.lit(0).cast("byte").alias("side"), "first", "lists", F.lit(0.0).alias("reach"), "id", "v")
    theirs = asked.join(table, F.col("lists")[0] == F.col("list"))
    theirs = theirs.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).cast("byte").alias("side"), "first", "lists", "reach", "id", "v")
    dealt = theirs.unionByName(mine).repartitionById(groups, "group").sortWithinPartitions("group", "side", "first")
    return _ranked(dealt.mapInArrow(_search_groups(k, size, shared), "query_id long, vec_id long, score double"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_groups(k: int, size: int, shared):
    def run(batches):
        group, rows = None, None
        for batch in batches:
            g, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(g):
                continue
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(g)], strict=True):
                if g[a] != group:
                    group, rows = g[a], Group(shared.value, k)
                for at in range(a, b, _BLOCK):
                    part = batch.slice(at, min(b, at + _BLOCK) - at)
                    ids, v = part.column(5).to_numpy(), _matrix(part.column(6), size)
                    if side[a] == 0:
                        rows.add(_matrix(part.column(3), COPIES), ids, v)
                    else:
                        found = rows.search(ids, v, part.column(4).to_numpy(), _matrix(part.column(3), COPIES)[:, 0])
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return run


class Group:
    """Rows of some lists, and the k best of them for queries that come in blocks.

    Products in single precision leave out what can't be among the best; the rest is scored in double precision, pair by pair.
    """

    def __init__(self, centroids: np.ndarray, k: int) -> None:
        self.centroids, self.k = centroids, k
        self.runs: list[tuple] = []
        self.parts: list[tuple] = []
        self.met: np.ndarray | None = None

    def add(self, lists: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Rows in the order of their nearest lists."""
        self.parts.append((lists.copy(), ids.copy(), v.copy()))
        if sum(len(p[1]) for p in self.parts) >= _ROWS:
            self._close()

    def _close(self) -> None:
        if self.parts:
            lists, ids, v = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            keep = _first_of_same(lists, ids, v, self.k + 1)
            self.parts = [(lists[keep], ids[keep], v[keep])]
            if len(keep) >= _ROWS // 2:
                self.runs, self.parts = [*self.runs, *self.parts], []

    def _ready(self) -> None:
        """Lists are named by their place among those of this group, the last place stands for none."""
        self._close()
        self.runs, self.parts = [*self.runs, *self.parts], []
        self.met = np.unique(np.concatenate([np.unique(r[0]) for r in self.runs])) if self.runs else np.zeros(0, np.int32)
        self.met = self.met[self.met >= 0]
        for i, (lists, ids, v) in enumerate(self.runs):
            at = np.where(lists < 0, len(self.met), np.searchsorted(self.met, lists))
            length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            self.runs[i] = at, np.unique(at), ids, v, length

    def search(self, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores of the k best rows with a list at most ``reach`` away or in the query's own list, ties to the smaller id."""
        if self.met is None:
            self._ready()
        k, n, q = self.k, len(ids), q.astype(np.float64)
        q_length = np.sqrt((q * q).sum(1))
        unit = q / q_length[:, None]
        probes = np.zeros((len(self.met) + 1, n), bool)
        for at in range(0, len(self.met), 1024):
            far = np.sqrt(np.maximum(2 - 2 * (self.centroids[self.met[at : at + 1024]] @ unit.T), 0))
            probes[at : at + len(far)] = far <= reach
        if own is not None and len(self.met):
            # The nearest list always is searched: a distance of nearly nothing is rounding, and comes out otherwise here.
            at = np.minimum(np.searchsorted(self.met, own), len(self.met) - 1)
            there = np.flatnonzero(self.met[at] == own)
            probes[at[there], there] = True
        unit = unit.astype(np.float32)
        # The sum of single products of unit vectors is off by less than this.
        slack = (q.shape[1] + 8) * 1.2e-7
        best, best_ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        bar = np.full(n, -np.inf, np.float32)
        for lists, any_, vec_ids, v, length in self.runs:
            some = np.flatnonzero(probes[any_].any(0))
            if not len(some):
                continue
            close = unit[some] @ (v / length[:, None]).astype(np.float32).T
            hot = np.flatnonzero(close.max(1) >= bar[some])
            if not len(hot):
                continue
            close, some = (close, some) if len(hot) == len(some) else (close[hot], some[hot])
            edge = bar[some]
            new = np.flatnonzero(np.isinf(edge))
            if len(new):
                # One place more than asked for, since a query may be among the rows itself.
                fits, probed = np.zeros((len(vec_ids), len(new)), bool), probes[:, some[new]]
                for j in range(lists.shape[1]):
                    fits |= probed[lists[:, j]]
                close[new] = np.where(fits.T, close[new], -np.inf)
                if len(vec_ids) > k:
                    edge[new] = np.partition(close[new], -(k + 1), axis=1)[:, -(k + 1)] - np.float32(2 * slack)
                edge[new] = np.maximum(edge[new], -3)
            row, place = np.nonzero(close >= edge[:, None])
            row = some[row]
            fits = probes[lists[place], row[:, None]].any(1) & (ids[row] != vec_ids[place])
            row, place = row[fits], place[fits]
            if not len(row):
                continue
            score = np.empty(len(row))
            for at in range(0, len(row), _PAIRS):
                r, p = row[at : at + _PAIRS], place[at : at + _PAIRS]
                score[at : at + _PAIRS] = (q[r] * v[p]).sum(1) / (q_length[r] * length[p])
            # The best so far of the queries met and what is new, in order.
            met = np.unique(row)
            whose = np.concatenate([np.repeat(met, k), row])
            scores, found = np.concatenate([best[met].ravel(), score]), np.concatenate([best_ids[met].ravel(), vec_ids[place]])
            order = np.lexsort((found, -scores, whose))
            whose = whose[order]
            order = order[np.arange(len(whose)) - np.searchsorted(whose, whose) < k]
            best[met], best_ids[met] = scores[order].reshape(-1, k), found[order].reshape(-1, k)
            bar[met] = best[met, -1] - 2 * slack
        row, place = np.nonzero(best > -np.inf)
        return ids[row], best_ids[row, place], best[row, place]


def _first_of_same(lists: np.ndarray, ids: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without those that can't be answers: rows with the same vector tie, and ``most`` of them have smaller ids."""
    whole = np.concatenate([lists.view(np.uint32), np.ascontiguousarray(v).view(np.uint32)], axis=1)
    weights = np.random.default_rng(5).integers(1, 1 << 62, whole.shape[1], dtype=np.uint64) * 2 + 1
    mark = np.zeros(len(ids), np.uint64)
    for at in range(0, len(ids), _ROWS):
        mark[at : at + _ROWS] = (whole[at : at + _ROWS] * weights).sum(1, dtype=np.uint64)
    order = np.lexsort((ids, mark))
    first = np.searchsorted(mark[order], mark[order])
    late = np.flatnonzero(np.arange(len(order)) - first >= most)
    if len(late):
        # Where vectors only share the mark, all of them stay.
        unlike = np.zeros(len(order), bool)
        for at in range(0, len(order), _ROWS):
            unlike[at : at + _ROWS] = (whole[order[at : at + _ROWS]] != whole[order[first[at : at + _ROWS]]]).any(1)
        mixed = np.zeros(len(order), bool)
        mixed[first[unlike]] = True
        order = np.delete(order, late[~mixed[first[late]]])
    return np.sort(order)
