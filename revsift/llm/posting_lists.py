"""Operator 1: approximate nearest neighbours over balanced posting lists.

Equal vectors are one point: a point keeps its smallest ids only (never more
can be among the nearest), so a vector that a third of all rows share is one
row of the index and one search. The points' lists hang on centroids that a
bounded sample gives by balanced k-means. A point near the border of several
lists is put into each of them (unless a list already taken is nearer to that
centroid than the point is). Centroids are found through a graph of their
neighbours, held in memory and walked for a whole batch of vectors at once.
A query reads all lists whose centroid is at most a given ratio farther than
the nearest one, however many they are: on vectors without clusters that is
nearly every list, and the search comes close to brute force. Lists of near
centroids stand on one shelf, which a query that reads any of them reads as a
whole. Shelves and their queries meet in cells of bounded size; each cell sends
on its best few of each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bound_batches, map_batches, written

# Points that a list holds on average, and the most centroids there are.
LIST_POINTS = 100
MOST_LISTS = 16_384
# Vectors that k-means sees for each centroid, and its rounds.
FIT_POINTS = 24
FIT_ROUNDS = 8
# Neighbours of a centroid in the graph; centroids that a query's walk keeps (if
# the last is still within the ratio, all centroids are compared).
GRAPH_DEGREE = 24
BEAM = 96
# A point goes into lists at most this ratio farther than its nearest, REPLICAS at most.
EDGE_RATIO = 1.25
REPLICAS = 6
# Centroids that the walk of a point keeps.
EDGE_BEAM = 32
# A query reads lists at most this ratio farther than its nearest.
PROBE_RATIO = 1.6
LEAST_PROBES = 8
# Lists of a shelf on average: a query goes once to a shelf, not to each of its lists.
SHELF_LISTS = 16
# Points and queries of one cell of a shelf.
CELL_POINTS = 4096
CELL_QUERIES = 1024
# Bound of the error of a cosine in single precision, and pairs ranked exactly at a time.
FAST_ERROR = 1e-5
EXACT_PAIRS = 1 << 15


class Centroids:
    """Unit centroids and the graph of their neighbours."""

    def __init__(self, vectors: np.ndarray, degree: int = GRAPH_DEGREE):
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        near = np.empty((n, min(degree, max(n - 1, 1))), np.int32)
        for a in range(0, n, 1024):
            sim = self.vectors[a:a + 1024] @ self.vectors.T
            sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2 if n > 1 else 2
            near[a:a + 1024] = np.argpartition(-sim, near.shape[1] - 1, axis=1)[:, :near.shape[1]]
        # a shortcut from every centroid to a random one keeps far regions connected
        far = np.random.default_rng(0).integers(0, n, (n, 2)).astype(np.int32)
        self.graph = np.concatenate([near, far], axis=1)
        self.entries = np.arange(0, n, max(1, n // max(1, math.isqrt(n))))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, cosines), best first, of a batch of unit vectors; -1
        where a walk met fewer than ``beam``. Each round every walk opens its
        best centroid that is still closed; it ends when all it keeps are open."""
        n, b = len(self.vectors), len(x)
        beam = min(beam, n)
        ids = np.full((b, beam), -1, np.int32)
        sims = np.full((b, beam), -np.inf, np.float32)
        first = x @ self.vectors[self.entries].T
        k = min(beam, len(self.entries))
        top = np.argsort(-first, axis=1, kind="stable")[:, :k]
        ids[:, :k], sims[:, :k] = self.entries[top], np.take_along_axis(first, top, 1)
        opened = ids < 0
        seen = np.zeros((b, n), bool)
        seen[:, self.entries] = True
        live = np.arange(b)
        while len(live):
            at = np.argmax(~opened[live], axis=1)
            live, at = live[~opened[live, at]], at[~opened[live, at]]
            if not len(live):
                break
            opened[live, at] = True
            nxt = self.graph[ids[live, at]]
            rows = np.broadcast_to(live[:, None], nxt.shape)
            fresh = ~seen[rows, nxt]
            seen[rows, nxt] = True
            s = np.where(fresh, np.einsum("bd,bkd->bk", x[live], self.vectors[nxt]), -np.inf).astype(np.float32)
            # a neighbour named twice counts once
            order = np.argsort(nxt, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            srt = np.take_along_axis(nxt, order, 1)
            np.put_along_axis(twice, order[:, 1:], srt[:, 1:] == srt[:, :-1], 1)
            s[twice] = -np.inf
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], np.where(np.isinf(s), -1, nxt)], axis=1)
            all_o = np.concatenate([opened[live], np.isinf(s)], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            opened[live] = np.take_along_axis(all_o, top, 1)
        return ids, sims


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Balanced k-means of unit vectors by cosine: a centroid's pull shrinks
    with the share of points it had in the round before."""
    rng = np.random.default_rng(7)
    lists = min(lists, len(sample))
    c = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float32)
    weight = np.zeros(lists, np.float32)
    for _ in range(rounds):
        best = np.empty(len(sample), np.int64)
        for a in range(0, len(sample), 4096):
            best[a:a + 4096] = np.argmax(sample[a:a + 4096] @ c.T - weight, axis=1)
        count = np.bincount(best, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, best, sample)
        empty = count == 0
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c).astype(np.float32)
        weight += 0.02 * (count * lists / len(sample) - 1).clip(-1, 3).astype(np.float32)
    return c


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cos, 0.0))


def choose_lists(ids: np.ndarray, sims: np.ndarray, centroids: np.ndarray, ratio: float, least: int, most: int, spread: bool) -> list[np.ndarray]:
    """Lists of every vector: those at most ``ratio`` farther than the nearest,
    and the ``least`` nearest. With ``spread`` a list is left out if one taken is nearer to its centroid
    than the vector is (it would hold the same neighbourhood)."""
    d = _distance(sims)
    ok = (ids >= 0) & (d <= ratio * d[:, :1] + 1e-6)
    ok[:, :least] = ids[:, :least] >= 0
    ok[:, most:] = False
    if not spread:
        return [i[o] for i, o in zip(ids, ok)]
    out = []
    for row, keep, dist in zip(ids, ok, d):
        taken = [int(row[0])]
        for j in np.flatnonzero(keep)[1:]:
            if (_distance(centroids[taken] @ centroids[row[j]]) > dist[j]).all():
                taken.append(int(row[j]))
        out.append(np.array(taken, np.int32))
    return out


def probed_lists(c: Centroids, x: np.ndarray, ratio: float, least: int, beam: int) -> list[np.ndarray]:
    """Lists that every query reads: all at most ``ratio`` farther than the
    nearest, and the ``least`` nearest. A walk whose last centroid is still
    within the ratio has not met them all: such a query compares every centroid."""
    ids, sims = c.search(x, max(beam, least))
    got = choose_lists(ids, sims, c.vectors, ratio, least, ids.shape[1], False)
    if ids.shape[1] < len(c.vectors):
        d = _distance(sims)
        wide = np.flatnonzero((ids[:, -1] < 0) | (d[:, -1] <= ratio * d[:, 0] + 1e-6))
        every = x[wide] @ c.vectors.T
        order = np.argsort(-every, axis=1, kind="stable").astype(np.int32)
        lists = choose_lists(order, np.take_along_axis(every, order, 1), c.vectors, ratio, least, order.shape[1], False)
        for i, g in zip(wide.tolist(), lists):
            got[i] = g
    return got


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim))
    out[np.arange(dim)[None, :] < n[:, None]] = flat
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that neither tiny nor huge components vanish or overflow
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision."""
    sa, sb = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    a, b = a / sa, b / sb
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id",
                       vector_col: str = "embedding", probe_ratio: float = PROBE_RATIO, beam: int = BEAM,
                       list_points: int = LIST_POINTS) -> DataFrame:
    """The ``k`` nearest found of every row for which ``is_query`` (on
    ``vec_id``; default all), among all rows but itself: ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score`` (cosine in double precision of
    the original vectors), ties to the smaller id.

    Vectors that are null, empty, zero or have null or non-finite components,
    and rows without an id, take no part. Vectors of different lengths are
    compared as if the shorter ended in zeros. A repeated row is one row. An
    id with several different vectors is named once in a list, with the best
    score of any of them (its list, and lists that name it, may be shorter).
    A table of one usable row, or none, gives no rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    src = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    src = src.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    wanted = F.lit(True) if is_query is None else is_query
    # equal vectors are one point, known by its smallest id; the hot ones shrink before the shuffle
    keyed = src.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    few = top_ranked(keyed.dropDuplicates(["vec_id", "v"]), "v", [F.asc("vec_id")], k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = written(points.select(F.col("ids")[0].alias("point"), "v", "ids"), "points")
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim = stats["n"], stats["dim"]
    lists = max(1, min(MOST_LISTS, math.ceil(n / list_points)))
    # at most MOST_LISTS * FIT_POINTS vectors and 64 MB come to the driver, the smallest by hash
    fit = min(lists * FIT_POINTS, (64 << 20) // (8 * dim))
    rows = points.select("v").orderBy(F.xxhash64("point"), "point").limit(max(fit, 1)).toArrow()
    sample = _unit(_vectors(rows.column("v").combine_chunks(), dim))
    centroids = Centroids(fit_centroids(sample, lists))
    boards = fit_centroids(centroids.vectors, max(1, math.ceil(len(centroids.vectors) / SHELF_LISTS)))
    shelf_of = np.argmax(centroids.vectors @ boards.T, axis=1).astype(np.int32)
    shared = spark.sparkContext.broadcast((centroids, shelf_of))  # at most MOST_LISTS vectors and their graph

    def assign(as_query: bool):
        def run(batches):
            c, shelf = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    b = batch.slice(a, 256)
                    x = _unit(_vectors(b.column("v"), dim))
                    got = (probed_lists(c, x, probe_ratio, LEAST_PROBES, beam) if as_query
                           else choose_lists(*c.search(x, EDGE_BEAM), c.vectors, EDGE_RATIO, 1, REPLICAS, True))
                    got = [np.unique(shelf[g]) for g in got]
                    rows = np.repeat(np.arange(b.num_rows), [len(g) for g in got])
                    of = np.concatenate(got)
                    step = max(1, BATCH_BYTES // (8 * dim))  # a batch may read every shelf
                    for i in range(0, len(rows), step):
                        take = pa.array(rows[i:i + step])
                        yield pa.RecordBatch.from_arrays([b.column("point").take(take), pa.array(of[i:i + step]), b.column("v").take(take)],
                                                         names=["point", "shelf", "v"])
        return run

    posting = written(map_batches(points.select("point", "v"), assign(False), "point long, shelf int, v array<double>"), "lists")
    queries = keyed.filter(wanted).select("vec_id", "v").distinct().join(points.select("v", "point"), "v").select("vec_id", "point")
    queries = written(queries, "queries")
    asked = points.join(queries.select("point").distinct(), "point", "left_semi").select("point", "v")
    probes = written(map_batches(asked, assign(True), "point long, shelf int, v array<double>"), "probes")
    # cells: a long shelf is cut by its points, a shelf that many queries read by its queries
    cells = (posting.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / CELL_POINTS).alias("np"))
             .join(probes.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("nq")), "shelf"))
    cells = written(cells, "cells")  # one row for each shelf: MOST_LISTS at most
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (posting.join(F.broadcast(cells), "shelf").withColumn("cp", F.pmod(F.xxhash64("point"), F.col("np"))).withColumn("cq", each("nq"))
            .select("shelf", "cp", "cq", "point", "v"))
    right = (probes.join(F.broadcast(cells), "shelf").withColumn("cq", F.pmod(F.xxhash64("point"), F.col("nq"))).withColumn("cp", each("np"))
             .select("shelf", "cp", "cq", "point", "v"))

    def best(points_of: pa.Table, queries_of: pa.Table) -> pa.Table:
        out = {"q": [], "p": [], "score": []}
        if points_of.num_rows and queries_of.num_rows:
            pid = points_of.column("point").to_numpy()
            qid = queries_of.column("point").to_numpy()
            p = _vectors(points_of.column("v").combine_chunks(), dim)
            q = _vectors(queries_of.column("v").combine_chunks(), dim)
            fast_p, fast_q = _unit(p), _unit(q)
            m = min(k + 1, len(pid))  # no more of a cell can be among the best k + 1
            for a in range(0, len(qid), 256):
                # by the fast measure the first m and all that its error could put level with them; the exact one ranks
                sim = fast_q[a:a + 256] @ fast_p.T
                low = -np.partition(-sim, m - 1, axis=1)[:, m - 1:m]
                r, c = np.nonzero(sim >= low - FAST_ERROR)
                s = np.concatenate([cosine(q[a + r[i:i + EXACT_PAIRS]], p[c[i:i + EXACT_PAIRS]]) for i in range(0, len(r), EXACT_PAIRS)])
                order = np.lexsort((pid[c], -s, r))
                start = np.searchsorted(r, r)  # r is sorted
                order = order[np.arange(len(r)) - start < m]
                out["q"].append(qid[a + r[order]])
                out["p"].append(pid[c[order]])
                out["score"].append(s[order])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"q": cat(out["q"], np.int64), "p": cat(out["p"], np.int64), "score": cat(out["score"], np.float64)})

    found = (left.groupBy("shelf", "cp", "cq").cogroup(right.groupBy("shelf", "cp", "cq"))
             .applyInArrow(best, "q long, p long, score double"))
    # best points of a query point: k + 1 are enough, as its own point holds at least the query itself
    ranked = top_ranked(found.distinct(), "q", [F.desc("score"), F.asc("p")], k + 1)
    hits = (ranked.join(points.select(F.col("point").alias("p"), "ids"), "p")
            .select("q", "score", F.explode("ids").alias("vec_id")))
    hits = hits.join(queries.select(F.col("vec_id").alias("query_id"), F.col("point").alias("q")), "q").filter("vec_id <> query_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = top_ranked(hits, "query_id", [F.desc("score"), F.asc("vec_id")], k, "rank")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_ranked(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first k rows of every key (Spark cuts to k before the shuffle)."""
    from pyspark.sql import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= k)
