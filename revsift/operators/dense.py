"""Exact dense search (J8, R6): every query vector against every corpus vector.

Both sides are dealt into blocks, and every pair of blocks is a cell: query
rows are copied to the cells of their block, corpus rows likewise. A cell's
rows arrive sorted, its queries first, so a task holds one block of queries
(bounded in bytes) and streams the corpus past it, batch by batch, keeping the
best few of each query; a row below the k-th best seen so far is not looked at
again, and of many equal scores the k smallest ids stay. Nothing passes through the driver, and neither side is
broadcast.

The number of query blocks follows from the measured size of the distinct
query vectors; the corpus is cut for parallelism only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .distributed import cut_lineage

BLOCK_BYTES = 16 << 20     # query vectors that a task holds, as doubles
CORPUS_BYTES = 2 << 20     # corpus bytes (Spark's estimate) worth a task of their own
QUERY_CHUNK = 1024         # queries scored at a time
CORPUS_CHUNK = 4096        # corpus rows scored at a time
HELD = 1 << 17             # found rows that wait until the best are taken
MARGIN = 2e-6              # kept beyond the k-th best: ranks are by rounded scores

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(),
          "double": pa.float64(), "float": pa.float32(), "date": pa.date32()}


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their unit vectors as rows): those that
    are null, empty, zero, or hold a null or a number that is not finite are
    left out. All others must have one length."""
    n = len(vectors)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths > 0)
    if not len(at):
        return at, np.zeros((0, 0))
    if (lengths[at] != lengths[at[0]]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set(lengths[at].tolist()))[:5]}")
    kept = vectors if len(at) == n and vectors.null_count == 0 else vectors.take(pa.array(at))
    flat = kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number
    rows = flat.reshape(len(at), -1)
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    ok = np.isfinite(rows).all(axis=1) & (norm > 0) & np.isfinite(norm)
    return at[ok], rows[ok] / norm[ok, None]


def best_of(qi: np.ndarray, ci: np.ndarray, sc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query all candidates within the margin of its k-th best score, so
    that ties after rounding are settled later by id."""
    if not len(sc):
        return qi, ci, sc
    order = np.lexsort((-sc, qi))
    qi, ci, sc = qi[order], ci[order], sc[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
    counts = np.diff(np.r_[starts, len(qi)])
    kth = np.repeat(sc[starts + np.minimum(counts, k) - 1], counts)
    keep = sc >= kth - MARGIN
    qi, ci, sc = qi[keep], ci[keep], sc[keep]
    if len(qi) > 2 * k * len(starts):
        return few_ties(qi, ci, sc, k)
    return qi, ci, sc


def few_ties(qi: np.ndarray, ci: np.ndarray, sc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a query's candidates with one and the same score those with the k
    smallest ids: no other can be among its k best."""
    place = ci if ci.dtype.kind in "iuf" else np.unique(ci, return_inverse=True)[1]
    order = np.lexsort((place, -sc, qi))
    qi, ci, sc, place = qi[order], ci[order], sc[order], place[order]
    tie = np.r_[True, (np.diff(qi) != 0) | (np.diff(sc) != 0)]
    fresh = np.cumsum(tie | np.r_[True, np.diff(place) != 0])  # counts the different ids
    keep = fresh - np.maximum.accumulate(np.where(tie, fresh, 0)) < k
    return qi[keep], ci[keep], sc[keep]


def without_self(sc: np.ndarray, names: np.ndarray, ids: np.ndarray) -> None:
    """Take the pairs of a row and itself out of a block of scores."""
    if names.dtype.kind not in "iuf" or ids.dtype.kind not in "iuf":
        sc[names[:, None] == ids[None, :]] = -np.inf
        return
    order = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids, names, side, sorter=order) for side in ("left", "right"))
    for i in np.flatnonzero(last > first):
        sc[i, order[first[i]:last[i]]] = -np.inf


class _Cell:
    """One block of queries, and the best corpus rows seen so far."""

    def __init__(self, k: int, exclude_self: bool):
        self.k, self.exclude_self = k, exclude_self
        self.keys: list = []
        self.parts: list[np.ndarray] = []
        self.matrix: np.ndarray | None = None
        self.qi, self.sc = np.zeros(0, np.int64), np.zeros(0)
        self.ids = None
        self.low: np.ndarray | None = None  # of every query the score that a corpus row must reach
        self.waiting: list[tuple] = []      # rows that reached it since the best were last taken
        self.held = 0

    def queries(self, keys: pa.Array, vectors: pa.Array) -> None:
        at, rows = unit_rows(vectors)
        if len(at):
            self.keys.append(keys.take(pa.array(at)))
            self.parts.append(rows)

    def corpus(self, ids: pa.Array, vectors: pa.Array) -> None:
        if self.matrix is None:
            if not self.parts:
                return
            self.matrix = np.concatenate(self.parts)
            self.names = pa.concat_arrays(self.keys)
            self.plain = self.names.to_numpy(zero_copy_only=False)
            self.low = np.full(len(self.matrix), -np.inf)
            self.parts, self.keys = [], []
        at, rows = unit_rows(vectors)
        if not len(at):
            return
        if rows.shape[1] != self.matrix.shape[1]:
            raise ValueError(f"query vectors have {self.matrix.shape[1]} numbers, corpus vectors {rows.shape[1]}")
        ids = ids.take(pa.array(at)).to_numpy(zero_copy_only=False)
        kk = min(self.k, len(ids))
        for s in range(0, len(self.matrix), QUERY_CHUNK):
            sc = self.matrix[s:s + QUERY_CHUNK] @ rows.T
            if self.exclude_self:
                without_self(sc, self.plain[s:s + QUERY_CHUNK], ids)
            low = self.low[s:s + QUERY_CHUNK]
            new = np.flatnonzero(low == -np.inf)  # queries that have not seen k rows yet
            if len(new) and sc.shape[1] >= self.k:
                low[new] = -np.partition(-sc[new], kk - 1, axis=1)[:, kk - 1] - MARGIN
            r, c = np.nonzero(sc >= low[:, None])
            found = sc[r, c]
            if not np.isfinite(found).all():
                r, c, found = (x[np.isfinite(found)] for x in (r, c, found))
            self.waiting.append(((r + s).astype(np.int32), ids[c], found))
            self.held += len(found)
            if self.held >= HELD:
                self._settle()

    def _settle(self) -> None:
        """Keep the best of every query, and raise the scores to reach."""
        if not self.waiting:
            return
        old = [(self.qi, self.ids, self.sc)] if self.ids is not None else []
        parts, self.waiting, self.held = old + self.waiting, [], 0
        self.qi, self.ids, self.sc = best_of(*(np.concatenate(x) for x in zip(*parts)), self.k)
        starts = np.r_[0, np.flatnonzero(np.diff(self.qi)) + 1] if len(self.qi) else np.zeros(0, np.int64)
        full = starts[np.diff(np.r_[starts, len(self.qi)]) >= self.k]
        # best first: the k-th row of a query has its k-th best score
        self.low[self.qi[full]] = np.maximum(self.low[self.qi[full]], self.sc[full + self.k - 1] - MARGIN)

    def result(self, types: tuple) -> pa.RecordBatch | None:
        self._settle()
        if self.ids is None or not len(self.sc):
            return None
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.qi)), pa.array(self.ids, types[1]), pa.array(self.sc)],
                                          names=["q", "id", "score"])


def _score_cells(k: int, exclude_self: bool, types: tuple):
    def run(batches):
        now, cell = None, None
        for b in batches:
            number, kind = b.column("cell").to_numpy(), b.column("kind").to_numpy()
            ends = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip(np.r_[0, ends], np.r_[ends, len(number)]):
                if e <= s:
                    continue
                if number[s] != now:
                    if cell is not None and (out := cell.result(types)) is not None:
                        yield out
                    now, cell = number[s], _Cell(k, exclude_self)
                for i in range(int(s), int(e), CORPUS_CHUNK):
                    n = min(CORPUS_CHUNK, int(e) - i)
                    if kind[s] == 0:
                        cell.queries(b.column("q").slice(i, n), b.column("v").slice(i, n))
                    else:
                        cell.corpus(b.column("id").slice(i, n), b.column("v").slice(i, n))
        if cell is not None and (out := cell.result(types)) is not None:
            yield out
    return run


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def dense_candidates(queries: DataFrame, corpus: DataFrame, k: int, q_col: str = "q", id_col: str = "id",
                     vec_col: str = "embedding", exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
                     parts: int | None = None) -> DataFrame:
    """``(q, id, score)``: for every query at least its k nearest corpus rows
    by cosine. Ids keep their types (numbers, text or dates)."""
    spark = queries.sparkSession
    # every cut of the corpus gives each query k more rows: two tasks a core are enough
    parts = parts or 2 * spark.sparkContext.defaultParallelism
    # equal rows are one query; counted and measured while they are written once
    size = Observation()
    q = (queries.select(F.col(q_col).alias("q"), F.col(vec_col).alias("v")).filter("q is not null and v is not null").dropDuplicates()
         .observe(size, F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")))
    q = cut_lineage(q)
    n, dim = size.get["n"], size.get["dim"] or 0
    c = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")
    # the larger number of query blocks, the oftener the corpus is sent: only as many as memory asks for
    rows = max(1, -(-n * dim * 8 // block_bytes))
    estimate = c._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cols = max(1, min(-(-parts // rows), int(str(estimate)) // CORPUS_BYTES))
    same = _type(q, "v") == _type(c, "v")

    def vector(col: str) -> Column:
        return F.col(col) if same else F.col(col).cast("array<double>")

    def side(df: DataFrame, block: Column, first: Column, step: int, copies: int, kind: int) -> DataFrame:
        cell = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda i: (first + i * step).cast("int"))
        q_id, c_id = (F.col("q"), F.lit(None).cast(_type(c, "id"))) if kind == 0 else (F.lit(None).cast(_type(q, "q")), F.col("id"))
        return df.withColumn("block", block).select(F.explode(cell).alias("cell"), F.lit(kind).alias("kind"), q_id.alias("q"), c_id.alias("id"),
                                                    vector("v").alias("v"))

    # cell = query block * cols + corpus block; copies of one corpus row come from many
    # partitions, whose numbers deal them to many cells
    both = side(q, F.pmod(F.xxhash64("q", "v"), F.lit(rows)), F.col("block") * cols, 1, cols, 0).unionAll(
        side(c, F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(cols)), F.col("block"), cols, rows, 1))
    cells = both.repartitionById(rows * cols, F.col("cell")).sortWithinPartitions("cell", "kind")
    types = (_ARROW[_type(q, "q")], _ARROW[_type(c, "id")])
    return cells.mapInArrow(_score_cells(k, exclude_self, types), f"q {_type(q, 'q')}, id {_type(c, 'id')}, score double")


def dense_scores(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    """``(q, id, score)`` with one row for a query and a corpus id: the best
    score, if either has several vectors."""
    return dense_candidates(queries, corpus, k, **kw).groupBy("q", "id").agg(F.max("score").alias("score"))
