"""A stored inverted index for exact BM25 top-k with block bounds (R8 at scale).

Documents are numbered where they stand: ``SPAN`` rows that follow each other
in a partition are a span. The index holds one row for every span: the ids of
its documents, its terms in order, and for each term the documents that have it
(places in the span), their weights, and the largest weight. Spans are the same
for all terms, so the bounds of a query's terms add up to a bound of every span
of documents. A span is one row, so whatever is asked of it is answered where
the row is: the index is made and searched without moving a posting.

A batch of queries is answered in two passes. The spans of highest bound are
scored first; the k-th best score so far then rules out, for each query, all
spans whose bound is below it, and only the rest is scored. Every document is in
one span, so both passes give whole scores and the result is exact. Of what a
task has scored, only what can be among the k best leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, analysed_tokens, tokens
from ..sources.io import build_or_load
from . import retrieval as rt
from .dense import best_of
from .distributed import cut_lineage, is_small, top_k_per_group

SPAN = 128          # documents of a block
FIRST_SPANS = 4     # spans scored before the threshold is known
MAX_WANTED = 2_000_000  # (query, span) rows that may be sent to every task
MARGIN = 1e-6       # ranks are by scores rounded to 6 places
ROWS = 16 * SPAN    # documents whose words are counted at a time
HELD = 1 << 16      # found rows that wait until the best are taken
POSTINGS = 1 << 18  # postings of a span multiplied at a time
GROUP = {"parquet.block.size": 4 << 20, "parquet.block.row.count.limit": 32}  # a row group, which a scan decodes at once


def _span_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, span, ord, w) sorted by span to one row (term, span, top,
    ords, weights) a term and span. The span that a batch ends in (the words of
    ``SPAN`` documents) waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        span = batch["span"].to_numpy()
        if not len(span):
            continue
        last = int(np.searchsorted(span, span[-1]))  # where the last span begins
        if held and held[0]["span"][0].as_py() != span[-1]:
            yield _blocks([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield _blocks([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield _blocks(held)


def _blocks(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The blocks of whole spans."""
    t = pa.Table.from_batches(batches).combine_chunks()
    words = t["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    code, span, ords = place[words.indices.to_numpy()], t["span"].to_numpy(), t["ord"].to_numpy()
    by = np.lexsort((ords, code, span))
    code, span, w = code[by], span[by], t["w"].to_numpy()[by]
    starts = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (span[1:] != span[:-1])) + 1])
    ends = pa.array(np.concatenate([starts, [len(by)]]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(order[code[starts]])), pa.array(span[starts]), pa.array(np.maximum.reduceat(w, starts)),
         pa.ListArray.from_arrays(ends, pa.array(ords[by])), pa.ListArray.from_arrays(ends, pa.array(w))],
        names=["term", "span", "top", "ords", "weights"])


def _postings(batches: Iterator[pa.RecordBatch], names: dict, average: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Rows (ord, id, words) to rows (term, span, ord, w) sorted by span, with
    the place in the span as ord; the ids of a span go to ``names``."""
    stops = pa.array(STOP_WORDS)
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        n, at = batch.num_rows, batch["ord"].to_numpy()
        span = at // SPAN
        starts = np.concatenate([[0], np.flatnonzero(span[1:] != span[:-1]) + 1, [n]])
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
            names.setdefault(int(span[i]), []).append(batch["id"].slice(i, j - i))
        words = batch["words"].flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), batch["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        kept = ~pc.is_in(words.dictionary, value_set=stops).to_numpy(zero_copy_only=False)[code]
        code, row = code[kept], row[kept]
        length = np.bincount(row, minlength=n)
        size = max(len(words.dictionary), 1)
        both, tf = np.unique(row * size + code, return_counts=True)
        row, code = both // size, both % size
        norm = k1 * (1.0 - b) + k1 * b / average * length[row]
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(code)), pa.array(span[row]), pa.array((at[row] % SPAN).astype(np.int32)),
             pa.array(tf * (k1 + 1.0) / (tf + norm))], names=["term", "span", "ord", "w"])


def _span_rows(average: float, k1: float, b: float):
    """Rows (ord, id, words) of documents to one row for every span that has words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, list[pa.Array]] = {}
        for block in _span_blocks(_postings(batches, names, average, k1, b)):
            span = block["span"].to_numpy()
            ends = np.concatenate([[0], np.flatnonzero(span[1:] != span[:-1]) + 1, [len(span)]]).astype(np.int32)
            spans = span[ends[:-1]]
            ids = [pa.concat_arrays(names[s]) for s in spans.tolist()]
            for s in [s for s in names if s <= spans[-1]]:
                del names[s]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.concat_arrays(ids))]
            lists += [pa.ListArray.from_arrays(pa.array(ends), x)
                      for x in (block["term"], block["top"], block["ords"].value_lengths(), block["ords"], block["weights"])]
            yield pa.RecordBatch.from_arrays([pa.array(spans), *lists], names=["span", "ids", "terms", "tops", "sizes", "ords", "weights"])
        pa.default_memory_pool().release_unused()  # the worker stays
    return run


class _Batch:
    """The query terms of a batch, as arrays that every task gets."""

    def __init__(self, qt: pa.Table, low: pa.Table | None = None, wanted: pa.Table | None = None):
        self.q = qt["q"].combine_chunks().unique()
        self.words = qt["term"].combine_chunks().unique()
        word = pc.index_in(qt["term"].combine_chunks(), value_set=self.words).to_numpy()
        order = np.argsort(word, kind="stable")
        self.code = self._codes(qt["q"])[order]
        self.weight = qt["weight"].to_numpy()[order]
        self.first = np.searchsorted(word[order], np.arange(len(self.words) + 1))  # of every word its place in code and weight
        self.low = np.full(len(self.q), -np.inf)
        if low is not None:
            self.low[self._codes(low["q"])] = low["low"].to_numpy()
        self.wanted: dict[int, np.ndarray] | None = None
        if wanted is not None:
            span, code = wanted["span"].to_numpy(), self._codes(wanted["q"])
            self.wanted = {int(s): code[span == s] for s in np.unique(span)}

    def _codes(self, q: pa.ChunkedArray) -> np.ndarray:
        return pc.index_in(q.combine_chunks(), value_set=self.q).to_numpy()

    def terms(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For every span of a batch (its row, blocks, queries, weights, bounds):
        a row of the arrays for each block of a word and query that asks for it,
        sorted by query; blocks are places in the flat lists; and the bound of
        every query (0: the span has none of its words)."""
        ends = batch["terms"].offsets.to_numpy()
        word = pc.index_in(batch["terms"].flatten(), value_set=self.words).fill_null(-1).to_numpy()
        tops = batch["tops"].flatten().to_numpy()
        for i in range(batch.num_rows):
            block = np.flatnonzero(word[ends[i] - ends[0]:ends[i + 1] - ends[0]] >= 0) + (ends[i] - ends[0])
            if not len(block):
                continue
            first = self.first[word[block]]
            times = self.first[word[block] + 1] - first
            place = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            block, code, weight = np.repeat(block, times), self.code[place], self.weight[place]
            by = np.argsort(code, kind="stable")
            block, code, weight = block[by], code[by], weight[by]
            yield i, block, code, weight, np.bincount(code, weights=weight * tops[block], minlength=len(self.q))


def _bound_rows(asked: _Batch):
    """(q, span, bound) of the spans that hold a term of a query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span = batch["span"].to_numpy()
            for i, _, _, _, bound in asked.terms(batch):
                code = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([asked.q.take(pa.array(code)), pa.array(np.full(len(code), span[i])), pa.array(bound[code])],
                                                 names=["q", "span", "bound"])
    return run


class _Best:
    """The best documents of every query among those that a task has scored."""

    def __init__(self, k: int, low: np.ndarray, kind: pa.DataType):
        self.k, self.low = k, low
        self.qi, self.sc, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, qi: np.ndarray, sc: np.ndarray, ids: pa.Array) -> None:
        self.waiting.append((qi, sc, ids))
        self.held += len(qi)
        if self.held >= HELD:
            self.settle()

    def settle(self) -> None:
        """Keep the best of every query, and raise the scores to reach."""
        if not self.waiting:
            return
        parts, self.waiting, self.held = [(self.qi, self.sc, self.ids), *self.waiting], [], 0
        names = pa.concat_arrays([p[2] for p in parts]).dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(names.dictionary, null_placement="at_start")
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        self.qi, at, self.sc = best_of(np.concatenate([p[0] for p in parts]), place[names.indices.to_numpy()], np.concatenate([p[1] for p in parts]), self.k)
        self.ids = names.dictionary.take(order.take(pa.array(at)))
        starts = np.r_[0, np.flatnonzero(np.diff(self.qi)) + 1] if len(self.qi) else np.zeros(0, np.int64)
        full = starts[np.diff(np.r_[starts, len(self.qi)]) >= self.k]
        # the k-th best of a query, whatever order its rows have
        if len(full):
            by = np.lexsort((-self.sc, self.qi))
            self.low[self.qi[full]] = np.maximum(self.low[self.qi[full]], self.sc[by][full + self.k - 1])


def _score_rows(asked: _Batch, k: int):
    """(q, id, score) of the documents that can be among the k best of a query:
    in the wanted spans, or in those whose bound reaches the lowest score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            best = best or _Best(k, asked.low.copy(), batch["ids"].type.value_type)
            span, first = batch["span"].to_numpy(), batch["ids"].offsets.to_numpy()
            ords, weights = batch["ords"].flatten(), batch["weights"].flatten()
            starts = ords.offsets.to_numpy() - ords.offsets[0].as_py()
            at, w = ords.flatten().to_numpy(), weights.flatten().to_numpy()
            ids = batch["ids"].flatten()
            for i, block, code, weight, bound in asked.terms(batch):
                reach = (bound > 0) & (bound >= best.low - MARGIN)
                if asked.wanted is not None:
                    own = np.zeros(len(bound), dtype=bool)
                    own[asked.wanted.get(int(span[i]), [])] = True
                    reach &= own
                if not reach.any():
                    continue
                queries = np.flatnonzero(reach)
                kept = reach[code]
                row, block, weight = np.searchsorted(queries, code[kept]), block[kept], weight[kept]
                sizes = starts[block + 1] - starts[block]
                score, done, ends = np.zeros(len(queries) * SPAN), 0, np.cumsum(sizes)
                while done < len(block):  # some postings at a time
                    stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + POSTINGS, "right")))
                    n = sizes[done:stop]
                    place = np.repeat(starts[block[done:stop]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    low, high = row[done] * SPAN, (row[stop - 1] + 1) * SPAN
                    score[low:high] += np.bincount(np.repeat(row[done:stop], n) * SPAN + at[place] - low, weights=np.repeat(weight[done:stop], n) * w[place],
                                                   minlength=high - low)
                    done = stop
                found = np.flatnonzero((score > 0) & (score >= np.repeat(best.low[queries] - MARGIN, SPAN)))
                best.add(queries[found // SPAN], score[found], ids.take(pa.array(found % SPAN + (first[i] - first[0]))))
        if best is not None:
            best.settle()
            if len(best.qi):
                yield pa.RecordBatch.from_arrays([asked.q.take(pa.array(best.qi)), best.ids, pa.array(best.sc)], names=["q", "id", "score"])
        pa.default_memory_pool().release_unused()
    return run


@dataclass
class BlockMaxIndex:
    spans: DataFrame     # (span, ids, terms, tops, sizes, ords, weights): one row for every span
    terms: DataFrame     # (term, idf)

    @classmethod
    def build_or_load(cls, spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      k1: float = rt.BM25_K1, b: float = rt.BM25_B, recreate: bool = False) -> "BlockMaxIndex":
        """The index stored under ``path``, built if it is not there. Ids are
        distinct; a document without words takes part in the averages only."""
        base = path.rstrip("/")
        d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        totals: list = []

        def corpus():
            if not totals:  # two numbers
                totals.append(d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(analysed_tokens("text"))).alias("length")).first())
            return totals[0]

        def spans() -> DataFrame:
            rows = d.select(F.monotonically_increasing_id().alias("ord"), "id", tokens("text").alias("words"))
            kind = d.schema["id"].dataType.simpleString()
            return rows.mapInArrow(_span_rows(corpus()["length"] or 1.0, k1, b), f"span bigint, ids array<{kind}>, terms array<string>, tops array<double>, "
                                   "sizes array<int>, ords array<array<int>>, weights array<array<double>>")

        def idfs() -> DataFrame:
            n_docs = F.lit(corpus()["n"])
            df = stored.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("sizes").alias("n")))).groupBy("term").agg(F.sum("n").alias("df"))
            return df.select("term", F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))).alias("idf"))

        stored = build_or_load(spark, base + "/spans", spans, recreate, **GROUP)
        return cls(stored, build_or_load(spark, base + "/terms", idfs, recreate))

    def search(self, queries: DataFrame, k: int = rt.SPARSE_TOP_K, q_col: str = "q", text_col: str = "text",
               with_status: bool = False):
        """(q, rank, doc, score): exact BM25 top-k of every query; with
        ``with_status`` also (q, spans, scored): how many spans hold a term of
        the query, and how many were scored. A query without known terms has no
        rows."""
        qt = rt.query_terms(queries, q_col, text_col).join(self.terms, "term").select("q", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        qt = cut_lineage(qt)
        small = is_small(qt)
        bounds = self._bounds(qt, small)
        first = cut_lineage(top_k_per_group(bounds, ["q"], [F.col("bound").desc(), F.col("span")], FIRST_SPANS, "_n").select("q", "span"))
        early = rt.ranked_top_k(self._scores(qt, k, small, wanted=first), ["q"], "score", "id", k)
        theta = early.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min(F.round("score", rt.SCORE_DIGITS)).alias("low")).filter(F.col("n") >= k)
        theta = cut_lineage(theta.select("q", "low"))
        left = (bounds.join(theta, "q", "left").filter(F.col("low").isNull() | (F.col("bound") >= F.col("low") - F.lit(MARGIN))).select("q", "span"))
        found = self._scores(qt, k, small, low=theta) if small else self._scores(qt, k, small, wanted=left)
        top = rt.ranked_top_k(found, ["q"], "score", "id", k)
        out = top.select("q", "rank", F.col("id").alias("doc"), F.round("score", rt.SCORE_DIGITS).alias("score"))
        if not with_status:
            return out
        read = first.union(left).distinct().groupBy("q").agg(F.count(F.lit(1)).alias("scored"))
        return out, bounds.groupBy("q").agg(F.count(F.lit(1)).alias("spans")).join(read, "q")

    def _blocks(self) -> DataFrame:
        """(span, ids, term, top, ords, weights): one row for each term of a span."""
        zipped = F.arrays_zip(F.col("terms").alias("term"), F.col("tops").alias("top"), "ords", "weights")
        return self.spans.select("span", "ids", F.inline(zipped))

    def _bounds(self, qt: DataFrame, small: bool) -> DataFrame:
        """(q, span, bound) of all spans with a term of the query."""
        if small:
            kind = qt.schema["q"].dataType.simpleString()
            return self.spans.select("span", "terms", "tops").mapInArrow(_bound_rows(_Batch(qt.toArrow())), f"q {kind}, span bigint, bound double")
        blocks = self._blocks().select("term", "span", "top")
        return blocks.join(qt, "term").groupBy("q", "span").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))

    def _scores(self, qt: DataFrame, k: int, small: bool, wanted: DataFrame | None = None, low: DataFrame | None = None) -> DataFrame:
        """(q, id, score) of all documents in the wanted (q, span), or of those
        whose span can hold one of at least the lowest score; what cannot be
        among the k best may be left out."""
        if small and (wanted is None or is_small(wanted, MAX_WANTED)):  # the spans stay where they are
            spans = self.spans
            if wanted is not None:
                spans = spans.join(F.broadcast(wanted.select("span").distinct()), "span", "left_semi")
            asked = _Batch(qt.toArrow(), low=None if low is None else low.toArrow(), wanted=None if wanted is None else wanted.toArrow())
            q, ids = qt.schema["q"].dataType.simpleString(), self.spans.schema["ids"].dataType.elementType.simpleString()
            return spans.mapInArrow(_score_rows(asked, k), f"q {q}, id {ids}, score double")
        hit = self._blocks().select("term", "span", "ords", "weights").join(wanted.join(qt, "q"), ["term", "span"])
        each = hit.select("q", "span", "weight", F.explode(F.arrays_zip("ords", "weights")).alias("e"))
        each = each.groupBy("q", "span", F.col("e.ords").alias("ord")).agg(F.sum(F.col("weight") * F.col("e.weights")).alias("score"))
        return each.join(self.spans.select("span", "ids"), "span").select("q", F.get("ids", F.col("ord")).alias("id"), "score")
