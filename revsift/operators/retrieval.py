"""Batch retrieval (R6-R12, R15, J8, J10): BM25, dense top-k, MMR, reciprocal
rank fusion, rerank and hybrid search. A whole batch of queries runs as one
Spark plan; no per-query loop.

Ranking rule everywhere: ``round(score, 6)`` descending, then id ascending,
numbered from 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analysed_tokens, drop_stop_words, keyword_text, stop_array, tokens
from .distributed import (DEFAULT_BROADCAST_ROWS, broadcast_if_small, cut_lineage, dealt, is_small, salted,
                          top_k_per_group)
from .dense import dense_scores, unit_rows
from .embed import DEFAULT_DIM, hash_embed, hash_embed_from_postings

# --- fixed values (published defaults) ----------------------------------------
BM25_K1 = 1.5           # Robertson & Zaragoza 2009
BM25_B = 0.75
RRF_K0 = 60             # Cormack, Clarke & Buettcher 2009
DENSE_TOP_K = 50
SPARSE_TOP_K = 50
FUSION_TOP_K = 50
RERANK_TOP_K = 20
MMR_LAMBDA = 0.5        # Carbonell & Goldstein 1998
# ------------------------------------------------------------------------------

SCORE_DIGITS = 6


def rank_order(score_col: str, id_col: str) -> list:
    return [F.round(F.col(score_col), SCORE_DIGITS).desc(), F.col(id_col).asc()]


def ranked_top_k(df: DataFrame, q_cols: list, score_col: str, id_col: str, k: int,
                 rank_col: str = "rank") -> DataFrame:
    """Top-k per query by the ranking rule, with a 1-based rank column.

    ``row_number() <= k`` is planned as WindowGroupLimit (partial before the
    shuffle, final after), so a query with a huge candidate list ships at
    most k rows per map partition."""
    return top_k_per_group(df, q_cols, rank_order(score_col, id_col), k, rank_col)


# ------------------------------------------------------------------------------
# BM25 (R8, J10, A9)
# ------------------------------------------------------------------------------
def corpus_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    terms: DataFrame | None = None, span: Column | None = None) -> DataFrame:
    """The corpus tokenised once: (doc, dl, term, tf, first, stop) with one
    row per distinct token of a document (stop words included and flagged),
    ``dl`` = analysed length (stop words excluded), ``first`` marking exactly
    one row per document, and one NULL-term row for a document without
    tokens. BM25 reads the non-stop rows; the hashing embedder reads all rows
    (sign x tf per distinct token equals the per-occurrence sum).

    With ``terms`` (term; small, see ``asked_terms``) only their rows are made,
    and the ``first`` row of every document: N, avgdl and the df of those terms
    stay exact. With (term, stem), analysed words that are not stop words, the
    rows have stems for terms.

    The texts are dealt by document (``dealt``), so that no later grouping by
    document and more moves a posting. With ``span`` (an expression of ``doc``)
    they are dealt by it and it is a column: all postings of a span are in one
    partition. ``posexplode_outer`` keeps Catalyst from
    inferring a non-empty filter and running the tokeniser below the shuffle."""
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"))
    d = dealt(d, "doc") if span is None else dealt(d.withColumn("span", span), "span")
    ids = ["doc"] if span is None else ["span", "doc"]
    # dl is computed once per document, in its own projection below the
    # explode (next to the explode it would be re-evaluated for every token)
    toks = d.select(*ids, tokens("_text").alias("_t"))
    toks = toks.select(*ids, "_t", F.size(drop_stop_words(F.col("_t"))).alias("dl"))
    ex = toks.select(*ids, "dl", F.posexplode_outer("_t").alias("pos", "term"))
    stems = terms is not None and "stem" in terms.columns
    if terms is not None:
        ex = ex.join(F.broadcast(terms.select("term", F.lit(True).alias("_asked"), *["stem"] * stems)), "term", "left")
        ex = ex.filter(F.col("_asked") | F.col("pos").isNull() | (F.col("pos") == 0))
        ex = ex.withColumn("term", F.when(F.col("_asked"), F.col("stem" if stems else "term")))
    g = ex.groupBy(*ids, "dl", "term").agg(
        F.count(F.lit(1)).alias("tf"), (F.coalesce(F.min("pos"), F.lit(0)) == 0).alias("first"))
    if stems:  # of analysed words; a stem that is spelled as a stop word is none
        return g.withColumn("stop", F.lit(False))
    return g.withColumn("stop", F.coalesce(F.array_contains(stop_array(), F.col("term")), F.lit(False)))


def asked_terms(queries: DataFrame, q_col: str = "q", text_col: str = "text",
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame | None:
    """The distinct analysed terms of a batch, or None if they are too many to broadcast."""
    qt = query_terms(queries, q_col, text_col).select("term").distinct()
    return qt if is_small(qt, max_broadcast_rows) else None


def bm25_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  corpus: DataFrame | None = None, terms: DataFrame | None = None, span: Column | None = None) -> DataFrame:
    """(doc, dl, term, tf, first) for BM25: the corpus postings without stop
    words (a document keeps its ``first`` row, with a NULL term, so N and
    avgdl still count it)."""
    c = corpus if corpus is not None else corpus_postings(docs, id_col, text_col, terms, span)
    return (c.filter(~F.col("stop") | F.col("first"))
             .withColumn("term", F.when(F.col("stop"), F.lit(None).cast("string")).otherwise(F.col("term")))
             .drop("stop"))


def bm25_corpus_stats(postings: DataFrame) -> DataFrame:
    """One row: N documents and the average analysed length."""
    return postings.filter(F.col("first")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def stem_postings(postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """Re-key postings by stem: tf summed over the words sharing a stem.
    ``vocab`` (term, stem) is one row per distinct word; it is broadcast
    after a bounded size check, else joined by shuffle (AQE splits a hot
    term)."""
    v, _ = broadcast_if_small(vocab, 2_000_000)
    p = postings.join(v, "term", "left").withColumn("term", F.coalesce(F.col("stem"), F.col("term")))
    return p.groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf"), F.max("first").alias("first"))


def bm25_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               materialise: bool = True, stem: bool = False, corpus: DataFrame | None = None,
               query_stems: DataFrame | None = None, terms: DataFrame | None = None):
    """(postings, stats): the corpus side of BM25, tokenised once. Unless a
    materialised ``corpus`` is passed, the postings are checkpointed
    (``cut_lineage``) so the document-frequency, corpus-statistics and
    scoring branches all read one copy; ``terms`` limits them to the terms of a
    batch (see ``corpus_postings``). ``stem=True`` applies the X3 stemmer
    to the distinct vocabulary and re-keys the postings by stem."""
    if stem:
        from ..functions.stem import stem_vocabulary
        if corpus is None and query_stems is not None and materialise:
            # the words come from a pass of their own; only words whose stem a
            # query uses can score, and all of those are kept, so df stays exact
            words = docs.select(F.explode(analysed_tokens(text_col)).alias("term"))
            qs, _ = broadcast_if_small(query_stems.select(F.col("term").alias("stem")).distinct())
            # written before the join, which (or the filter it implies) would else
            # go below the distinct and stem every occurrence
            vocab = cut_lineage(cut_lineage(stem_vocabulary(words)).join(qs, "stem", "left_semi"))
            if is_small(vocab):  # stemmed as they are counted
                base = cut_lineage(bm25_postings(docs, id_col, text_col, terms=vocab))
                return base, bm25_corpus_stats(base)
            base = cut_lineage(bm25_postings(docs, id_col, text_col))
            return cut_lineage(stem_postings(base, vocab)), bm25_corpus_stats(base)
        postings = bm25_postings(docs, id_col, text_col, corpus=corpus)
        # tokenise once and stem the distinct words once: both inputs of the
        # re-keying are materialised first
        base = cut_lineage(postings) if materialise and corpus is None else postings
        vocab = stem_vocabulary(base.filter(F.col("term").isNotNull()))
        vocab = cut_lineage(vocab) if materialise else vocab
        stats = bm25_corpus_stats(base)  # N and avgdl do not depend on stemming
        if query_stems is not None:
            # only words whose stem a query uses can score: re-key just their
            # postings (every word of such a stem is kept, so df stays exact)
            qs, _ = broadcast_if_small(query_stems.select(F.col("term").alias("stem")).distinct())
            vocab = vocab.join(qs, "stem", "left_semi")
            used, _ = broadcast_if_small(vocab.select("term"))
            base = base.join(used, "term", "left_semi")
        postings = stem_postings(base, vocab)
        if materialise:
            postings = cut_lineage(postings)
        return postings, stats
    postings = bm25_postings(docs, id_col, text_col, corpus=corpus, terms=terms)
    if materialise and corpus is None:
        postings = cut_lineage(postings)
    return postings, bm25_corpus_stats(postings)


def term_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Document frequency per analysed term (partial+final aggregation, so
    a term present in every document costs one row per map task)."""
    p = bm25_postings(docs, id_col, text_col)
    return p.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, q_col: str = "q", text_col: str = "text") -> DataFrame:
    """(q, term, qtf) for each query's analysed terms."""
    ex = queries.select(F.col(q_col).alias("q"), F.explode(analysed_tokens(text_col)).alias("term"))
    return ex.groupBy("q", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, q_col: str = "q", text_col: str = "text",
                id_col: str = "doc_id", doc_text_col: str = "text", k1: float = BM25_K1,
                b: float = BM25_B, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                salt_buckets: int = 16, index=None, stem: bool = False) -> DataFrame:
    """(q, doc, score) for every document sharing at least one term.

    The query-term table is bounded by the query batch, so it is checked
    and broadcast: postings stream past it with no shuffle of the corpus.
    Above the bound the posting join is a shuffle join salted on the term,
    so a term found in a third of the corpus is split over
    ``salt_buckets`` tasks."""
    qt = query_terms(queries, q_col, text_col)
    if stem:
        from ..functions.stem import stem_vocabulary
        qv = stem_vocabulary(qt)
        qv, _ = broadcast_if_small(qv, max_broadcast_rows)  # bounded by the query terms
        qt = cut_lineage(qt.join(qv, "term").groupBy("q", F.col("stem").alias("term"))
                           .agg(F.sum("qtf").alias("qtf")))  # read several times
    small = is_small(qt, max_broadcast_rows)
    if index is None:
        index = bm25_index(docs, id_col, doc_text_col, stem=stem, query_stems=qt if stem else None,
                           terms=qt.select("term").distinct() if small else None)
    postings, stats = index[0], index[1]
    stored_df = index[2] if len(index) > 2 else None  # (term, df) kept with a persisted index
    postings = postings.filter(F.col("term").isNotNull())
    if small:
        qterms = F.broadcast(qt.select("term").distinct())
        if stored_df is not None:
            dfreq = stored_df.join(qterms, "term", "left_semi")
        else:
            dfreq = postings.join(qterms, "term", "left_semi").groupBy("term").agg(
                F.count(F.lit(1)).alias("df"))
        qside = F.broadcast(qt.join(dfreq, "term").join(F.broadcast(stats)))
        m = postings.join(qside, "term")
    else:
        dfreq = stored_df if stored_df is not None else postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        qside = qt.join(dfreq, "term").join(F.broadcast(stats))
        m = (salted(postings, salt_buckets, F.col("doc"))
             .join(salted(qside, salt_buckets, replicate=True), ["term", "_salt"]))
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    contrib = F.col("qtf") * idf * F.col("tf") * F.lit(k1 + 1.0) / norm
    return m.groupBy("q", "doc").agg(F.sum(contrib).alias("score"))


def _bm25_contrib(k1: float, b: float) -> Column:
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    return F.col("qtf") * idf * F.col("tf") * F.lit(k1 + 1.0) / norm


def bm25_topk_pruned(queries: DataFrame, docs: DataFrame, k: int = SPARSE_TOP_K, q_col: str = "q",
                     text_col: str = "text", id_col: str = "doc_id", doc_text_col: str = "text",
                     k1: float = BM25_K1, b: float = BM25_B, index=None, rare_fraction: float = 0.1,
                     max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, margin: float = 1e-6,
                     with_status: bool = False):
    """Exact BM25 top-k with MaxScore-style pruning (Turtle & Flood 1995).

    1. Per query term: df and an upper bound ub = qtf * idf * max over
       postings of tf(k1+1)/(tf + k1(1-b+b dl/avgdl)), in one pass over the
       postings of the query terms (the query side is small and checked).
    2. Candidates = documents holding at least one of the query's *rare*
       terms (df <= rare_fraction * N); they are scored exactly (all terms).
    3. A document outside the candidates holds only common terms, so its
       score is at most U = sum of the common terms' ub. When the query has
       k candidates and U < (k-th candidate score) - margin, no such document
       can enter the top k: the candidates' top k is the exact answer.
    4. Queries failing the test are scored exhaustively, and only they.
    Common terms never expand into per-document rows for settled queries."""
    qt = query_terms(queries, q_col, text_col)
    if index is None:
        index = bm25_index(docs, id_col, doc_text_col, terms=asked_terms(queries, q_col, text_col, max_broadcast_rows))
    if not is_small(qt, max_broadcast_rows):
        # a query side too large to broadcast is scored exhaustively, by shuffle joins
        full = bm25_scores(queries, docs, q_col=q_col, text_col=text_col, k1=k1, b=b, max_broadcast_rows=max_broadcast_rows, index=index)
        out = ranked_top_k(full, ["q"], "score", "doc", k).select("q", "rank", "doc", F.round("score", SCORE_DIGITS).alias("score"))
        return (out, qt.select("q", F.lit(False).alias("safe")).distinct()) if with_status else out
    postings, stats = index[0], index[1]
    postings = postings.filter(F.col("term").isNotNull())
    weight = F.col("tf") * F.lit(k1 + 1.0) / (
        F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    qterms = F.broadcast(qt.select("term").distinct())
    tw = (postings.join(qterms, "term", "left_semi").join(F.broadcast(stats))
                  .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(weight).alias("maxw")))
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    # the query side: one row per (query, term), bounded by the checked batch
    qside = cut_lineage(qt.join(tw, "term").join(F.broadcast(stats))
                          .withColumn("ub", F.col("qtf") * idf * F.col("maxw"))
                          .withColumn("rare", F.col("df") <= F.col("n_docs") * F.lit(rare_fraction)))
    qs = qside.drop("maxw", "ub", "rare")
    contrib = _bm25_contrib(k1, b)
    cand = (postings.join(F.broadcast(qside.filter("rare").select("q", "term")), "term")
                    .select("q", "doc").distinct())
    # postings of the candidate documents only, then exact scores for them
    cdocs = cand.select("doc").distinct()
    pc = postings.join(cdocs, "doc", "left_semi")
    sc = (pc.join(F.broadcast(qs.drop("n_docs", "avgdl")).join(F.broadcast(stats)), "term")
            .groupBy("q", "doc").agg(F.sum(contrib).alias("score"))
            .join(cand, ["q", "doc"], "left_semi"))
    topc = ranked_top_k(sc, ["q"], "score", "doc", k)
    kth = topc.groupBy("q").agg(F.count(F.lit(1)).alias("n_c"),
                                F.min(F.round("score", SCORE_DIGITS)).alias("theta"))
    u = qside.filter(~F.col("rare")).groupBy("q").agg(F.sum("ub").alias("u"))
    status = (qside.select("q").distinct().join(kth, "q", "left").join(u, "q", "left")
                   .withColumn("safe", (F.col("n_c") >= k)
                               & (F.coalesce(F.col("u"), F.lit(0.0)) < F.col("theta") - F.lit(margin))))
    safe_q = F.broadcast(status.filter(F.col("safe")).select("q"))      # <= queries in the batch
    unsafe_q = F.broadcast(status.filter(~F.coalesce(F.col("safe"), F.lit(False))).select("q"))
    settled = topc.join(safe_q, "q", "left_semi")
    rest = qs.join(unsafe_q, "q", "left_semi")
    full = (postings.join(F.broadcast(rest), "term")
                    .groupBy("q", "doc").agg(F.sum(contrib).alias("score")))
    full_top = ranked_top_k(full, ["q"], "score", "doc", k)
    out = settled.select("q", "rank", "doc", "score").unionByName(full_top.select("q", "rank", "doc", "score"))
    out = out.select("q", "rank", "doc", F.round("score", SCORE_DIGITS).alias("score"))
    return (out, status) if with_status else out


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = SPARSE_TOP_K, q_col: str = "q",
              text_col: str = "text", dedupe: bool = False, prune: bool | None = None,
              prune_min_rows: int = 50_000_000, **kw) -> DataFrame:
    """(q, rank, doc, score) top-k BM25 per query.

    BM25 depends only on the query's analysed terms. With ``dedupe`` each
    distinct analysed query is scored once, under the smallest id that has
    it, and its (at most k) results are joined back to every query sharing
    it: worth it when a batch repeats queries.

    ``prune=True`` uses the exact MaxScore path (``bm25_topk_pruned``).
    ``prune=None`` decides from stored document frequencies (a persisted
    index): pruning when the exhaustive plan would emit more than
    ``prune_min_rows`` (query, document, term) contributions."""
    if dedupe:
        # rows of one id are one query, as in query_terms; its key is its analysed terms with their counts
        keyed = query_terms(queries, q_col, text_col).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("_terms"))
        words = F.flatten(F.transform("_terms", lambda t: F.array_repeat(t["term"], t["qtf"].cast("int"))))
        keyed = keyed.select("q", F.array_join(words, " ").alias("_key"))
        reps = keyed.groupBy("_key").agg(F.min("q").alias("_rep"))
        qmap = keyed.join(reps, "_key").select("q", "_rep")
        res = bm25_topk(reps.select(F.col("_rep").alias("q"), F.col("_key").alias("text")), docs, k=k,
                        prune=prune, prune_min_rows=prune_min_rows, **kw)
        return qmap.join(res.withColumnRenamed("q", "_rep"), "_rep").select("q", "rank", "doc", "score")
    index = kw.get("index")
    if prune is None and index is not None and len(index) > 2 and not kw.get("stem"):
        qt = query_terms(queries, q_col, text_col)
        if is_small(qt, kw.get("max_broadcast_rows", DEFAULT_BROADCAST_ROWS)):
            est = qt.join(index[2], "term").agg(F.sum("df").alias("n")).first()["n"] or 0
            prune = est > prune_min_rows
    # the pruned path knows neither stems nor batches beyond the broadcast bound;
    # the exhaustive one (salted when large) gives the same rows
    if prune and not kw.get("stem") and is_small(
            query_terms(queries, q_col, text_col), kw.get("max_broadcast_rows", DEFAULT_BROADCAST_ROWS)):
        kw2 = {x: v for x, v in kw.items() if x in ("id_col", "doc_text_col", "k1", "b", "index",
                                                  "max_broadcast_rows")}
        return bm25_topk_pruned(queries, docs, k=k, q_col=q_col, text_col=text_col, **kw2)
    s = bm25_scores(queries, docs, q_col=q_col, text_col=text_col, **kw)
    out = ranked_top_k(s, ["q"], "score", "doc", k)
    return out.select("q", "rank", "doc", F.round("score", SCORE_DIGITS).alias("score"))


# ------------------------------------------------------------------------------
# Dense search
# ------------------------------------------------------------------------------
def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = DENSE_TOP_K, q_col: str = "q",
               id_col: str = "id", vec_col: str = "embedding", exclude_self: bool = False, **kw) -> DataFrame:
    """(q, rank, id, score) exact cosine top-k of any vectors, ids of any
    type. Vectors that are null, zero or not finite, and rows without an id,
    take no part. A query id with several vectors is scored by its best; a
    corpus id is returned once. See ``dense`` for the plan."""
    found = dense_scores(queries, corpus, k, q_col=q_col, id_col=id_col, vec_col=vec_col, exclude_self=exclude_self, **kw)
    out = ranked_top_k(found, ["q"], "score", "id", k)
    return out.select("q", "rank", "id", F.round("score", SCORE_DIGITS).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays in double (interpreted HOF; for
    row-pair scoring, not for corpus-wide search)."""
    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(0.0).cast("double"),
                       lambda acc, p: acc + p["x"].cast("double") * p["y"].cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity in double; NULL when either side is zero/NULL."""
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))


def self_query_topk(queries: DataFrame, corpus: DataFrame, spec: dict, schema: list, **kw) -> DataFrame:
    """R15 from a filter spec: its filters select the corpus and its
    ``top_k``, if any, is the number of results per query."""
    from .prepare import FilterSpecError, filter_predicate
    k = spec.get("top_k")
    if k is not None:
        if not isinstance(k, int) or isinstance(k, bool) or k < 1:
            raise FilterSpecError(f"top_k must be a positive integer, not {k!r}")
        kw["k"] = k
    return filtered_dense_topk(queries, corpus, filter_predicate(spec.get("filters", []), schema), **kw)


def filtered_dense_topk(queries: DataFrame, corpus: DataFrame, predicate: Column, **kw) -> DataFrame:
    """The metadata predicate is applied to the corpus before scoring, so
    it reaches the Parquet scan as a pushed filter."""
    return dense_topk(queries, corpus.filter(predicate), **kw)


# ------------------------------------------------------------------------------
# MMR (R7)
# ------------------------------------------------------------------------------
def _mmr_group(k: int, lam: float):
    def run(group: pa.Table) -> pa.Table:
        at, vecs = unit_rows(group.column("embedding").combine_chunks())
        group = group.take(pa.array(at))
        ids = group.column("id").to_numpy()
        rel = group.column("score").to_numpy()
        # by score, then id; of several vectors of an id the first
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -rel))
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        ids, rel, vecs = ids[order], rel[order], vecs[order]
        lowest = np.argsort(np.argsort(ids))
        chosen: list[int] = []
        max_sim, left = np.zeros(len(ids)), np.ones(len(ids), bool)
        while len(chosen) < min(k, len(ids)):
            val = np.where(left, np.round(lam * rel - (1 - lam) * max_sim, 9) if chosen else rel, -np.inf)
            best = np.flatnonzero(val == val.max())
            j = int(best[np.argmin(lowest[best])])
            sim = vecs @ vecs[j]
            max_sim = np.maximum(max_sim, sim) if chosen else sim
            chosen.append(j)
            left[j] = False
        return pa.table({"q": group.column("q").slice(0, len(chosen)), "rank": pa.array(range(1, len(chosen) + 1), pa.int32()),
                         "id": pa.array(ids[chosen], group.schema.field("id").type)})
    return run


def mmr_topk(candidates: DataFrame, vectors: DataFrame, k: int = 10, lam: float = MMR_LAMBDA,
             id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Greedy maximal marginal relevance over bounded candidate lists,
    similarity by cosine, ids of any type.

    ``candidates`` is the output of ``dense_topk`` or ``rrf`` (at most its k
    rows per query), so each group is bounded; the greedy step is sequential
    by definition. A candidate without a usable vector is left out; of
    several vectors of an id one is taken."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    c = candidates.select("q", "id", "score").join(v, "id")
    types = {f.name: f.dataType.simpleString() for f in c.schema}
    return c.groupBy("q").applyInArrow(_mmr_group(k, lam), f"q {types['q']}, rank int, id {types['id']}")


# ------------------------------------------------------------------------------
# Fusion, cutoff, rerank, hybrid
# ------------------------------------------------------------------------------
def rrf(ranked_lists: list, k: int = FUSION_TOP_K, k0: int = RRF_K0, q_col: str = "q",
        id_col: str = "doc") -> DataFrame:
    """Reciprocal rank fusion of (q, id, rank) lists; absent = 0."""
    parts = [r.select(F.col(q_col).alias("q"), F.col(id_col).alias("doc"), "rank") for r in ranked_lists]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    fused = u.groupBy("q", "doc").agg(F.sum(F.lit(1.0) / (F.lit(k0) + F.col("rank"))).alias("score"))
    out = ranked_top_k(fused, ["q"], "score", "doc", k)
    return out.select("q", "rank", "doc", F.round("score", SCORE_DIGITS).alias("score"))


def score_cutoff(df: DataFrame, min_score: float | None, score_col: str = "score") -> DataFrame:
    """Drop rows scoring below ``min_score``; ``None`` disables it (0 is a
    real threshold)."""
    if min_score is None:
        return df
    return df.filter(F.col(score_col) >= F.lit(min_score))


def overlap_score(q_text: Column, d_text: Column) -> Column:
    """Default rerank scorer: share of the query's distinct analysed terms
    that occur in the passage (0 for an empty query)."""
    qt = F.array_distinct(analysed_tokens(q_text))
    dt = F.array_distinct(analysed_tokens(d_text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(qt, dt)).cast("double"),
                                   F.size(qt).cast("double")), F.lit(0.0))


def rerank(cands: DataFrame, queries: DataFrame, docs: DataFrame, k: int = RERANK_TOP_K,
           scorer=overlap_score, q_text_col: str = "text", doc_id_col: str = "doc_id",
           doc_text_col: str = "text") -> DataFrame:
    """Rescore (q, doc) candidates with a pair scorer, keep the top k.

    The candidate table is bounded by queries x fused depth; it is joined to
    the corpus first, by broadcast if it comes with that hint.
    ``scorer`` may be a pandas UDF (e.g. a cross-encoder plug-in)."""
    qtext = queries.select(F.col("q"), F.col(q_text_col).alias("_qtext"))
    dtext = docs.select(F.col(doc_id_col).alias("doc"), F.col(doc_text_col).alias("_dtext"))
    c = dtext.join(cands.select("q", "doc"), "doc").join(qtext, "q")
    scored = c.select("q", "doc", scorer(F.col("_qtext"), F.col("_dtext")).alias("score"))
    out = ranked_top_k(scored, ["q"], "score", "doc", k)
    return out.select("q", "rank", "doc", F.round("score", SCORE_DIGITS).alias("score"))


def rerank_overlap_postings(cands: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = RERANK_TOP_K,
                            q_text_col: str = "text", max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """R12 with the default overlap scorer, read from the corpus postings
    instead of re-tokenising every candidate text: (q, doc, term) rows for the
    query's distinct analysed terms (bounded by queries x depth x terms,
    checked and broadcast) meet the postings in one stream. Same scores as
    ``rerank(..., scorer=overlap_score)``."""
    qterms = (queries.select("q", F.explode(F.array_distinct(analysed_tokens(q_text_col))).alias("term")))
    nq = queries.select("q", F.size(F.array_distinct(analysed_tokens(q_text_col))).alias("_nq"))
    pairs = cands.select("q", "doc").join(qterms, "q")
    pairs, _ = broadcast_if_small(pairs, max_broadcast_rows)
    post = corpus.filter(F.col("term").isNotNull() & ~F.col("stop")).select("doc", "term")
    matched = post.join(pairs, ["doc", "term"]).groupBy("q", "doc").agg(F.count(F.lit(1)).alias("_m"))
    scored = (cands.select("q", "doc").join(matched, ["q", "doc"], "left").join(nq, "q")
                   .select("q", "doc", F.coalesce(F.try_divide(F.coalesce(F.col("_m"), F.lit(0)).cast("double"),
                                                                F.col("_nq").cast("double")), F.lit(0.0))
                            .alias("score")))
    out = ranked_top_k(scored, ["q"], "score", "doc", k)
    return out.select("q", "rank", "doc", F.round("score", SCORE_DIGITS).alias("score"))


def query_variants(queries: DataFrame, q_col: str = "q", text_col: str = "text") -> DataFrame:
    """R9 re-aimed: each query (``v`` 0) plus its keyword form (1). ``qv``
    names the pair as text, whatever the type of the query ids."""
    orig = queries.select(F.col(q_col).alias("q"), F.lit(0).alias("v"), F.col(text_col).alias("text"))
    kw = queries.select(F.col(q_col).alias("q"), F.lit(1).alias("v"), keyword_text(text_col).alias("text"))
    return orig.unionByName(kw).withColumn("qv", F.concat(F.col("v").cast("string"), F.lit(":"), F.col("q").cast("string")))


def variant_query(qv: str, id_type: str) -> Column:
    """The query id of a ``qv``, in its own type."""
    return F.expr(f"substring({qv}, 3)").cast(id_type)


def hybrid_candidates(queries: DataFrame, docs: DataFrame, q_col: str = "q", text_col: str = "text",
                      doc_id_col: str = "doc_id", doc_text_col: str = "text",
                      dense_k: int = DENSE_TOP_K, sparse_k: int = SPARSE_TOP_K,
                      fusion_k: int = FUSION_TOP_K, dim: int = DEFAULT_DIM,
                      doc_vectors: DataFrame | None = None, corpus: DataFrame | None = None,
                      bm25=None) -> DataFrame:
    """Dense + BM25 for the original and keyword query, fused by RRF:
    (q, rank, doc, score). ``doc_vectors`` (doc_id, embedding) may come from a
    persisted vector table; otherwise the hashing embedder builds them."""
    qv = query_variants(queries, q_col, text_col)
    # words read the postings of the batch's terms, vectors those of all words, which are not kept
    words = corpus
    if words is None:
        words = cut_lineage(corpus_postings(docs, doc_id_col, doc_text_col, asked_terms(queries, q_col, text_col)))
    # both forms are searched by words and by vectors; forms with the same analysed terms are scored once
    sparse = bm25_topk(qv.select(F.col("qv").alias("q"), "text"), docs, k=sparse_k, dedupe=True, id_col=doc_id_col, text_col="text", doc_text_col=doc_text_col,
                       index=bm25 if bm25 is not None else bm25_index(docs, corpus=words))
    if doc_vectors is None:
        every = corpus if corpus is not None else corpus_postings(docs, doc_id_col, doc_text_col)
        doc_vectors = hash_embed_from_postings(every, dim).withColumnRenamed("doc", doc_id_col)
    qvec = hash_embed(qv.select("qv", "text"), "qv", "text", dim)
    dense = dense_topk(qvec, doc_vectors, k=dense_k, q_col="qv", id_col=doc_id_col)
    question = variant_query("q", queries.schema[q_col].dataType.simpleString()).alias("q")
    lists = [sparse.select(question, "doc", "rank"), dense.select(question, F.col("id").alias("doc"), "rank")]
    return rrf(lists, k=fusion_k)


def hybrid_search(queries: DataFrame, docs: DataFrame, q_col: str = "q", text_col: str = "text",
                  doc_id_col: str = "doc_id", doc_text_col: str = "text",
                  min_score: float | None = None, rerank_k: int = RERANK_TOP_K,
                  scorer=overlap_score, **kw) -> DataFrame:
    """R11/R16 flagship: fused candidates -> score cutoff -> rerank top-k.
    The postings of the batch's terms (checkpointed) are shared by BM25 and the
    default reranker; the hashed vectors are made from all words, which are not kept."""
    corpus = cut_lineage(corpus_postings(docs, doc_id_col, doc_text_col, asked_terms(queries, q_col, text_col)))
    kw.setdefault("bm25", bm25_index(docs, corpus=corpus))
    if kw.get("doc_vectors") is None:
        kw["doc_vectors"] = hash_embed_from_postings(corpus_postings(docs, doc_id_col, doc_text_col), kw.get("dim", DEFAULT_DIM)).withColumnRenamed("doc", doc_id_col)
    fused = hybrid_candidates(queries, docs, q_col, text_col, doc_id_col, doc_text_col, corpus=corpus, **kw)
    fused = cut_lineage(score_cutoff(fused, min_score))  # bounded by queries x depth; the reranker reads it twice
    qs = queries.select(F.col(q_col).alias("q"), F.col(text_col).alias("text"))
    if scorer is overlap_score:
        return rerank_overlap_postings(fused, qs, corpus, k=rerank_k)
    return rerank(fused, qs, docs, k=rerank_k, scorer=scorer, doc_id_col=doc_id_col,
                  doc_text_col=doc_text_col)
