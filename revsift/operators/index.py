"""A persisted hybrid retrieval index (R5 + S8 + S9 for search).

At scale the corpus is tokenised, hashed and written once; every later
batch of queries reads the stored postings and vectors instead of passing
over the raw text again. Both tables are plain Parquet under one folder
(give a folder that every executor can read, e.g. under
``spark.checkpoint.dir``); ``recreate=True`` rebuilds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import VectorTable, build_or_load
from . import retrieval as rt
from .blockmax import BlockMaxIndex
from .chunking import build_index
from .distributed import broadcast_if_small, cut_lineage
from .embed import DEFAULT_DIM, hash_embed, hash_embed_from_postings


@dataclass
class HybridIndex:
    postings: DataFrame          # corpus postings (doc, dl, term, tf, first, stop)
    vectors: DataFrame           # (doc_id, embedding) unit vectors
    docs: DataFrame              # (doc_id, text), read only by plug-in rerankers
    terms: DataFrame             # (term, df) for BM25, analysed terms only
    stats: DataFrame             # one row: n_docs, avgdl
    dim: int = DEFAULT_DIM

    @classmethod
    def build_or_load(cls, spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", dim: int = DEFAULT_DIM, recreate: bool = False) -> "HybridIndex":
        base = path.rstrip("/")
        postings = build_or_load(spark, base + "/postings",
                                 lambda: rt.corpus_postings(docs, id_col, text_col), recreate)
        vt = VectorTable(base + "/vectors", dim)
        if recreate or not vt.exists(spark):
            vt.write(hash_embed_from_postings(postings, dim).select(F.col("doc").alias("doc_id"), "embedding"))
        bm = rt.bm25_postings(None, corpus=postings)
        terms = build_or_load(spark, base + "/terms", lambda: bm.filter(F.col("term").isNotNull())
                              .groupBy("term").agg(F.count(F.lit(1)).alias("df")), recreate)
        stats = build_or_load(spark, base + "/stats", lambda: rt.bm25_corpus_stats(bm), recreate)
        return cls(postings, vt.read(spark), docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                   terms, stats, dim)

    def bm25_index(self):
        """(postings, stats, term df): document frequencies are looked up,
        not re-aggregated, for every query batch."""
        return rt.bm25_postings(None, corpus=self.postings), self.stats, self.terms

    def bm25(self, queries: DataFrame, k: int = rt.SPARSE_TOP_K, **kw) -> DataFrame:
        return rt.bm25_topk(queries, self.docs, k=k, index=self.bm25_index(), **kw)

    def dense(self, queries: DataFrame, k: int = rt.DENSE_TOP_K) -> DataFrame:
        from .embed import hash_embed
        qv = hash_embed(queries.select("q", "text"), "q", "text", self.dim)
        return rt.dense_topk(qv, self.vectors, k=k, id_col="doc_id")

    def search(self, queries: DataFrame, min_score: float | None = None, rerank_k: int = rt.RERANK_TOP_K,
               scorer=rt.overlap_score) -> DataFrame:
        """Hybrid search over the stored index: (q, rank, doc, score)."""
        fused = rt.hybrid_candidates(queries, self.docs, doc_vectors=self.vectors, corpus=self.postings,
                                     bm25=self.bm25_index())
        fused = cut_lineage(rt.score_cutoff(fused, min_score))
        qs = queries.select("q", "text")
        if scorer is rt.overlap_score:
            return rt.rerank_overlap_postings(fused, qs, self.postings, k=rerank_k)
        return rt.rerank(fused, qs, self.docs, k=rerank_k, scorer=scorer)


@dataclass
class ChunkIndex:
    """Retrieval over the chunks of a corpus (R5, R11, R16): the stored nodes,
    their vectors, and a block-max index of their words, all under one
    folder. Results name nodes by their text ids."""

    nodes: DataFrame             # (node_id, doc_id, chunk_no, text, metadata, embedding)
    vectors: DataFrame           # (node_id, doc_id, embedding) unit vectors
    words: BlockMaxIndex
    dim: int = DEFAULT_DIM

    @classmethod
    def build_or_load(cls, spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      meta_cols: list = (), dim: int = DEFAULT_DIM, recreate: bool = False) -> "ChunkIndex":
        base = path.rstrip("/")
        nodes = build_index(spark, docs, base, recreate, id_col, text_col, meta_cols, dim)
        words = BlockMaxIndex.build_or_load(spark, base + "/words", nodes, "node_id", "text", recreate=recreate)
        return cls(nodes, VectorTable(base + "/vectors", dim).read(spark), words, dim)

    def sparse(self, queries: DataFrame, k: int = rt.SPARSE_TOP_K) -> DataFrame:
        return self.words.search(queries, k)

    def dense(self, queries: DataFrame, k: int = rt.DENSE_TOP_K) -> DataFrame:
        """(q, v, rank, doc, score): nearest nodes of each question (v 0) and
        of its keyword form (v 1), in one search."""
        kind = queries.schema["q"].dataType.simpleString()
        forms = hash_embed(rt.query_variants(queries).select("qv", "text"), "qv", "text", self.dim)
        found = rt.dense_topk(forms, self.vectors, k=k, q_col="qv", id_col="node_id")
        return found.select(rt.variant_query("q", kind).alias("q"), F.left("q", F.lit(1)).cast("int").alias("v"), "rank", F.col("id").alias("doc"), "score")

    def candidates(self, queries: DataFrame, fusion_k: int = rt.FUSION_TOP_K, dense_k: int = rt.DENSE_TOP_K,
                   sparse_k: int = rt.SPARSE_TOP_K) -> DataFrame:
        """Fused (q, rank, doc, score), written once. The keyword form has the
        same analysed words as the question, so words give one list; vectors
        give two."""
        # one after the other: a worker holds the arrays of one search
        sparse = cut_lineage(self.sparse(queries, sparse_k).select("q", "doc", "rank"))
        dense = self.dense(queries, dense_k).select("q", "doc", "rank")
        return cut_lineage(rt.rrf([sparse, dense], k=fusion_k))

    def search(self, queries: DataFrame, mode: str = "hybrid", min_score: float | None = None, k: int = rt.RERANK_TOP_K,
               scorer=rt.overlap_score, lam: float = rt.MMR_LAMBDA) -> DataFrame:
        """The best k nodes of every question ``(q, text)``.

        ``hybrid``: fused candidates above ``min_score``, rescored by
        ``scorer``: (q, rank, doc, score). ``mmr``: of the same candidates a
        greedy choice of relevant but different nodes, relevance being the
        cosine of question and node: (q, rank, doc); a question or node
        without a vector takes no part."""
        fused = rt.score_cutoff(self.candidates(queries), min_score)
        # queries x depth rows: they go to the stored texts and vectors, which stay where they are
        fused, _ = broadcast_if_small(fused.select("q", "doc"))
        if mode == "hybrid":
            return rt.rerank(fused, queries, self.nodes.select(F.col("node_id").alias("doc_id"), "text"), k=k, scorer=scorer)
        if mode != "mmr":
            raise ValueError(f"unknown mode {mode!r}")
        asked = hash_embed(queries.select("q", "text"), "q", "text", self.dim).withColumnRenamed("embedding", "_qv")
        found = self.vectors.select(F.col("node_id").alias("doc"), "embedding").join(fused, "doc")
        near = (found.join(asked, "q")
                .select("q", F.col("doc").alias("id"), F.round(rt.cosine(F.col("_qv"), F.col("embedding")), rt.SCORE_DIGITS).alias("score"))
                .filter("score is not null"))
        near, _ = broadcast_if_small(cut_lineage(near))
        return rt.mmr_topk(near, self.vectors, k, lam, id_col="node_id").withColumnRenamed("id", "doc")
