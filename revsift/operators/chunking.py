"""Corpus building: sentence windows (W1), semantic chunks (R2, W2, W3, A11),
fixed token chunks (R3) and the index build (R5).

All of them are per-row array expressions: a document is one row, so they
need no shuffle at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import signed_codes, signed_counts
from ..functions.text import sentences, tokens
from ..sources.io import VectorTable, build_or_load
from .distributed import broadcast_if_small, cut_lineage, spread
from .embed import BATCH_TEXTS, DEFAULT_DIM, hash_embed, hash_vector

FIXED_SIZE = 512
FIXED_OVERLAP = 10
BREAKPOINT_PERCENTILE = 0.95
BUFFER = 1


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, i, s): sentences numbered from 0; n = sentences in the doc."""
    d = docs.select(F.col(id_col).alias("doc"), sentences(text_col).alias("_s"))
    # posexplode_outer: no inferred non-empty filter is pushed below a repartition
    ex = d.select("doc", F.size("_s").alias("n"), F.posexplode_outer("_s").alias("i", "s"))
    return ex.filter(F.col("i").isNotNull())


def sentence_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     buffer: int = BUFFER) -> DataFrame:
    """(doc, i, window_text) = sentences i-buffer..i+buffer joined by a
    space. Computed on the sentence array of each row (no shuffle)."""
    d = docs.select(F.col(id_col).alias("doc"), sentences(text_col).alias("_s"))
    n = F.size("_s")
    wins = F.transform(
        F.col("_s"),
        lambda s, i: F.array_join(
            F.slice(F.col("_s"), F.greatest(i - buffer, F.lit(0)) + 1,
                    F.least(i + buffer, n - 1) - F.greatest(i - buffer, F.lit(0)) + 1), " "))
    return d.select("doc", F.posexplode(wins).alias("i", "window_text"))


def _group_dots(dim: int):
    """For every sentence i of a document (its tokens): the squared length of
    the signed counts of group i (sentences i-1..i+1) and their dot product
    with those of group i+1 (0 for the last)."""
    def run(docs: pa.Array) -> pa.Array:
        sizes = docs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        sents = docs.flatten()
        doc = np.repeat(np.arange(len(docs)), sizes)
        joined = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(doc) else np.zeros(0, dtype=bool)  # with the sentence after it
        starts = np.concatenate([[0], np.cumsum(sents.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        codes = signed_codes(sents.flatten(), dim)
        square, ahead = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
        for a in range(0, len(doc), BATCH_TEXTS):  # with the sentences that the first and last groups reach
            b = min(a + BATCH_TEXTS, len(doc))
            low, high = max(a - 1, 0), min(b + 2, len(doc))
            counts = signed_counts(codes, starts[low:high + 1], dim)
            next_one = joined[low:high - 1, None]
            groups = counts.copy()
            groups[:-1] += counts[1:] * next_one
            groups[1:] += counts[:-1] * next_one
            square[a:b] = np.einsum("ij,ij->i", groups, groups)[a - low:b - low]
            dots = np.zeros(high - low, dtype=np.int64)
            dots[:-1] = np.einsum("ij,ij->i", groups[:-1], groups[1:]) * next_one[:, 0]
            ahead[a:b] = dots[a - low:b - low]
        pairs = pa.StructArray.from_arrays([pa.array(square), pa.array(ahead)], names=["square", "ahead"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pairs)
    return run


def semantic_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    dim: int = DEFAULT_DIM, pct: float = BREAKPOINT_PERCENTILE,
                    partitions: int | None = None, keep: list = ()) -> DataFrame:
    """R2: (doc, chunk_no, n_sentences, text), then the ``keep`` columns of the document.

    Group i = sentences i-1..i+1; its vector = signed hashed token counts
    (the hashing embedder before normalisation, so cosine is exact);
    d_i = round(1 - cos(group_i, group_i+1), 9), cos = 0 for an empty vector;
    threshold = exact linear 95th percentile of d over the document; cut
    after i when d_i > threshold; a chunk is its sentences joined by a space.

    One row expression, no shuffle on split input: the words are Spark's, an
    Arrow function counts them for a batch of sentences (``_group_dots``:
    whole numbers), and distances, threshold and cuts are Spark's again. The
    work of a document grows with its length. A row's chunks do not depend on
    other rows; null or empty text has none.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    base = base.repartition(partitions, "doc") if partitions else spread(base, ["doc"])
    kept = ["doc", *[f"_keep_{c}" for c in keep]]
    d = base.select(*kept, sentences("_text").alias("_s")).select(*kept, "_s", F.transform("_s", tokens).alias("_words"))
    dots = F.arrow_udf(_group_dots(dim), "array<struct<square: bigint, ahead: bigint>>")
    d = d.select(*kept, "_s", dots("_words").alias("_g"))

    def distance(i):
        here, ahead = F.get(F.col("_g"), i), F.get(F.col("_g"), i + 1)["square"].cast("double")
        square = here["square"].cast("double")
        cos = F.when((square > 0) & (ahead > 0), here["ahead"].cast("double") / (F.sqrt(square) * F.sqrt(ahead)))
        return F.round(F.lit(1.0) - F.coalesce(cos, F.lit(0.0)), 9)

    n = F.size("_s")
    d = d.select(*kept, "_s", F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), distance))
                               .otherwise(F.array().cast("array<double>")).alias("_d"))
    # the percentile at place pct * (size - 1) of the sorted distances, between its two neighbours
    d = d.select(*kept, "_s", "_d", F.array_sort("_d").alias("_sorted"), (F.lit(pct) * (F.size("_d") - 1)).alias("_at"))
    low, high = F.get("_sorted", F.floor("_at").cast("int")), F.get("_sorted", F.ceil("_at").cast("int"))
    d = d.select(*kept, "_s", "_d", F.when(low == high, low).otherwise(
        (F.ceil("_at") - F.col("_at")) * low + (F.col("_at") - F.floor("_at")) * high).alias("_thr"))
    d = d.select(*kept, "_s", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        F.get(F.col("_d"), i - 1) > F.col("_thr")))).alias("_starts"))
    sizes = F.transform("_starts", lambda a, j: F.struct(a.alias("a"), (F.coalesce(F.get(F.col("_starts"), j + 1), n) - a).alias("k")))
    # posexplode_outer: a non-empty filter inferred from the explode would repeat all of this below it
    return (d.select(*kept, "_s", F.posexplode_outer(sizes).alias("chunk_no", "_c")).filter(F.col("chunk_no").isNotNull())
            .select("doc", "chunk_no", F.col("_c.k").cast("bigint").alias("n_sentences"),
                    F.array_join(F.slice(F.col("_s"), F.col("_c.a") + 1, F.col("_c.k")), " ").alias("text"),
                    *[F.col(f"_keep_{c}").alias(c) for c in keep]))


def fixed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP) -> DataFrame:
    """(doc, chunk_no, n_tokens, text) token windows [j*(size-overlap),
    +size). A window starting at or past the end, or holding only the
    previous window's overlap, is not emitted. Per-row arrays, no shuffle."""
    step = size - overlap
    d = docs.select(F.col(id_col).alias("doc"), tokens(text_col).alias("_t"))
    n = F.size("_t")
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)),
                                    lambda s: (s == 0) | (s + overlap < n))).otherwise(F.array().cast("array<int>"))
    ex = d.select("doc", "_t", F.posexplode(starts).alias("chunk_no", "_start"))
    piece = F.slice(F.col("_t"), F.col("_start") + 1, F.lit(size))
    return ex.select("doc", F.col("chunk_no").cast("int").alias("chunk_no"),
                     F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("text"))


def build_index(spark, docs: DataFrame, path: str, recreate: bool = False, id_col: str = "doc_id",
                text_col: str = "text", meta_cols: list = (), dim: int = DEFAULT_DIM) -> DataFrame:
    """Chunk -> embed -> persist nodes and the vector table. The node
    table is written first and read back (that cuts the lineage), then the
    vector table is written from the stored nodes.

    The chunks of a document whose id occurs once are made, embedded and
    written where its row is. Rows that share an id (or have none) share their
    node ids: those chunks meet the metadata of all rows and the vector of all
    texts of their id by joins."""
    def nodes_of(chunks):
        return chunks.select("node_id", F.col("doc").cast("long").alias("doc_id"), "chunk_no", "text",
                             "metadata", F.col("embedding").cast("array<float>").alias("embedding"))

    def named(chunks):
        return chunks.withColumn("node_id", F.concat_ws(":", F.col("doc").cast("string"), F.col("chunk_no").cast("string")))

    def build():
        meta = F.map_from_arrays(F.array(*[F.lit(c) for c in meta_cols]),
                                 F.array(*[F.col(c).cast("string") for c in meta_cols]))
        rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"), meta.alias("metadata"))
        shared = rows.groupBy("doc").count().filter((F.col("count") > 1) | F.col("doc").isNull()).select(F.col("doc").alias("_id"))
        shared = cut_lineage(shared)
        if shared.isEmpty():
            alone, several = rows, None
        else:
            side, _ = broadcast_if_small(shared)
            match = F.col("doc").eqNullSafe(F.col("_id"))
            alone, several = rows.join(side, match, "left_anti"), rows.join(side, match, "left_semi")
        chunks = named(semantic_chunks(alone, "doc", "_text", dim, keep=["metadata"]))
        nodes = nodes_of(chunks.withColumn("embedding", hash_vector(tokens("text"), dim)))
        if several is None:
            return nodes
        chunks = named(cut_lineage(semantic_chunks(several, "doc", "_text", dim)))
        vec = hash_embed(chunks, "node_id", "text", dim)
        return nodes.unionByName(nodes_of(chunks.join(several.select("doc", "metadata"), "doc", "left").join(vec, "node_id", "left")))
    nodes = build_or_load(spark, path.rstrip("/") + "/nodes", build, recreate)
    vt = VectorTable(path.rstrip("/") + "/vectors", dim)
    if recreate or not vt.exists(spark):
        vt.write(nodes.select("node_id", "doc_id", "embedding"), recreate=True)
    return nodes
