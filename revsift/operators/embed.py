"""Embeddings.

Default embedder: signed feature hashing (Weinberger et al. 2009). Per token,
bucket = first 8 md5 hex digits mod D, sign = +1 if the 9th digit is even.
Integer sums per bucket, divided by their L2 norm. A text without tokens (or
with an all-zero sum) gets a NULL vector and is left out of dense search.

The sparse path (``hash_embed_sparse``) explodes tokens and aggregates per
(id, bucket). A document's tokens all sit in one input partition, so the
partial aggregation is already exact and at most D rows per document cross
the shuffle.

Plug-in embedders are ``Callable[[Column], Column]`` or a pandas UDF that
returns ARRAY<FLOAT>; ``embed`` applies either.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import signed_codes, signed_counts, token_bucket, token_sign
from ..functions.text import tokens
from .distributed import spread

DEFAULT_DIM = 64
BATCH_TEXTS = 16384   # texts whose counts are held at once


def hashed_tokens(df: DataFrame, id_cols: list, text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """(ids..., bucket, sign) per token occurrence. The raw text is spread
    over enough tasks before tokenising (a no-op on well-split input)."""
    src = spread(df.select(*id_cols, F.col(text_col).alias("_text")), list(id_cols))
    exploded = (src.select(*id_cols, F.explode_outer(tokens("_text")).alias("_tok"))
                   .filter(F.col("_tok").isNotNull()))
    return exploded.select(*id_cols, token_bucket(F.col("_tok"), dim).alias("bucket"),
                           token_sign(F.col("_tok")).alias("sign"))


def hash_embed_counts(df: DataFrame, id_cols: list, text_col: str,
                      dim: int = DEFAULT_DIM) -> DataFrame:
    """(ids..., bucket, c) with c = integer signed count, zero buckets dropped."""
    h = hashed_tokens(df, id_cols, text_col, dim)
    return (h.groupBy(*id_cols, "bucket").agg(F.sum("sign").cast("bigint").alias("c"))
             .filter(F.col("c") != 0))


def hash_embed_sparse(df: DataFrame, id_cols: list, text_col: str,
                      dim: int = DEFAULT_DIM) -> DataFrame:
    """(ids..., bucket, weight): unit-vector entries, non-zero buckets only."""
    counts = hash_embed_counts(df, id_cols, text_col, dim)
    norms = counts.groupBy(*id_cols).agg(F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("_norm"))
    return (counts.join(norms, id_cols)
                  .select(*id_cols, "bucket", (F.col("c") / F.col("_norm")).alias("weight")))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM,
               vector_col: str = "embedding") -> DataFrame:
    """(id, embedding ARRAY<DOUBLE>[dim]) dense unit vectors; rows whose text
    has no tokens (or an all-zero sum) are absent."""
    counts = hash_embed_counts(df, [id_col], text_col, dim)
    return _dense_from_counts(counts, id_col, dim, vector_col)


def hash_vector(toks: Column, dim: int = DEFAULT_DIM) -> Column:
    """The vector that ``hash_embed`` gives a text whose id occurs once, from
    its tokens; null without tokens or with an all-zero sum. No shuffle."""
    def vectors(rows: pa.Array) -> pa.Array:
        starts = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        codes, parts = signed_codes(rows.flatten(), dim), []
        for a in range(0, len(rows), BATCH_TEXTS):
            counts = signed_counts(codes, starts[a:a + BATCH_TEXTS + 1], dim)
            squares = np.einsum("ij,ij->i", counts, counts)
            found = squares > 0
            unit = counts[found].astype(np.float64) / np.sqrt(squares[found].astype(np.float64))[:, None]
            ends = np.concatenate([[0], np.cumsum(found * dim)]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(ends, unit.reshape(-1), mask=pa.array(~found)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))
    return F.arrow_udf(vectors, "array<double>")(toks)


def hash_embed_from_postings(postings: DataFrame, dim: int = DEFAULT_DIM, vector_col: str = "embedding",
                             id_col: str = "doc") -> DataFrame:
    """Hashed unit vectors from a postings table (id, term, tf): md5 runs
    once per distinct token of a document, not per occurrence."""
    p = postings.filter(F.col("term").isNotNull())
    counts = (p.select(id_col, token_bucket(F.col("term"), dim).alias("bucket"),
                       (token_sign(F.col("term")) * F.col("tf")).alias("w"))
               .groupBy(id_col, "bucket").agg(F.sum("w").cast("bigint").alias("c"))
               .filter(F.col("c") != 0))
    return _dense_from_counts(counts, id_col, dim, vector_col)


def _dense_from_counts(counts: DataFrame, id_col: str, dim: int, vector_col: str) -> DataFrame:
    per_id = counts.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("_m"),
        F.sqrt(F.sum(F.col("c") * F.col("c")).cast("double")).alias("_norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda b: F.coalesce(F.element_at(F.col("_m"), b), F.lit(0)).cast("double")
                      / F.col("_norm"))
    return per_id.select(id_col, vec.alias(vector_col))


def embed(df: DataFrame, text_col: str, embedder: Callable[[Column], Column] | None = None,
          id_col: str | None = None, dim: int = DEFAULT_DIM,
          vector_col: str = "embedding") -> DataFrame:
    """Apply an embedder. Without one, the native hashing embedder is used
    (which needs ``id_col``). A plug-in is any ``Column -> Column`` function,
    e.g. a ``pandas_udf`` over ``Iterator[pd.Series]`` that loads its model
    once per Python worker; batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``."""
    if embedder is None:
        if id_col is None:
            raise ValueError("the hashing embedder needs id_col")
        return df.join(hash_embed(df, id_col, text_col, dim, vector_col), id_col, "left")
    return df.withColumn(vector_col, embedder(F.col(text_col)))


def normalize(vec: Column) -> Column:
    """Unit-length copy of an ARRAY<numeric>; NULL for a zero vector."""
    sq = F.aggregate(vec, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    n = F.sqrt(sq)
    return F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n))


def truncate_dims(vec: Column, dims: int) -> Column:
    """First ``dims`` components, re-normalised (a smaller model variant)."""
    return normalize(F.slice(vec, 1, dims))
