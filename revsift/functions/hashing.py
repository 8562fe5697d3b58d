"""Deterministic hash expressions that DuckDB can reproduce exactly.

``hex_int(x, a, n)`` is the integer value of ``n`` hex digits of ``md5(x)``
starting at 1-based position ``a``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hex_int(col, start: int, n: int, digest: str = "md5") -> Column:
    h = F.md5(_c(col)) if digest == "md5" else F.sha2(_c(col), 256)
    return F.conv(F.substring(h, start, n), 16, 10).cast("bigint")


def seeded_key(seed, *parts) -> Column:
    """``seed ':' part1 ':' part2 ...`` as text (the sampling hash input)."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols.append(F.lit(":"))
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*cols)


def seeded_md5(seed, *parts) -> Column:
    return F.md5(seeded_key(seed, *parts))


def sha_mod(col, modulus: int = 10 ** 8) -> Column:
    """SHA-256 of the text, read as one big integer, modulo ``modulus``.

    Horner's rule over eight 32-bit chunks keeps every step inside BIGINT
    (``acc < modulus <= 2**31`` so ``acc * 2**32 + chunk < 2**63``) and stays
    in plain arithmetic, so it is code-generated (no higher-order function).
    """
    if modulus > 2 ** 31:
        raise ValueError("modulus must be <= 2**31")
    h = F.sha2(_c(col), 256)
    acc = F.lit(0).cast("bigint")
    for i in range(8):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * F.lit(2 ** 32) + chunk, F.lit(modulus))
    return acc


def token_bucket(tok: Column, dim: int) -> Column:
    """Feature-hashing bucket of a token: first 8 md5 hex digits mod dim."""
    return F.pmod(hex_int(tok, 1, 8), F.lit(dim)).cast("int")


def token_sign(tok: Column) -> Column:
    """+1 when the 9th md5 hex digit is even, else -1."""
    return F.when(F.pmod(hex_int(tok, 9, 1), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))


def signed_codes(toks: pa.Array, dim: int) -> np.ndarray:
    """``2 * token_bucket``, plus 1 where ``token_sign`` is -1, of a batch of
    tokens; md5 runs once per distinct token."""
    words = toks.dictionary_encode()
    digests = b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in words.dictionary.cast(pa.binary()).to_pylist())
    d = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
    bucket = np.ascontiguousarray(d[:, :4]).view(">u4").reshape(-1) % dim
    return (bucket * 2 + ((d[:, 4] >> 4) & 1)).astype(np.int32)[words.indices.to_numpy(zero_copy_only=False)]


def signed_counts(codes: np.ndarray, starts: np.ndarray, dim: int) -> np.ndarray:
    """Signed token counts of some texts: one row of ``dim`` numbers a text,
    whose codes stand from ``starts[i]`` to ``starts[i + 1]``."""
    n = len(starts) - 1
    own = codes[starts[0]:starts[-1]]
    place = np.repeat(np.arange(n, dtype=np.int64) * dim, np.diff(starts)) + (own >> 1)
    return np.bincount(place, weights=1 - 2 * (own & 1), minlength=n * dim).astype(np.int64).reshape(n, dim)
