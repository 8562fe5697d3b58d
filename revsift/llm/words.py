"""Words of whole texts as 64-bit hashes, for a batch of texts at once.

A word is a run of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. The hash of a
word is a polynomial in an odd base over random numbers drawn for its bytes,
modulo 2^64, mixed with its length. Prefix sums of the polynomial over the
batch's bytes give every word's hash by two look-ups and one product, so no
Python code runs for single words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes of texts worked on at a time (a longer single text is done alone).
CHUNK_BYTES = 1 << 20

GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the texts, offsets of the texts in them). No nulls."""
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of the texts in them)."""
    buf, off = text_bytes(texts)
    hashes, counts, at = [], [np.zeros(1, np.int64)], 0
    while at < len(texts):
        end = int(max(at + 1, np.searchsorted(off, off[at] + CHUNK_BYTES, side="right") - 1))
        h, n = _chunk(buf[off[at]:off[end]], off[at:end + 1] - off[at])
        hashes.append(h)
        counts.append(n)
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


def _chunk(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    space = _SPACE[buf]
    cut = np.ones(n + 1, bool)  # no word goes on across these
    cut[1:n] = space[:-1]
    cut[off] = True
    starts = np.flatnonzero(cut[:-1] & ~space)
    cut[:n] = space
    cut[off] = True
    ends = np.flatnonzero(cut[1:] & ~space) + 1
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power[:n], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h = mix64(h + (ends - starts).astype(np.uint64) * GOLD)
    return h, np.diff(np.searchsorted(starts, off))
