"""Sorted hash arrays in shared files, memory-mapped by workers.

A table maps 64-bit hashes to rows of small numbers. It is cut into buckets,
which the caller chooses, one file for each bucket with rows; inside, the
hashes are sorted and kept as their upper 48 bits: an index by the upper 16,
the lower 32 as an array. A row of numbers is one byte, its place among the
255 most frequent rows of the bucket; other rows are listed beside them. Files
are written under a temporary name and renamed, so a task that is run again
replaces its file by an equal one.

The folder must be one that all executors see (``spark.checkpoint.dir``).
Files in a store that cannot be mapped are copied to an unnamed temporary
file first, which goes away with the map.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np

from .words import GOLD, mix64

# Maps that one worker keeps open.
OPEN_MAPS = 4000

_CELL = 1 << 16


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays behind a head of their lengths, each from a multiple of 8."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as out:
        out.write(np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    store.move(tmp, path)


def map_file(uri: str, dtypes: list) -> list[np.ndarray] | None:
    """The arrays of a file; nothing if there is none (a bucket without rows)."""
    from pyarrow import fs

    store, path = _store(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as src:
            while block := src.read(1 << 22):
                copy.write(block)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r").view(np.ndarray)
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8:8 + 8 * n].view(np.int64)
    out, at = [], 8 + 8 * n
    for size, dtype in zip(sizes.tolist(), dtypes):
        out.append(raw[at:at + size].view(dtype))
        at += size + (-size % 8)
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every hash; rises with the hash. ``buckets`` < 2^31."""
    with np.errstate(over="ignore"):
        high = (h >> np.uint64(32)) * np.uint64(buckets)
        low = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
        return ((high + low) >> np.uint64(32)).astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers in the narrowest type: numpy sorts up to 16 bits by radix."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def _place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(48)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def value_arrays(values: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of numbers as one byte each: four arrays for ``value_columns``."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(values[0]), np.uint64)
        for v in values:
            key = mix64(key * GOLD + v.astype(np.uint64, copy=False) + np.uint64(1)) if len(values) > 1 else v
    _, first, code, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    by_count = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), np.uint32)
    rank[by_count] = np.arange(len(n))
    code = rank[code]
    rare = np.flatnonzero(code >= 255)
    kinds = np.stack([v[first[by_count]] for v in values]).astype(np.uint64)
    return [np.minimum(code, 255).astype(np.uint8), rare.astype(np.uint32), code[rare], kinds]


def value_columns(arrays: list[np.ndarray], at: np.ndarray, columns: int = 1) -> list[np.ndarray]:
    """The columns of the rows at the given places."""
    byte, rare_at, rare, kinds = arrays
    code = byte[at].astype(np.int64)
    if len(over := np.flatnonzero(code == 255)):
        code[over] = rare[np.searchsorted(rare_at, at[over])]
    return [k[code].astype(np.int64) for k in kinds.reshape(columns, -1)]


def write_bucket(uri: str, h: np.ndarray, values: list[np.ndarray]) -> None:
    """One bucket: hashes in rising order and columns of numbers for them."""
    cell, rest = _place(h)
    write_file(uri, [np.searchsorted(cell, np.arange(_CELL + 1)).astype(np.uint32), rest, *value_arrays(values)])


class HashTable:
    """Look-ups in a table of ``columns`` numbers under ``folder``."""

    def __init__(self, folder: str, name: str, columns: int):
        self.folder, self.name, self.columns = folder, name, columns
        self.open: dict[int, list[np.ndarray] | None] = {}

    def uri(self, bucket: int) -> str:
        return f"{self.folder}/{self.name}/{bucket:07d}"

    def _bucket(self, b: int) -> list[np.ndarray] | None:
        if b not in self.open:
            if len(self.open) >= OPEN_MAPS:
                self.open.clear()
            self.open[b] = map_file(self.uri(b), [np.uint32, np.uint32, np.uint8, np.uint32, np.uint32, np.uint64])
        return self.open[b]

    def get(self, h: np.ndarray, bucket: np.ndarray) -> list[np.ndarray]:
        """The columns of every hash, looked up in its bucket; 0 where it is not in the table."""
        out = [np.zeros(len(h), np.int64) for _ in range(self.columns)]
        if not len(h):
            return out
        order = np.argsort(narrow(bucket), kind="stable")
        which = bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if (found := self._bucket(int(which[lo]))) is None:
                continue
            index, rest, *values = found
            rows = order[lo:hi]
            cell, want = _place(h[rows])
            a, b = index[cell].astype(np.int64), index[cell + 1].astype(np.int64)
            end = b.copy()
            while (go := np.flatnonzero(a < b)).size:
                mid = (a[go] + b[go]) >> 1
                less = rest[mid] < want[go]
                a[go] = np.where(less, mid + 1, a[go])
                b[go] = np.where(less, b[go], mid)
            hit = np.flatnonzero(a < end)
            hit = hit[rest[a[hit]] == want[hit]]
            for o, v in zip(out, value_columns(values, a[hit], self.columns)):
                o[rows[hit]] = v
        return out
