"""Operator 2: interpolated modified Kneser-Ney n-gram model.

Training texts are counted in Spark: every task counts the n-grams of its
texts in sorted arrays and sends, for each bucket, one packed and compressed
piece; a bucket's task merges its pieces, so a word pair that holds a third of
all text is one entry a task long before the shuffle. The counts of each order
and what is needed of every context (total, number of followers seen once,
twice, three times or more) become sorted hash arrays in the shared folder
(``hash_arrays``). Scoring workers memory-map them and look up only the
distinct n-grams of a batch.

An n-gram goes to the bucket of its inner words, so that its context and its
end are complete there and need no shuffle of their own; from a trigram even
the word pair's count is. No bucket may fill up so: if all inner words are
frequent (``frequent``), the context decides and the ends are sent on; if the
first word is frequent as well, the n-gram itself decides and the context is
sent on too. Words are numbered by frequency, as small numbers pack well; the
lowest bit of a word's number says whether it is frequent.

Counts of the highest order are plain; a lower order counts in how many
different n-grams of the next order an n-gram is the end (those that open a
text, where nothing can precede, keep their plain counts). Each order gives
three discounts from its counts of counts. Unknown words share what the
single words' discounts free, as one further word.

The production order is 3; any order from 2 works.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import id_text, map_batches, run_folder
from .hash_arrays import HashTable, bucket_of, map_file, narrow, value_arrays, value_columns, write_bucket, write_file
from .words import GOLD, mix64, text_bytes, word_hashes

ORDER = 3
# Bytes of training text for one bucket.
BUCKET_BYTES = 16 << 20
# A word is frequent above this part of the tokens that a bucket has on average.
FREQUENT_PART = 16
# Grams that a counting task holds before it sends them on.
HELD_GRAMS = 1_000_000
# Bytes of text worked on at a time (a longer single text is done alone).
SLICE_BYTES = 3 << 20
# The end of a text, which is a token, and its start, which is context only.
END = np.uint64(0x5851F42D4C957F2D)
# Discounts where an order has no n-grams of some of the counts 1 to 4.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)

_PIECE = "bucket int, kind int, piece binary"
_VOCAB, _STATS = 0, 1  # kinds; 2k: grams of order k, 2k + 1: contexts of order k


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (a text's words, then the end) and the texts' offsets."""
    h, off = word_hashes(texts)
    return np.insert(h, off[1:], END), off + np.arange(len(off))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, by at most SLICE_BYTES of text or one row."""
    off, lo = text_bytes(batch.column("text"))[1], 0
    while lo < batch.num_rows:
        hi = int(max(lo + 1, np.searchsorted(off, off[lo] + SLICE_BYTES, side="right") - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def sums_by(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, rising, and the sums of the columns for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns)


def gram_hash(ids: np.ndarray) -> np.ndarray:
    """64-bit hash of rows of word ids."""
    with np.errstate(over="ignore"):
        x = ids[:, 0].astype(np.uint64) + np.uint64(ids.shape[1])
        for k in range(1, ids.shape[1]):
            x = mix64(x * GOLD + ids[:, k].astype(np.uint64) + np.uint64(1))
        return mix64(x + GOLD)


def gram_sums(ids: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, ids, sums of the columns) of the distinct rows of ids, by hash."""
    h = gram_hash(ids)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], ids[order[first]], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Number columns of one length; small ones as single bytes."""
    out = [np.array([len(arrays[0]), len(arrays)], np.uint32).tobytes()]
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w)
        out += [bytes([width]), np.ascontiguousarray(a.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(piece: bytes) -> list[np.ndarray]:
    """The columns, as narrow as they were packed."""
    raw = pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True)
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    out, at = [], 8
    for _ in range(m):
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n))
        at += 1 + n * width
    return out


def is_hot(ids: np.ndarray) -> np.ndarray:
    """Whether all words of a row are frequent (true of no words)."""
    return (ids & ids.dtype.type(1)).all(axis=1)


def _keyed(n: int, *choices: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of n rows the hash of the words that its choice (rows, words) names."""
    key = np.zeros(n, np.uint64)
    for rows, words in choices:
        if rows.any():
            key[rows] = gram_hash(words[rows])
    return key


def gram_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of n-grams: by the inner words, the context or all words (see above)."""
    inner, first = is_hot(ids[:, 1:-1]), is_hot(ids[:, :1])
    if ids.shape[1] == 1:
        first[:] = True
    return bucket_of(_keyed(len(ids), (~inner, ids[:, 1:-1]), (inner & ~first, ids[:, :-1]), (inner & first, ids)), buckets)


def context_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of contexts: that of their n-grams, unless all words are frequent."""
    inner = is_hot(ids[:, 1:])
    return bucket_of(_keyed(len(ids), (~inner, ids[:, 1:]), (inner, ids)), buckets)


def _pieces(kind: int, b: np.ndarray, arrays: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """One piece for each bucket, in the order of the keys: neighbours are alike, which packs well."""
    order = np.lexsort([*keys[::-1], narrow(b)])
    b = b[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(b[lo]), kind, _pack([a[order[lo:hi]] for a in arrays])


def _gram_pieces(ids: np.ndarray, c: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    cols = list(ids.T)
    return _pieces(2 * len(cols), gram_bucket(ids, buckets), [*cols, c], [*cols[1:-1], cols[0], cols[-1]])


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                      names=["bucket", "kind", "piece"])


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[list[np.ndarray]]]]]:
    """(bucket, kind -> pieces) of a stream sorted by bucket."""
    bucket, held = None, {}
    for batch in batches:
        for b, k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, {}
            held.setdefault(k, []).append(_unpack(p.as_py()))
    if held:
        yield bucket, held


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*pieces)]


@dataclass
class Model:
    """What scoring needs besides the files: a few numbers, whatever the corpus."""

    folder: str
    order: int
    buckets: int
    vocabulary: int
    most: int  # words of the largest bucket
    train_tokens: int
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    unigram: tuple[int, int, int, int] = (0, 0, 0, 0)  # continuation total and words of count 1, 2, 3 or more

    @property
    def frequent(self) -> int:
        """Tokens that a word or context of one bucket may have at most."""
        return max(1, self.train_tokens // (FREQUENT_PART * self.buckets))

    @property
    def unknown(self) -> int:
        """Number of all unknown words; known ones are below."""
        return 2 * self.most * self.buckets

    @property
    def start(self) -> int:
        """Number of the start of a text, which is frequent."""
        return self.unknown + 3

    @property
    def number_type(self):
        return np.uint32 if self.start < 1 << 32 else np.uint64


class Vocabulary:
    """Word hash -> (number, count)."""

    def __init__(self, model: Model):
        self.model = model
        self.table: dict[int, list[np.ndarray] | None] = {}

    def _bucket(self, b: int) -> list[np.ndarray] | None:
        if b not in self.table:
            self.table[b] = map_file(f"{self.model.folder}/words/{b:07d}", [np.uint64, np.uint32, np.uint8, np.uint32, np.uint32, np.uint64])
        return self.table[b]

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of rising hashes; ``unknown`` and 0 for unknown ones."""
        m = self.model
        ids = np.full(len(h), m.unknown, m.number_type)
        counts = np.zeros(len(h), np.int64)
        which = bucket_of(h, m.buckets)
        cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            b = int(which[lo])
            if (found := self._bucket(b)) is None:
                continue
            words, rank, *cols = found
            at = np.minimum(np.searchsorted(words, h[lo:hi]), len(words) - 1)
            hit = np.flatnonzero(words[at] == h[lo:hi])
            at = at[hit]
            c = value_columns(cols, at)[0]
            counts[lo + hit] = c
            ids[lo + hit] = 2 * (rank[at].astype(np.int64) * m.buckets + b) + (c > m.frequent)
        return ids, counts


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rising distinct values, place of every value among them, a place that holds each)."""
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse, order[new]


def _distinct_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rising hashes, rows) of the distinct rows and the place of every row among them."""
    h, inverse, at = _distinct(gram_hash(ids))
    return h, ids[at], inverse


def _grams(ids: np.ndarray, off: np.ndarray, k: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-gram that ends at each token, with one start before a text, and
    whether it exists (enough tokens of its text before)."""
    n = len(ids)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    out = np.empty((n, k), ids.dtype)
    for j in range(k):
        back = k - 1 - j
        out[:, j] = ids[np.maximum(np.arange(n) - back, 0)]
        out[place == back - 1, j] = start
    return out, place >= k - 2


def train(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> Model:
    """Count a model over all rows of ``docs`` (``doc_id``, ``text``); its
    files go under ``folder`` (default: a new one in ``spark.checkpoint.dir``)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "ngrams")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))

    def word_pieces(words):
        return list(_pieces(_VOCAB, bucket_of(words[0], buckets), list(words), [words[0]]))

    def count_words(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            return sums_by(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))

        for batch in (part for b in batches for part in slices(b)):
            h, _ = token_hashes(batch.column("text"))
            held.append(sums_by(h, np.ones(len(h), np.uint64)))
            if len(held) > 1 and sum(len(x[0]) for x in held) > HELD_GRAMS:
                held = [merged()]
                if len(held[0][0]) > HELD_GRAMS // 2:
                    yield _batch(word_pieces(held[0]))
                    held = []
        if held:
            words = merged()
            yield _batch(word_pieces(words))

    def write_words(batches):
        for bucket, kinds in _by_kind(batches):
            h, c = sums_by(*(x.astype(np.uint64, copy=False) for x in _joined(kinds.pop(_VOCAB))))
            rank = np.empty(len(h), np.uint32)
            rank[np.lexsort((h, c))[::-1]] = np.arange(len(h))  # the most frequent word is the first
            write_file(f"{folder}/words/{bucket:07d}", [h, rank, *value_arrays([c])])
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(h)]), pa.array([int(c.sum())])], names=["bucket", "n", "c"])

    def dealt(df):
        return df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")

    words = map_batches(dealt(map_batches(docs, count_words, _PIECE)), write_words, "bucket int, n long, c long")
    words = words.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("c").alias("c")).first()
    model = Model(folder, order, buckets, words["n"] or 0, words["most"] or 0, words["c"] or 0)
    start = model.start

    def count_grams(batches):
        vocabulary = Vocabulary(model)
        held: dict[int, list] = {}

        def merged(k):
            return gram_sums(np.concatenate([x[0] for x in held[k]]), np.concatenate([x[1] for x in held[k]]))

        def send(k):
            _, ids, c = merged(k)
            held[k] = []
            return _batch(list(_gram_pieces(ids, c, buckets)))

        for batch in (part for b in batches for part in slices(b)):
            h, off = token_hashes(batch.column("text"))
            distinct, inverse, _ = _distinct(h)
            ids = vocabulary.get(distinct)[0][inverse]
            for k in range(2, order + 1):
                grams, there = _grams(ids, off, k, start)
                # shorter grams are counted here only where they open a text
                keep = there if k == order else there & (grams[:, 0] == start)
                _, g, c = gram_sums(grams[keep], np.ones(int(keep.sum()), np.uint64))
                held.setdefault(k, []).append((g, c))
                if sum(len(x[0]) for x in held[k]) > HELD_GRAMS:
                    _, g, c = merged(k)
                    held[k] = [(g, c)]
                    if len(g) > HELD_GRAMS // 2:
                        yield send(k)
        for k in held:
            if held[k]:
                yield send(k)

    def merged_grams(pieces, words):
        """gram_sums of pieces; the unpacked columns go on the way."""
        cols = _joined(pieces)
        pieces.clear()
        ids = np.stack(cols[:words], axis=1).astype(model.number_type, copy=False)
        del cols[:words]
        return gram_sums(ids, *(c.astype(np.uint64, copy=False) for c in cols))

    def settle(bucket, k, grams):
        """Write the n-grams of order k that are complete in a bucket and the
        contexts that are; the rows to send on: contexts of frequent words,
        ends (which count for order k - 1) and sums."""
        h, ids, c = grams
        hot = is_hot(ids[:, :-1]) if k > 1 else np.zeros(len(ids), bool)
        for name, rows in ((f"grams{k}", ~hot), (f"hot_grams{k}", hot)):
            if rows.any():
                write_bucket(f"{folder}/{name}/{bucket:07d}", h[rows], [c[rows]])
        three = [(c == 1).astype(np.uint32), (c == 2).astype(np.uint32), (c >= 3).astype(np.uint32)]
        sums = [k, *(int((c == j).sum()) for j in (1, 2, 3, 4)), int(c.sum()), *(int(x.sum()) for x in three)]
        later = [(bucket, _STATS, _pack([np.array(sums, np.uint64)]))]
        if k == 1:
            return later
        ch, ctx, *sums = gram_sums(ids[:, :-1], c, *three)
        hot = is_hot(ctx)
        if not hot.all():
            write_bucket(f"{folder}/contexts{k}/{bucket:07d}", ch[~hot], [x[~hot] for x in sums])
        later += _pieces(2 * k + 1, bucket_of(ch[hot], buckets), [*ctx[hot].T, *(x[hot] for x in sums)], list(ctx[hot].T))
        del h, c, three, ch, ctx, sums
        eh, ends, n = gram_sums(ids[:, 1:], np.ones(len(ids), np.uint64))
        del ids
        grams.clear()
        # pairs after a word that is not frequent met all their trigrams here
        whole = ~is_hot(ends[:, :1]) if k == 3 else np.zeros(len(ends), bool)
        later += _gram_pieces(ends[~whole], n[~whole], buckets)
        if whole.any():
            later += settle(bucket, 2, [eh[whole], ends[whole], n[whole]])
        return later

    def reduce_level(k):
        """Settle the n-grams of order k and the contexts of order k + 1 that were sent on."""
        def run(batches):
            for bucket, kinds in _by_kind(batches):
                later = []
                if 2 * k in kinds:
                    later += settle(bucket, k, list(merged_grams(kinds.pop(2 * k), k)))
                if 2 * k + 3 in kinds:
                    h, _, *sums = merged_grams(kinds.pop(2 * k + 3), k)
                    write_bucket(f"{folder}/hot_contexts{k + 1}/{bucket:07d}", h, sums)
                for kind, pieces in kinds.items():  # of later levels
                    later += [(bucket, kind, _pack(p)) for p in pieces]
                yield _batch(later)
        return run

    names = ["k", "n1", "n2", "n3", "n4", "total", "one", "two", "more"]

    def unpacked(batches):
        for batch in batches:
            rows = [_unpack(p.as_py())[0].tolist() for p in batch.column("piece")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    level = map_batches(docs, count_grams, _PIECE)
    for k in range(order, 0, -1):
        level = map_batches(dealt(level), reduce_level(k), _PIECE)
    sums = map_batches(level.filter(F.col("kind") == _STATS), unpacked, ", ".join(f"{c} long" for c in names))
    for r in sums.groupBy("k").agg(*(F.sum(c).alias(c) for c in names[1:])).collect():  # one row for each order
        model.discounts[r["k"]] = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        if r["k"] == 1:
            model.unigram = (r["total"], r["one"], r["two"], r["more"])
    return model


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    if not (n1 and n2 and n3 and n4):
        return PLAIN_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x < j for j, x in enumerate(d, 1)) else PLAIN_DISCOUNTS


class Scorer:
    """Probabilities from the memory-mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model, self.words = model, Vocabulary(model)
        self.tables: dict[str, HashTable] = {}

    def _get(self, name: str, columns: int, h: np.ndarray, bucket: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
        """Numbers of distinct hashes from a table or its part of frequent words."""
        out = [np.zeros(len(h), np.int64) for _ in range(columns)]
        for part, rows in ((name, np.flatnonzero(~hot)), (f"hot_{name}", np.flatnonzero(hot))):
            if len(rows):
                if part not in self.tables:
                    self.tables[part] = HashTable(self.model.folder, part, columns)
                for o, x in zip(out, self.tables[part].get(h[rows], bucket[rows])):
                    o[rows] = x
        return out

    def _rest(self, k: int, a: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.model.discounts.get(k, PLAIN_DISCOUNTS)])
        return np.maximum(a - d[np.minimum(a, 3)], 0.0)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """P(last | others) of rows of ids, of any width up to the order."""
        k = grams.shape[1]
        h, g, inverse = _distinct_rows(grams)
        hot = is_hot(g[:, :-1]) if k > 1 else np.zeros(len(g), bool)
        a = self._get(f"grams{k}", 1, h, gram_bucket(g, self.model.buckets), hot)[0]
        d1, d2, d3 = self.model.discounts.get(k, PLAIN_DISCOUNTS)
        if k == 1:
            total, n1, n2, n3 = self.model.unigram
            lower = 1.0 / (self.model.vocabulary + 1)
            p = (self._rest(1, a) + (d1 * n1 + d2 * n2 + d3 * n3) * lower) / total if total else np.full(len(g), lower)
            return p[inverse]
        h, ctx, at = _distinct_rows(g[:, :-1])
        c, n1, n2, n3 = (x[at] for x in self._get(f"contexts{k}", 4, h, context_bucket(ctx, self.model.buckets), is_hot(ctx)))
        lower = self.probability(g[:, 1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = (self._rest(k, a) + (d1 * n1 + d2 * n2 + d3 * n3) * lower) / c
        return np.where(c > 0, p, lower)[inverse]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, log10 probability) of texts."""
        h, off = token_hashes(texts)
        distinct, inverse, _ = _distinct(h)
        ids, counts = self.words.get(distinct)
        n, v = self.model.train_tokens, self.model.vocabulary  # without training rows: one unknown word
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[inverse]
        known, ids = (counts > 0)[inverse], ids[inverse]
        logp = np.zeros(len(ids))
        left = np.ones(len(ids), bool)
        for k in range(self.model.order, 1, -1):  # the longest gram that a text's start allows
            grams, there = _grams(ids, off, k, self.model.start)
            now = np.flatnonzero(left & there)
            logp[now] = np.log10(self.probability(grams[now]))
            left[now] = False
        sums = [np.add.reduceat(x, off[:-1]) if len(x) else x for x in (known.astype(np.int64), base, logp)]
        return np.diff(off), *sums


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 10 is 0; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all whole texts:
    ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-0.1 unigrams), ``score`` (log10 probability of the
    model) and ``perplexity`` (10 ^ (-score / n_tokens)).

    A null or empty text has one token, its end. Repeated rows count and are
    scored as often as they occur. Without training rows every token has the
    probability of an unknown word. Other columns are not read.
    """
    src = id_text(docs, id_col, text_col)
    held = is_held_out(F.col("doc_id"))
    model = train(src.filter(~held), order)
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("n_tokens", LongType()), StructField("n_known", LongType()),
              StructField("base_score", DoubleType()), StructField("score", DoubleType())]

    def run(batches):
        scorer = Scorer(model)
        for b in (part for batch in batches for part in slices(batch)):
            n, known, base, logp = scorer.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(known), pa.array(base), pa.array(logp)],
                                             names=[f.name for f in fields])

    out = map_batches(src, run, StructType(fields))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
                      "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
