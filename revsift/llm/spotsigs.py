"""Operator 10: document fingerprints by SpotSigs.

A spot is an occurrence of a common word (an anchor); its signature is the
anchor with the chain of content words that follow it. Prose has anchors
everywhere, page furniture hardly any, so the set of a text's signatures is
its fingerprint: 32-bit hashes, sorted, eight hex digits each.

``fingerprint_neighbours`` fingerprints every text, an edited copy of it (its
end replaced by the start of the next document) and compares them.
``similar_pairs`` is the similarity join: sets are partitioned by length (a
set's partner has at least the threshold's share of its length, so it is in
the same range or the next), an index over each set's rarest signatures gives
candidates, and Jaccard stops as soon as it can no longer reach the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import id_text, map_batches, written
from .licenses import words_of

# Common words of four languages; every one is an anchor and no content word.
COMMON = {
    "en": "a an and are as at be but by can do for from had has have he in is it not of on or said she that the there they this to was we were which will with you",
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa se son sur un une vous",
    "de": "als am auch auf aus bei das dem den der des die ein eine einen er es ist für im in ist mit nicht noch sich sie sind so und von war wie zu",
    "es": "al como con de del el ella en es esta este fue la las lo los más no o para pero por que se ser si su sus un una y",
}
ANCHORS = frozenset(w.encode() for words in COMMON.values() for w in words.split())
CHAIN = 2  # content words in a chain
GAP = 1  # a chain takes every GAP-th content word
# Documents that one range of ids holds on average; ranges are capped in number, not in size, and read as streams.
RANGE_ROWS = 1500
MOST_RANGES = 10_000
# Entries of a worker's table of word hashes.
WORD_ENTRIES = 400_000

_GOLD, _MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= WORD_ENTRIES:
            self.clear()
        self[word] = h
        return h


_HASHES = _WordHashes()


def spots(text: str, chain: int = CHAIN, gap: int = GAP) -> np.ndarray:
    """Sorted distinct signature hashes of a whole text. Words are those of
    the licence scan (letters, digits, everything beyond ASCII; A-Z
    lower-cased). A text without a spot takes every word as an anchor; one
    with too few words for that has its whole word sequence as its only
    signature; a text without words has none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint32)
    h = np.array([_HASHES[w] for w in words], np.uint64)
    common = np.array([w in ANCHORS for w in words])
    sig = _chains(h, np.flatnonzero(common), np.flatnonzero(~common), chain, gap)
    if not len(sig):
        every = np.arange(len(h))
        sig = _chains(h, every, every, chain, gap)
    if not len(sig):
        sig = _chains(h, np.zeros(1, np.int64), np.arange(len(h)), len(h) - 1, 1) if len(h) > 1 else _fold(h[:, None])
    sig = np.sort(sig)
    return sig[np.concatenate([[True], sig[1:] != sig[:-1]])]


def _fold(columns: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.zeros(len(columns), np.uint64)
        for k in range(columns.shape[1]):
            x = (x ^ columns[:, k]) * _MULT
            x ^= x >> np.uint64(29)
        x = (x + _GOLD) * _MULT
    return (x >> np.uint64(32)).astype(np.uint32)


def _chains(h: np.ndarray, anchors: np.ndarray, content: np.ndarray, chain: int, gap: int) -> np.ndarray:
    """Hash of (anchor, the next ``chain`` content words, every ``gap``-th) of
    every anchor that has enough content words after it."""
    start = np.searchsorted(content, anchors, side="right")
    last = start + (chain - 1) * gap
    ok = last < len(content)
    anchors, start = anchors[ok], start[ok]
    return _fold(np.stack([h[anchors]] + [h[content[start + k * gap]] for k in range(chain)], axis=1))


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard of two sorted sets (two empty sets: 1). With ``at_least`` the
    pair is given up, and 0 returned, once its lengths or the signatures left
    cannot reach it."""
    if not len(a) and not len(b):
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) < at_least * len(b):
        return 0.0
    if at_least <= 0:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common / (len(a) + len(b) - common)
    need = math.ceil(at_least / (1 + at_least) * (len(a) + len(b)) - 1e-9)
    common = 0
    for i in range(0, len(a), 64):  # stop early on the shorter side
        part = a[i:i + 64]
        at = np.minimum(np.searchsorted(b, part), len(b) - 1)
        common += int((b[at] == part).sum())
        if common + len(a) - i - len(part) < need:
            return 0.0
    score = common / (len(a) + len(b) - common)
    return score if score >= at_least else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 chain: int = CHAIN, gap: int = GAP) -> DataFrame:
    """``doc_id``, ``n_spots``, ``fingerprint`` of every whole text. A null
    text counts as empty and has an empty fingerprint. One pass, no shuffle."""
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("n_spots", LongType()), StructField("fingerprint", StringType())]

    def run(batches):
        for b in batches:
            sigs = [spots(t.as_py(), chain, gap) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sigs], pa.int64()),
                                              pa.array([to_text(s) for s in sigs], pa.string())], names=[f.name for f in fields])

    return map_batches(id_text(docs, id_col, text_col), run, StructType(fields))


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 4) code points of a text replaced by the first as
    many (or all) of the following one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


NEIGHBOUR_FIELDS = [
    StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]


def _id_ranges(ids: DataFrame) -> tuple[list[int], int]:
    """(first ids of all ranges but the first, smallest id): bounds are ids of
    the table, so every range has rows. One pass over the ids."""
    s = ids.agg(F.count("k").alias("n"), F.min("k").alias("lo")).first()
    if not s["n"]:
        return [], 0
    parts = max(1, min(MOST_RANGES, math.ceil(s["n"] / RANGE_ROWS)))
    if parts == 1:
        return [], s["lo"]
    at = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("k", at, 100 * parts).alias("b")).first()["b"]
    return sorted({b for b in found if b > s["lo"]}), s["lo"]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           chain: int = CHAIN, gap: int = GAP) -> DataFrame:
    """For every document: ``doc_id``, ``n_chars`` (code points),
    ``edited_sha256`` (of the edited text: its last quarter replaced by the
    start of the next document by ascending id; after the last comes the
    first), ``fingerprint`` and ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` (Jaccard of its fingerprint with the edited text's and the
    next document's, two empty ones: 1).

    A null text counts as empty. Null ids come last; rows of one id are
    ordered by a hash of their texts (equal rows are interchangeable). A
    single document follows itself; an empty table gives no rows.

    The texts move once, compressed, into ranges of ids; a range also gets
    the first document of the next one, so every document meets its follower
    in a sorted stream and no range is held in memory.
    """
    src = id_text(docs, id_col, text_col, "long")
    last_id = (1 << 63) - 1
    bounds, lowest = _id_ranges(src.select(F.coalesce("doc_id", F.lit(last_id)).alias("k")))
    n_parts = len(bounds) + 1
    firsts = [lowest, *bounds]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.array(bounds, np.int64)
        first_of = {b: (i - 1) % n_parts for i, b in enumerate(firsts)}  # first id of a range -> the range before it
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            ids = batch.column("doc_id")
            keys = ids.fill_null(last_id).to_numpy(zero_copy_only=False)
            part = np.searchsorted(low, keys, side="right")
            guests = [i for i, k in enumerate(keys.tolist()) if k in first_of]
            raw = [t.as_buffer() for t in batch.column("text").cast(pa.binary())]
            packed = pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())
            tie = pa.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in raw], pa.int64())
            rows = pa.RecordBatch.from_arrays([
                pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), np.int32)), pa.array(keys), tie,
                pa.array([t.size for t in raw], pa.int64()), packed, ids], names=["part", "guest", "k", "tie", "n_bytes", "packed", "doc_id"])
            yield rows
            if guests:
                more = rows.take(pa.array(guests))
                to = pa.array([first_of[k] for k in more.column("k").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([1] * len(guests), pa.int32()), *more.columns[2:]], names=rows.schema.names)

    dealt = map_batches(src, deal, "part int, guest int, k long, tie long, n_bytes long, packed binary, doc_id long")
    placed = dealt.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "guest", "k", "tie")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        held = None  # the document that waits for its follower: part, id, text, spots
        out: list[tuple] = []
        size = 0
        for batch in batches:
            cols = [batch.column(c) for c in ("part", "guest", "n_bytes", "packed", "doc_id")]
            for i in range(batch.num_rows):
                part, guest = cols[0][i].as_py(), cols[1][i].as_py()
                if guest and (held is None or held[0] != part):
                    continue  # a further row of the guest's id
                text = codec.decompress(cols[3][i].as_buffer(), cols[2][i].as_py(), asbytes=True).decode("utf-8")
                sig = spots(text, chain, gap)
                if held is not None:
                    _, own_id, own, own_sig = held
                    edited = edited_text(own, text)
                    edited_sig = spots(edited, chain, gap)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), to_text(own_sig), to_text(edited_sig),
                                jaccard(own_sig, edited_sig), jaccard(own_sig, sig)))
                    size += 8 * (len(own_sig) + len(edited_sig))
                held = None if guest else (part, cols[4][i].as_py(), text, sig)
                if size > 4 << 20:
                    yield _rows(out)
                    out, size = [], 0
        if out:
            yield _rows(out)

    return map_batches(placed, compare, StructType(NEIGHBOUR_FIELDS))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {LongType: pa.int64(), StringType: pa.string(), DoubleType: pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[type(f.dataType)]) for c, f in zip(zip(*rows), NEIGHBOUR_FIELDS)],
                                      names=[f.name for f in NEIGHBOUR_FIELDS])


def similar_pairs(docs: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                  chain: int = CHAIN, gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """Similarity join of fingerprints: ``(pairs, classes)``. ``classes``
    (``doc_id``, ``class_id``) puts documents of one fingerprint under their
    smallest id; ``pairs`` (``a``, ``b``, ``similarity``; a < b) are all pairs
    of classes with a Jaccard of ``at_least`` (above 0) or more. Empty
    fingerprints are in no pair and their own class; rows without an id take
    no part.

    Two sets that similar share one of the first n - ceil(at_least * n) + 1
    signatures when both are ordered from rare to frequent, so only those are
    indexed, under the range of the set's length: a longer partner is at most
    one range up.
    """
    fp = written(fingerprints(docs, id_col, text_col, chain, gap).filter("doc_id is not null"), "spots")
    reps = written(fp.filter("n_spots > 0").groupBy("fingerprint", "n_spots").agg(F.min("doc_id").alias("doc_id")), "classes")
    classes = fp.join(reps.select("fingerprint", F.col("doc_id").alias("c")), "fingerprint", "left") \
                .select("doc_id", F.coalesce("c", "doc_id").alias("class_id"))
    each = reps.select("doc_id", "n_spots", F.explode(F.expr("regexp_extract_all(fingerprint, '.{8}', 0)")).alias("sig"))
    freq = each.groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(freq, "sig").groupBy("doc_id", "n_spots").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("s"))
    prefix = F.slice("s", 1, (F.col("n_spots") - F.ceil(F.col("n_spots") * F.lit(at_least) - 1e-9) + 1).cast("int"))
    length = F.floor(F.log(F.col("n_spots").cast("double")) / F.lit(-math.log(at_least)) + 1e-9) if at_least < 1 else F.col("n_spots")
    index = written(ranked.select("doc_id", "n_spots", length.alias("range"), F.explode(prefix["sig"]).alias("sig")), "index")
    longer = index.selectExpr("doc_id as d2", "n_spots as n2", "explode(array(range, range - 1)) as range", "sig")
    cand = (index.join(longer, ["range", "sig"])
            .filter((F.col("n2") > F.col("n_spots")) | (F.col("n2") == F.col("n_spots")) & (F.col("d2") > F.col("doc_id")))
            .filter(F.col("n_spots") >= F.col("n2") * F.lit(at_least) - 1e-9)
            .select(F.least("doc_id", "d2").alias("a"), F.greatest("doc_id", "d2").alias("b")).distinct())
    both = (written(cand, "pairs").join(reps.selectExpr("doc_id as a", "fingerprint as fa"), "a")
            .join(reps.selectExpr("doc_id as b", "fingerprint as fb"), "b").select("a", "b", "fa", "fb"))

    def verify(batches):
        for b in batches:
            s = np.array([jaccard(from_text(x.as_py()), from_text(y.as_py()), at_least) for x, y in zip(b.column("fa"), b.column("fb"))], float)
            keep = pa.array(s > 0)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(s).filter(keep)],
                                             names=["a", "b", "similarity"])

    return map_batches(both, verify, "a long, b long, similarity double", rows=500), classes
