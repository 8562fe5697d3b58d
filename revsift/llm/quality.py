"""Operator 4: quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every text. Expectation
maximisation over the counts of vote patterns (at most 3 to the number of
heuristics, whatever the corpus) estimates how each heuristic votes on good
and on bad texts, and so the probability that a text with a given pattern is
good. Those posteriors are the labels on which a linear scorer over hashed
features (words, word shapes, words that repeat the one before) is fitted; the
scorer, not the votes, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from .common import id_text, map_batches
from .words import GOLD, _chunk, mix64, text_bytes, word_hashes

# Distinct rows on which the scorer is fitted, about (chosen by a hash of id and text).
FIT_ROWS = 4096
# Hash buckets of word features and of shape features.
DIM = 1 << 13
# Words of no weight that every text is taken to have besides its own, so that a few words decide little.
CALM = 5
EM_ROUNDS = 100
FIT_ROUNDS = 400
# Texts of a lower score are rejected.
LEAST_SCORE = 0.3

GOOD, BAD, ABSTAIN = 1, 0, 2

# Byte classes of the heuristics.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@^~|<>{}[]=_\\+`"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True
# Shape of a word: its byte classes, runs as one. 1 upper, 2 lower, 3 digit, others themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = ord("1"), ord("2"), ord("2"), ord("3")


@dataclass
class TextStats:
    """Numbers of every text of a batch."""

    words: np.ndarray
    bytes: np.ndarray
    letters: np.ndarray
    upper: np.ndarray
    ascii_letters: np.ndarray
    symbols: np.ndarray
    stops: np.ndarray
    shouts: np.ndarray
    repeats: np.ndarray  # words equal to the one before
    distinct: np.ndarray
    bare: np.ndarray  # words without a letter
    plain: np.ndarray  # words in small letters, the first perhaps a capital, perhaps one mark behind


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]


def read_texts(texts: pa.Array) -> tuple[TextStats, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, word features, shape features, word offsets) of a batch; the
    features are places below DIM, one for each word."""
    h, off = word_hashes(texts)
    buf, at = text_bytes(texts)
    at = at - at[0]
    buf = buf[:at[-1]] if len(buf) == at[-1] else buf[text_bytes(texts)[1][0]:][:at[-1]]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[1:] != owner[:-1])
    shape = _SHAPE[buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[at[:-1][at[:-1] < len(shape)]] = True  # nothing runs on from text to text
    cuts = np.concatenate([[0], np.cumsum(keep)])[at]
    shapes, _ = _chunked(shape[keep], cuts)
    bare = _bare_words(buf, at)
    plain = np.isin(shapes, _PLAIN)
    stats = TextStats(np.diff(off), np.diff(at), _sums(_LETTER[buf], at), _sums(_UPPER[buf], at), _sums(_ASCII_LETTER[buf], at),
                      _sums(_SYMBOL[buf], at), _sums(_STOP[buf], at), _sums(_SHOUT[buf], at), _sums(same, off),
                      np.bincount(owner[new], minlength=len(off) - 1), _sums(bare, off), _sums(plain, off))
    with np.errstate(over="ignore"):
        shapes = mix64(shapes + same.astype(np.uint64) * GOLD)
    return stats, (h % np.uint64(DIM)).astype(np.int64), (shapes % np.uint64(DIM)).astype(np.int64), off


def _chunked(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts given as bytes, text by group of texts."""
    out, n, at = [], [np.zeros(1, np.int64)], 0
    while at < len(off) - 1:
        end = int(max(at + 1, np.searchsorted(off, off[at] + (1 << 20), side="right") - 1))
        h, k = _chunk(buf[off[at]:off[end]], off[at:end + 1] - off[at])
        out.append(h)
        n.append(k)
        at = end
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(n))


def _bare_words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each word has no letter."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    gap = space[buf]
    first = np.ones(len(buf), bool)
    first[1:] = gap[:-1]
    first[at[:-1][at[:-1] < len(buf)]] = True
    starts = np.flatnonzero(first & ~gap)
    if not len(starts):
        return np.zeros(0, bool)
    return ~np.logical_or.reduceat(_LETTER[buf] & ~gap, starts)


def votes(s: TextStats) -> np.ndarray:
    """One column for each heuristic. Those that look for one defect say bad
    or nothing; the rest may also say good. Ratios are over at least one."""
    def ratio(a, b):
        return a / np.maximum(b, 1)

    def vote(bad, good=False):
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    some, many = s.words >= 5, s.words >= 20
    plain, per_stop, mean = ratio(s.plain, s.words), ratio(s.words, s.stops), ratio(s.letters, s.words)
    usual = 2 * np.sqrt(s.words)
    return np.stack([
        vote(some & (ratio(s.symbols, s.bytes) > 0.04)),
        vote(some & (ratio(s.upper, s.ascii_letters) > 0.4)),
        vote((s.repeats >= 4) & (ratio(s.repeats, s.words - 1) > 0.15)),
        vote((s.bare >= 8) & (ratio(s.bare, s.words) > 0.3)),
        vote(some & (ratio(s.shouts, s.words) > 0.15)),
        vote(many & (s.distinct < usual / 2), many & (s.distinct > usual)),
        vote(many & (per_stop > 100), many & (per_stop < 40) & (per_stop > 1.5)),
        vote(some & ((mean < 1.5) | (mean > 25)), some & (mean > 2.5) & (mean < 15)),
        vote(some & (plain < 0.6), some & (plain > 0.85)),
    ], axis=1)


LABELLERS = ("symbols", "capitals", "repeats", "bare", "shouts", "variety", "stops", "length", "plain")


def pattern_codes(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def pattern_votes(codes: np.ndarray, n: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n) % 3


_PLAIN = _chunk(np.frombuffer(" ".join(w + e for w in ("2", "12") for e in ("", *".,;:?!")).encode(), np.uint8),
                np.array([0, len(" ".join(w + e for w in ("2", "12") for e in ("", *".,;:?!")))]))[0]


@dataclass
class LabelModel:
    """Share of good texts and, by heuristic and class (bad, good), the
    probability of each vote (bad, good, abstain)."""

    good: float
    table: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good given rows of votes; abstentions say nothing."""
        log = np.log(self.table)
        score = np.zeros((len(v), 2)) + np.log([1 - self.good, self.good])
        for j in range(v.shape[1]):
            score += np.where((v[:, j] < 2)[:, None], log[j][:, v[:, j]].T, 0.0)
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -700, 700)))

    def accuracy(self) -> np.ndarray:
        """Of every heuristic, the probability that a vote it casts is right."""
        right = self.good * self.table[:, 1, GOOD] + (1 - self.good) * self.table[:, 0, BAD]
        cast = self.good * self.table[:, 1, :2].sum(axis=1) + (1 - self.good) * self.table[:, 0, :2].sum(axis=1)
        return right / np.maximum(cast, 1e-12)


def fit_labels(v: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation maximisation over distinct vote rows and how often each
    occurs. At first any vote for bad is believed."""
    q = np.where((v == BAD).any(axis=1), 0.02, 0.98) if len(v) else np.zeros(0)
    model = LabelModel(0.5, np.full((v.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        total = np.array([((1 - q) * counts).sum(), (q * counts).sum()])
        table = np.empty_like(model.table)
        for j in range(v.shape[1]):
            for c, w in enumerate(((1 - q) * counts, q * counts)):
                n = np.array([(w * (v[:, j] == x)).sum() for x in range(3)])
                table[j, c] = (n + 0.5) / (n.sum() + 1.5)
        model = LabelModel(float(np.clip((total[1] + 1) / (total.sum() + 2), 0.01, 0.99)), table)
        new = model.posterior(v)
        if not len(q) or np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


@dataclass
class Scorer:
    """Linear scorer: the mean weight of a text's words (CALM more of weight 0)
    and of their shapes, and a constant."""

    weights: np.ndarray  # 2 * DIM
    constant: float

    def score(self, words: np.ndarray, shapes: np.ndarray, off: np.ndarray) -> np.ndarray:
        each = self.weights[words] + self.weights[DIM + shapes]
        c = np.concatenate([[0.0], np.cumsum(each)])
        z = self.constant + (c[off[1:]] - c[off[:-1]]) / (np.diff(off) + CALM)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit_scorer(rows: np.ndarray, places: np.ndarray, shares: np.ndarray, labels: np.ndarray, rounds: int = FIT_ROUNDS,
               rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels by Adam steps over all rows;
    features are (row, place, share of the text's words)."""
    n = len(labels)
    if not n:
        return Scorer(np.zeros(2 * DIM), 1.0)
    prior = float(np.clip(labels.mean(), 0.01, 0.99))
    w, b = np.zeros(2 * DIM), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(labels >= 0.5, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9)).clip(max=10)
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, w[places] * shares, minlength=n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - labels) / n
        gw, gb = np.bincount(places, g[rows] * shares, minlength=2 * DIM) + decay * w / n, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * 0.1 * mb / (np.sqrt(vb) + 1e-8)
    return Scorer(w, float(b))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[LabelModel, Scorer]:
    """Vote counts over all rows of ``docs`` (``doc_id``, ``text``), posteriors
    by expectation maximisation, and a scorer fitted on about ``fit_rows``
    distinct rows (a row that occurs more than once is one of them). To the
    driver come the pattern counts (at most 3^9) and the hashed features of
    the sample (at most 2 * DIM numbers a row). Neither depends on the order
    in which rows arrive."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")

    def count(batches):
        for b in batches:
            s, *_ = read_texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(pattern_codes(votes(s))), b.column("key")], names=["code", "key"])

    # equal rows have equal patterns, so the distinct rows of the patterns add up
    patterns = map_batches(docs.select("text", key.alias("key")), count, "code long, key long").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("distinct")).toPandas()
    codes, n = patterns["code"].to_numpy(np.int64), patterns["n"].to_numpy(np.float64)
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    labels = fit_labels(pattern_votes(codes, len(LABELLERS)), n)
    share = min(1.0, fit_rows / max(float(patterns["distinct"].sum()), 1.0))
    picked = docs.filter(F.pmod(key, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).dropDuplicates(["doc_id", "text"])

    def features(batches):
        for b in batches:
            s, words, shapes, off = read_texts(b.column("text"))
            owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
            key, times = np.unique(np.concatenate([owner * 2 * DIM + words, owner * 2 * DIM + DIM + shapes]), return_counts=True)
            row, place = key // (2 * DIM), key % (2 * DIM)
            ends = np.searchsorted(row, np.arange(len(off)))
            part = (times / (np.diff(off) + CALM)[row]).astype(np.float32)
            raw_p, raw_s = place.astype(np.uint16), part
            yield pa.RecordBatch.from_arrays([
                pa.array(pattern_codes(votes(s))),
                pa.array([raw_p[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary()),
                pa.array([raw_s[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())], names=["code", "places", "shares"])

    sample = map_batches(picked, features, "code long, places binary, shares binary").toArrow()
    sample = sample.sort_by([("code", "ascending"), ("places", "ascending"), ("shares", "ascending")])  # the same order on every run
    places = [np.frombuffer(x, np.uint16) for x in sample.column("places").to_pylist()]
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    soft = labels.posterior(pattern_votes(sample.column("code").to_numpy(), len(LABELLERS)))
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    scorer = fit_scorer(rows, join(places, np.uint16).astype(np.int64),
                        join([np.frombuffer(x, np.float32) for x in sample.column("shares").to_pylist()], np.float32).astype(np.float64), soft)
    return labels, scorer


def classify_documents(docs: DataFrame, fit_rows: int = FIT_ROWS, least_score: float = LEAST_SCORE,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: ``doc_id``, ``n_words``, ``n_votes`` (votes
    cast), ``n_bad``, ``pattern`` (a digit for each heuristic: 0 bad, 1 good, 2
    none), ``posterior`` (of good, from the votes), ``score`` (of the fitted
    scorer) and ``kept`` (score of ``least_score`` or more).

    A null, empty or blank text gets no vote and the score of the constant.
    Repeated rows are judged alike; other columns are not read.
    """
    src = id_text(docs, id_col, text_col)
    labels, scorer = fit(src, fit_rows)
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_votes", IntegerType()),
              StructField("n_bad", IntegerType()), StructField("pattern", StringType()), StructField("posterior", DoubleType()),
              StructField("score", DoubleType()), StructField("kept", BooleanType())]

    def run(batches):
        for b in batches:
            s, words, shapes, off = read_texts(b.column("text"))
            v = votes(s)
            score = scorer.score(words, shapes, off)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(s.words), pa.array((v < 2).sum(axis=1), pa.int32()), pa.array((v == BAD).sum(axis=1), pa.int32()),
                pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string()), pa.array(labels.posterior(v)), pa.array(score),
                pa.array(score >= least_score)], names=[f.name for f in fields])

    return map_batches(src, run, StructType(fields))


def keep_good(docs: DataFrame, fit_rows: int = FIT_ROWS, least_score: float = LEAST_SCORE,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify_documents``
    keeps. One pass over the rows after fitting, no shuffle."""
    _, scorer = fit(id_text(docs, id_col, text_col), fit_rows)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            _, words, shapes, off = read_texts(b.column(at).fill_null(""))
            yield b.filter(pa.array(scorer.score(words, shapes, off) >= least_score))

    return map_batches(docs, run, docs.schema)
