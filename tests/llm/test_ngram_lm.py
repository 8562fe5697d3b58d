"""Operator 2 against a plain model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from revsift.llm import ngram_lm
from revsift.llm.hash_arrays import HashTable, bucket_of, write_bucket
from revsift.llm.ngram_lm import PLAIN_DISCOUNTS, discounts, score_documents

from .conftest import SMALL, documents, rows_by

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, START = ("end",), ("start",)


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        counts = {k: Counter() for k in range(1, order + 1)}
        self.raw = Counter()
        for t in texts:
            toks = tokens(t)
            self.raw.update(toks)
            seq = [START, *toks]
            for i in range(1, len(seq)):
                g = tuple(seq[max(0, i - order + 1):i + 1])
                if len(g) > 1:
                    counts[len(g)][g] += 1
        for k in range(order, 1, -1):
            for g in counts[k]:
                counts[k - 1][g[1:]] += 1
        self.counts, self.d, self.ctx = counts, {}, {}
        for k, c in counts.items():
            by = Counter(c.values())
            self.d[k] = discounts(*(by[j] for j in (1, 2, 3, 4)))
            ctx = self.ctx[k] = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in c.items():
                s = ctx[g[:-1]]
                s[0] += n
                s[min(n, 3)] += 1
        self.v = len(self.raw)

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / (self.v + 1)
        s = self.ctx[k].get(g[:-1])
        if not s:
            return self.p(g[1:])
        n, d = self.counts[k][g], self.d[k]
        return (max(0.0, n - (0, *d)[min(n, 3)]) + sum(x * y for x, y in zip(d, s[1:])) * self.p(g[1:])) / s[0]

    def score(self, text):
        seq = [START, *tokens(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1):i + 1]))) for i in range(1, len(seq)))


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def check(rows, got, order):
    model = Plain([t for i, t in rows if not held_out(i)], order)
    n, v = sum(model.raw.values()), model.v
    assert len(got) == len(rows)
    for i, t in rows:
        r, toks = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(i), len(toks), n)
        assert r["n_known"] == sum(model.raw[w] > 0 for w in toks)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks), rel=1e-9)
        assert r["score"] == pytest.approx(model.score(t), rel=1e-9)
    return model


def test_query_matches_the_plain_model(spark, monkeypatch):
    from revsift.llm.queries import op2_kneser_ney

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = rows_by(op2_kneser_ney(spark, SMALL))
    check(rows, got, ngram_lm.ORDER)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 20_000)  # many buckets and pieces
    monkeypatch.setattr(ngram_lm, "HELD_GRAMS", 1000)
    monkeypatch.setattr(ngram_lm, "SLICE_BYTES", 5000)
    again = rows_by(op2_kneser_ney(spark, SMALL))
    assert all(again[i]["score"] == pytest.approx(got[i]["score"], rel=1e-12) for i in got)


def test_query_scores_with_trigrams(spark):
    from revsift.llm.queries import op2_kneser_ney

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, rows_by(op2_kneser_ney(spark, SMALL)), 3)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders(spark, monkeypatch, order):
    rnd = random.Random(order)
    words = ["a", "b", "c", "d", "e", "the", "The", "é"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(words[:rnd.choice([4, 20, 48])]) for _ in range(rnd.randrange(0, 30)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "unknown words only here"), (503, "a " * 3000)]
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 1500)
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnRenamed("lang", "bucket").withColumnRenamed("source", "score")
    model = check(rows, rows_by(score_documents(df, order)), order)
    # probabilities after a context sum to 1 over the words and the unknown one
    for ctx in ((), ("a",), (START,), ("the", "b")[:order - 1]):
        assert sum(model.p((*ctx, w)) for w in [*model.raw, "never seen"]) == pytest.approx(1)


def test_edges(spark):
    one = documents(spark, ["a b", "a b", None], ids=[1, 1, 1])
    assert len(score_documents(one).collect()) == 3
    assert score_documents(one.limit(0)).count() == 0
    nobody = documents(spark, ["x y", None], ids=[None, None])  # held out, nothing to learn from
    got = score_documents(nobody).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    with pytest.raises(ValueError):
        ngram_lm.train(one, 1)


def test_buckets_of_frequent_and_rare_words():
    """A context settles with all its trigrams, and a pair after a rare word with
    all trigrams that it ends; words that are frequent decide no bucket alone."""
    rnd = np.random.default_rng(3)
    ids = (rnd.integers(0, 6, (4000, 3)) * 2 + rnd.integers(0, 2, (4000, 3))).astype(np.uint32)
    b = ngram_lm.gram_bucket(ids, 64)
    hot = ngram_lm.is_hot(ids[:, :2])
    assert (b == ngram_lm.context_bucket(ids[:, :2], 64))[~hot].all()
    rare = ~ngram_lm.is_hot(ids[:, 1:2])
    assert (b == ngram_lm.gram_bucket(ids[:, 1:], 64))[rare].all()
    same = (ids[:, :2] == ids[hot][0, :2]).all(axis=1)
    assert len(set(b[same].tolist())) > 1 and 0 < hot.sum() < len(ids)
    assert ngram_lm.gram_bucket(ids[:0], 64).tolist() == [] and ngram_lm.gram_bucket(ids[:, :1], 64).max() < 64


def test_discounts():
    assert discounts(0, 5, 1, 1) == PLAIN_DISCOUNTS
    d = discounts(100, 40, 20, 10)
    assert all(0 < x < j for j, x in enumerate(d, 1))


def test_hash_arrays(tmp_path):
    rnd = np.random.default_rng(0)
    h = np.unique(rnd.integers(0, 2**64, 5000, dtype=np.uint64))
    v = np.where(rnd.random(len(h)) < 0.1, rnd.integers(255, 10**12, len(h)), rnd.integers(0, 255, len(h))).astype(np.uint64)
    for buckets in (1, 3, 64):
        b = bucket_of(h, buckets)
        assert (np.diff(b) >= 0).all() and b.max() < buckets
        t = HashTable(str(tmp_path / str(buckets)), "t", 2)
        for i in range(buckets):
            write_bucket(t.uri(i), h[b == i], [v[b == i], v[b == i] % np.uint64(7)])
        q = np.sort(np.concatenate([h, rnd.integers(0, 2**64, 5000, dtype=np.uint64)]))
        want = dict(zip(h.tolist(), v.tolist()))
        mixed = rnd.permutation(len(q))
        a, m = (np.empty(len(q), np.int64) for _ in range(2))
        a[mixed], m[mixed] = t.get(q[mixed], bucket_of(q, buckets)[mixed])
        assert a.tolist() == [want.get(x, 0) for x in q.tolist()] and (m == a % 7).all()
        assert [x.tolist() for x in t.get(q[:0], np.zeros(0, np.int64))] == [[], []]
        assert not any(t.get(q[:3], np.full(3, buckets))[0])  # a bucket without a file
