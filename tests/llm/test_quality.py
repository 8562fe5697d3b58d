"""Operator 4: held-out accuracy, expectation maximisation, edges."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from revsift.llm.quality import (ABSTAIN, BAD, DIM, GOOD, LABELLERS, classify_documents, fit, fit_labels, fit_scorer, keep_good,
                                 pattern_codes, pattern_votes, read_texts, votes)
from revsift.llm.common import id_text
from revsift.llm.queries import op4_quality

from .conftest import MEDIUM, SMALL, documents, rows_by

PROSE = "This is a plain text of some length. It has words, marks and more of both, as people write them. " * 4


def test_accuracy_on_labels_it_never_saw(spark):
    """The labels table is not used in fitting, so all of it is held out."""
    for sf in (SMALL, MEDIUM):
        labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        got = rows_by(op4_quality(spark, sf))
        assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
        right = [got[i]["kept"] == (q == 1) for i, q in labels.items()]
        assert np.mean(right) > 0.97
        assert all(got[i]["kept"] for i, q in labels.items() if q == 1 and got[i]["n_words"] > 20)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    n, good = 20_000, 0.7
    truth = rng.random(n) < good
    accuracy, cast = [0.95, 0.9, 0.8, 0.7], [0.9, 0.6, 0.9, 0.8]
    v = np.full((n, 4), ABSTAIN)
    for j in range(4):
        right = rng.random(n) < accuracy[j]
        vote = np.where(truth == right, GOOD, BAD)
        v[:, j] = np.where(rng.random(n) < cast[j], vote, ABSTAIN)
    codes, counts = np.unique(pattern_codes(v), return_counts=True)
    model = fit_labels(pattern_votes(codes, 4), counts.astype(float), 500)
    assert (pattern_votes(pattern_codes(v), 4) == v).all()
    assert np.abs(model.accuracy() - accuracy).max() < 0.05 and abs(model.good - good) < 0.05
    best_alone = max((np.where(v[:, j] == ABSTAIN, True, v[:, j] == GOOD) == truth).mean() for j in range(4))
    assert ((model.posterior(v) >= 0.5) == truth).mean() > best_alone


def test_scorer_separates_and_tolerates_one_class():
    rows, places = np.arange(100), np.where(np.arange(100) % 2, 5, 9)
    s = fit_scorer(rows, places, np.ones(100), (np.arange(100) % 2).astype(float))
    assert s.weights[5] > 0 > s.weights[9]
    one = fit_scorer(rows, places, np.ones(100), np.ones(100))
    assert one.score(np.array([1]), np.array([1]), np.array([0, 1]))[0] > 0.5
    assert fit_scorer(rows[:0], places[:0], np.ones(0), np.ones(0)).constant > 0


def test_counts_of_texts():
    t = ["Ab cd. ef! 12", "", "AB!! AB!! ab ab", "w | w |", "é É ###"]
    s, words, shapes, off = read_texts(pa.array(t))
    assert s.words.tolist() == [4, 0, 4, 4, 3] and off.tolist() == [0, 4, 4, 8, 12, 15]
    assert s.upper.tolist() == [1, 0, 4, 0, 0] and s.shouts.tolist() == [1, 0, 4, 0, 0]
    assert s.repeats.tolist() == [0, 0, 2, 0, 1 - 1] and s.distinct.tolist() == [4, 0, 2, 2, 3]
    assert s.bare.tolist() == [1, 0, 0, 2, 1] and s.plain.tolist() == [3, 0, 2, 2, 2]
    assert max(words.max(), shapes.max()) < DIM
    sliced, *_ = read_texts(pa.array(["xx", *t]).slice(1))
    assert sliced.words.tolist() == s.words.tolist() and sliced.upper.tolist() == s.upper.tolist()


def test_defects_are_named():
    s, *_ = read_texts(pa.array([PROSE, PROSE.upper(), "word " * 60, "a### b&&& c$$$ " * 9, "go | on | to | it | " * 9, "no!! way!! now!! go!! on!!"]))
    v = votes(s)
    assert not (v[0] == BAD).any()
    for row, name in ((1, "capitals"), (2, "repeats"), (3, "symbols"), (4, "bare"), (5, "shouts")):
        assert v[row, LABELLERS.index(name)] == BAD


def test_keep_good_keeps_columns_and_agrees(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {i for i, r in rows_by(classify_documents(df)).items() if r["kept"]}
    out = keep_good(df)
    assert out.schema == df.schema and {r["doc_id"] for r in out.collect()} == kept
    a, b = fit(id_text(df, "doc_id", "text")), fit(id_text(df.repartition(3), "doc_id", "text"))
    assert np.allclose(a[0].table, b[0].table) and np.allclose(a[1].weights, b[1].weights)


def test_edges(spark):
    texts = [None, "", "  \n", PROSE, PROSE, "BUY!! NOW!! " * 50_000, PROSE * 300]
    df = documents(spark, texts, [1, 2, None, 3, 3, 4, 5]).withColumnRenamed("lang", "score").withColumnRenamed("source", "kept")
    got = sorted(classify_documents(df).collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [r["n_words"] for r in got[:3]] == [0, 0, 0] and [r["n_votes"] for r in got[:3]] == [0, 0, 0]
    assert got[3] == got[4]
    kept = classify_documents(df).filter("kept").count()
    assert keep_good(df).count() == kept
    assert classify_documents(df.limit(0)).count() == 0 and keep_good(df.limit(0)).count() == 0


def plain_votes(text):
    """The heuristics word by word."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    n = len(words)

    def count(cls):
        return len(re.findall(cls, b))

    def vote(bad, good=False):
        return 0 if bad else 1 if good else 2

    letters, stops = count(rb"[A-Za-z\x80-\xff]"), count(rb"[.!?:;]")
    low = [w.lower() for w in words]
    repeats = sum(x == y for x, y in zip(low, low[1:]))
    bare = sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words)
    plain = sum(re.fullmatch(rb"[A-Z]*[a-z\x80-\xff]+(\.+|,+|;+|:+|\?+|!+)?", w) is not None for w in words) / max(n, 1)
    per_stop, mean, usual = n / max(stops, 1), letters / max(n, 1), 2 * math.sqrt(n)
    return n, [
        vote(n >= 5 and count(rb"[#$%&*@^~|<>{}\[\]=_\\+`]") / max(len(b), 1) > 0.04),
        vote(n >= 5 and count(rb"[A-Z]") / max(count(rb"[A-Za-z]"), 1) > 0.4),
        vote(repeats >= 4 and repeats / max(n - 1, 1) > 0.15),
        vote(bare >= 8 and bare / max(n, 1) > 0.3),
        vote(n >= 5 and count(rb"!") / max(n, 1) > 0.15),
        vote(n >= 20 and len(set(low)) < usual / 2, n >= 20 and len(set(low)) > usual),
        vote(n >= 20 and per_stop > 100, n >= 20 and 1.5 < per_stop < 40),
        vote(n >= 5 and (mean < 1.5 or mean > 25), n >= 5 and 2.5 < mean < 15),
        vote(n >= 5 and plain < 0.6, n >= 5 and plain > 0.85)]


def test_whole_result_against_plain_python(spark):
    """Votes, posteriors and scores of every document, one text at a time; only
    the hash of a word and the fitted weights are the operator's."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = rows_by(op4_quality(spark, SMALL))
    read = {r["doc_id"]: plain_votes(r["text"]) for r in rows}

    # expectation maximisation, row by row in place of counts of patterns
    v = [x[1] for x in read.values()]
    q = [0.02 if 0 in x else 0.98 for x in v]
    for _ in range(100):
        table = [[[(sum(w for x, w in zip(v, ws) if x[j] == k) + 0.5) / (sum(ws) + 1.5) for k in range(3)]
                  for ws in ([1 - a for a in q], q)] for j in range(len(LABELLERS))]
        good = min(0.99, max(0.01, (sum(q) + 1) / (len(q) + 2)))
        new = []
        for x in v:
            z = math.log(1 - good) - math.log(good) + sum(math.log(table[j][0][k]) - math.log(table[j][1][k]) for j, k in enumerate(x) if k < 2)
            new.append(1 / (1 + math.exp(min(700, max(-700, z)))))
        stop = max(abs(a - b) for a, b in zip(new, q)) < 1e-6
        if stop:
            break
        q = new
    _, scorer = fit(id_text(df, "doc_id", "text"))
    for (i, (n, x)), posterior in zip(read.items(), new):
        r = got[i]
        assert (r["n_words"], r["n_votes"], r["n_bad"], r["pattern"]) == (n, sum(k < 2 for k in x), x.count(0), "".join(map(str, x)))
        assert r["posterior"] == pytest.approx(posterior, abs=1e-6)
    for r in rows:
        _, words, shapes, _ = read_texts(pa.array([r["text"] or ""]))
        z = scorer.constant + sum(scorer.weights[a] + scorer.weights[DIM + b] for a, b in zip(words, shapes)) / (len(words) + 5)
        score = 1 / (1 + math.exp(-z))
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-9) and got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] >= 0.3)


def test_repeated_rows_do_not_move_the_fit(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    few = df.orderBy("doc_id").limit(7)
    many = few.crossJoin(spark.range(3000)).drop("id")
    a, b = fit(many, 64), fit(many.repartition(5), 64)
    assert np.array_equal(a[1].weights, b[1].weights) and np.array_equal(a[1].weights != 0, fit(few, 64)[1].weights != 0)
