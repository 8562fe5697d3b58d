"""Operator 10 against plain versions."""

import hashlib
import random

import pytest

from revsift.llm import spotsigs
from revsift.llm.spotsigs import (ANCHORS, edited_text, fingerprint_neighbours, fingerprints, from_text, jaccard,
                                  similar_pairs, spots, to_text)

from .conftest import MEDIUM, documents, rows_by
from .test_licenses import plain_words


def plain_spots(text, chain=2):
    words = plain_words(text)
    stop = {a.decode() for a in ANCHORS}

    def find(is_anchor, is_content):
        out = set()
        for i, w in enumerate(words):
            if is_anchor(w):
                follow = [x for x in words[i + 1:i + 400] if is_content(x)][:chain]
                if len(follow) == chain:
                    out.add((w, *follow))
        return out

    return find(stop.__contains__, lambda w: w not in stop) or find(lambda w: True, lambda w: True) or ({tuple(words)} if words else set())


def plain_jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(docs, got):
    ids = sorted(docs)
    assert len(got) == len(ids)
    for n, i in enumerate(ids):
        own, nxt, r = docs[i] or "", docs[ids[(n + 1) % len(ids)]] or "", got[i]
        edited = edited_text(own, nxt)
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == to_text(spots(own)) and r["edited_fingerprint"] == to_text(spots(edited))
        a, b, c = (plain_spots(x) for x in (own, edited, nxt))
        assert r["near_edited"] == pytest.approx(plain_jaccard(a, b)) and r["near_next"] == pytest.approx(plain_jaccard(a, c))
        assert len(r["fingerprint"]) == 8 * len(a)


def test_query_matches_plain(spark, monkeypatch):
    from revsift.llm.queries import op10_fingerprints

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = rows_by(op10_fingerprints(spark, MEDIUM))
    check(docs, got)
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 37)  # many ranges
    assert rows_by(op10_fingerprints(spark, MEDIUM)) == got


def test_edges(spark):
    texts = {1: None, 5: "", 9: "ab", 12: "the of and", 14: "x" * 100_000, 20: "the cat sat on the mat " * 3000, 21: "日本 語 " * 5, 30: "word"}
    df = documents(spark, list(texts.values()), list(texts)).withColumnRenamed("lang", "part").withColumnRenamed("source", "k")
    check(texts, rows_by(fingerprint_neighbours(df)))
    assert fingerprint_neighbours(df.limit(0)).count() == 0
    one = fingerprint_neighbours(df.filter("doc_id = 9")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"ab").hexdigest() and one[0]["near_next"] == 1.0
    odd = documents(spark, ["the cat sat down", "the cat sat down", "a b", None, "z"], ids=[3, 3, 3, None, None])
    assert sorted((r["doc_id"] or 99) for r in fingerprint_neighbours(odd).collect()) == [3, 3, 3, 99, 99]


def test_equal_texts_and_pruned_jaccard():
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(300)}" for _ in range(60)] + ["the", "of", "der"] * 12
    sets = [spots(" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 200)))) for _ in range(60)]
    assert (from_text(to_text(sets[3])) == sets[3]).all()
    for a in sets:
        for b in sets:
            full = jaccard(a, b)
            assert full == plain_jaccard(set(a.tolist()), set(b.tolist()))
            for t in (0.1, 0.5, 0.8):
                if len(a) or len(b):
                    assert jaccard(a, b, t) == (full if full >= t else 0.0)


def test_similarity_join_matches_brute_force(spark):
    rnd = random.Random(6)
    common = ["the", "of", "and", "is", "to"]
    base = [rnd.choice(common) if i % 3 == 0 else f"w{rnd.randrange(400)}" for i in range(150)]
    texts = [" ".join(base)] * 4
    for share in (0.02, 0.05, 0.1) * 12:
        texts.append(" ".join(w if rnd.random() > share else f"x{rnd.randrange(99)}" for w in base[:rnd.randrange(110, 151)]))
    texts += ["", None, "the cat sat down", "lone"]
    df = documents(spark, texts)
    fp = {r["doc_id"]: r["fingerprint"] for r in fingerprints(df).collect()}
    for t in (0.5, 0.8):
        pairs, classes = similar_pairs(df, t)
        cls = {r["doc_id"]: r["class_id"] for r in classes.collect()}
        assert cls == {i: i if not fp[i] else min(j for j in fp if fp[j] == fp[i]) for i in fp}
        reps = sorted({c for c in cls.values() if fp[c]})
        want = {(a, b): jaccard(from_text(fp[a]), from_text(fp[b])) for a in reps for b in reps if a < b}
        want = {k: v for k, v in want.items() if v >= t}
        assert {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()} == pytest.approx(want) and want
