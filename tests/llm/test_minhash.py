"""Operator 8 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from revsift.llm.minhash import (band_keys, components, linked_groups, near_duplicates, shingle_sets,
                                 super_minhash)
from revsift.llm.queries import op8_near_duplicates

from .conftest import MEDIUM, documents, rows_by

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, size=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_groups(texts):
    """id -> smallest id reached; all pairs."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 10 * min(len(sets[a]), len(sets[b])) >= 8 * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


def edited(rnd, words, share):
    return [rnd.choice("abcdefgh") + str(rnd.randrange(999)) if rnd.random() < share else w for w in words]


def test_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    sets, groups = plain_groups(texts)
    got = rows_by(op8_near_duplicates(spark, MEDIUM))
    assert len(got) == len(texts) and len(set(groups.values())) < len(texts)
    for i in texts:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), groups[i], groups[i] == i)


def test_planted_copies_and_chains(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)] * 30
    texts += [" ".join(edited(rnd, base, 0.02)) for _ in range(60)]  # near the limit: some linked, some not
    chain = list(base)
    for _ in range(25):  # each near the one before, far from the first
        chain = edited(rnd, chain, 0.015)
        texts.append(" ".join(chain))
    texts += [" ".join(f"v{rnd.randrange(5000)}" for _ in range(150)) for _ in range(20)]
    texts += ["one two", "One  TWO", "one", "", None, "   "]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    sets, groups = plain_groups(dict(zip(ids, texts)))
    got = rows_by(near_duplicates(documents(spark, texts, ids)))
    assert {i: r["component_id"] for i, r in got.items()} == groups
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_links_inside_buckets_are_complete(spark):
    """One bucket of everything: the links found must give all groups, whatever
    the centre: substituted, cut and lengthened copies, and a second family."""
    rnd = random.Random(8)
    for trial in range(3):
        base = [f"w{rnd.randrange(900)}" for _ in range(120)]
        twin = edited(rnd, base, 0.06)
        texts = [" ".join(edited(rnd, rnd.choice([base, twin]), rnd.choice([0.01, 0.03, 0.05]))) for _ in range(40)]
        texts += [" ".join(base[:rnd.randrange(70, 121)]) for _ in range(25)]
        texts += [" ".join(base + [f"z{rnd.randrange(3)}{i}" for i in range(rnd.randrange(0, 60))]) for _ in range(15)]
        texts = dict(enumerate(dict.fromkeys(texts)))
        df = documents(spark, list(texts.values())).select("doc_id", "text")
        sizes = {i: len(plain_set(t)) for i, t in texts.items()}
        # the centre is the member in the fullest buckets: another one in each trial
        lead = rnd.choice(list(texts))
        buckets = spark.createDataFrame([(1, i, n, len(texts)) for i, n in sizes.items()] + [(2, lead, sizes[lead], 1000)],
                                        "key long, doc_id long, n_shingles long, members long")
        _, want = plain_groups(texts)
        got = {r["node"]: r["component"] for r in linked_groups(buckets, df, spark.createDataFrame([], "a long, b long"), 4, 80).collect()}
        assert {i: got.get(i, i) for i in texts} == want and len(set(want.values())) > 1


def test_signatures_estimate_similarity_with_early_stop():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**63, 1000).astype(np.uint64))
    errors = []
    for share in (0.3, 0.6, 0.8, 0.9):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rnd.integers(0, 2**63, len(a) - n).astype(np.uint64)])
        true = n / (2 * len(a) - n)
        s = super_minhash(np.concatenate([a, b]), np.array([0, len(a), 2 * len(a)]))
        assert np.isfinite(s).all()
        errors.append(abs((s[0] == s[1]).mean() - true))
    assert max(errors) < 0.15
    tiny = super_minhash(np.array([7, 7, 9], np.uint64), np.array([0, 1, 2, 3, 3]))
    assert (tiny[0] == tiny[1]).all() and (tiny[0] != tiny[2]).any() and np.isfinite(tiny[:3]).all()
    assert (band_keys(tiny, 32)[0] == band_keys(tiny, 32)[1]).all()


def test_one_element_permutes_all_slots():
    s = super_minhash(np.array([12345], np.uint64), np.array([0, 1]), 64)
    assert sorted(np.floor(s[0]).astype(int)) == list(range(64))


def test_blocks_do_not_change_signatures():
    from revsift.llm import minhash

    rnd = np.random.default_rng(2)
    n = rnd.integers(0, 400, 60)
    off = np.concatenate([[0], np.cumsum(n)])
    h = rnd.integers(0, 2**63, off[-1]).astype(np.uint64)
    one = super_minhash(h, off)
    alone = np.concatenate([super_minhash(h[off[i]:off[i + 1]], np.array([0, n[i]])) for i in range(60)])
    assert minhash.TURN_ELEMENTS > 400 and ((one == alone) | (np.isinf(one) & np.isinf(alone))).all()


def test_shingles_of_words():
    h, off = shingle_sets(pa.array(["a b c d e", "A\tb  c\x0bd", "a b", "", "a b a b a b", " a "]), 4)
    assert np.diff(off).tolist() == [2, 1, 1, 0, 2, 1]
    assert h[off[1]] in h[:2]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(300, 999)] * 3
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}


def test_edges(spark):
    t = "the same words in one text of some length"
    df = documents(spark, [t, t, t, None, "other words that are not like the text at all", "lone"], ids=[None, 7, 7, 8, 7, None])
    df = df.withColumnRenamed("lang", "component_id").withColumnRenamed("source", "key")
    got = near_duplicates(df).collect()
    assert len(got) == 6
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got)
    assert near_duplicates(df.limit(0)).count() == 0
