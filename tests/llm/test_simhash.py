"""Operator 12 against brute force."""

import random
import re

import numpy as np
import xxhash

from revsift.llm import simhash
from revsift.llm.queries import op12_simhash_groups
from revsift.llm.simhash import close_pairs, fingerprint, key_masks, mask_levels, simhash_groups

from .conftest import MEDIUM, documents, rows_by

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text, size=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """id -> smallest id reached; ``prints`` holds (id, fingerprint) rows."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = np.array([f for _, f in prints], np.uint64)
    for n, (i, f) in enumerate(prints):
        apart = np.bitwise_count(fps[n + 1:] ^ np.uint64(f))
        for m in np.flatnonzero(apart <= 2):
            x, y = find(i), find(prints[n + 1 + m][0])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_query_matches_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    prints = [(i, plain_print(t)) for i, t in texts]
    groups = plain_groups(prints)
    got = rows_by(op12_simhash_groups(spark, MEDIUM))
    assert len(got) == len(texts) and len(set(groups.values())) < len(texts)
    for i, f in prints:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{f:016x}", groups[i])


def test_close_pairs_are_complete_in_crowded_buckets(spark):
    """Thousands of fingerprints that agree on most bits: buckets are cut
    again, to the last level, and no pair is lost."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base ^ rnd.getrandbits(12) << 20 for _ in range(900)}          # one dense family: 12 free bits
    fps |= {base ^ sum(1 << b for b in rnd.sample(range(64), 3)) for _ in range(300)}
    fps |= {rnd.getrandbits(64) for _ in range(500)}
    some = list(fps)[:200]
    fps |= {f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for f in some}
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    want = {(j, i) for i in range(len(fps)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 2)).tolist()}
    df = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "rep long, fp long")
    got = [(r["a"], r["b"]) for r in close_pairs(df, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000


def test_masks():
    levels = mask_levels(2)
    assert [len(x) for x in levels] == [10, 100, 1000]
    # any two flipped bits leave one key of each level whole
    for a in range(0, 64, 7):
        for b in range(64):
            held = 0
            for _ in range(simhash.LEVELS):
                held = next(m for m in key_masks(~held & (1 << 64) - 1, 2) if not m >> a & 1 and not m >> b & 1)
    assert max(64 - bin(m).count("1") for _, _, m in levels[-1]) <= 5


def test_fingerprint_of_long_text_in_blocks(monkeypatch):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["Aa", "bb", "çÇ", "dd\x0b", "x" * 40]) + str(rnd.randrange(50)) for _ in range(3000))
    want = plain_print(text), len(WORD.findall(text)) - 2
    assert fingerprint(text, 3) == want
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 7)
    assert fingerprint(text, 3) == want
    assert fingerprint("", 3) == (0, 0) and fingerprint("Ab  C", 3) == (xxhash.xxh64(b"ab c", seed=42).intdigest(), 1)


def test_edges(spark):
    t = "the same words in one text of some length"
    df = documents(spark, [t, t.upper(), None, "", "  ", "other words that are not like the text at all", "lone words", t],
                   ids=[9, 3, 8, 5, None, 9, None, None])
    df = df.withColumnRenamed("lang", "component_id").withColumnRenamed("source", "fp")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in simhash_groups(df).collect())
    p, o = f"{plain_print(t):016x}", f"{plain_print('other words that are not like the text at all'):016x}"
    zero = "0" * 16
    want = [(3, p, 3), (5, zero, 5), (8, zero, 5), (9, o, 3), (9, p, 3), (-1, zero, None), (-1, f"{plain_print('lone words'):016x}", None), (-1, p, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash_groups(df.limit(0)).count() == 0
