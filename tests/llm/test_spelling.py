"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from revsift.llm.queries import op11_spelling_variants
from revsift.llm.spelling import group_variants, numbered, slipped_words, spelling_variants

from .conftest import MEDIUM, documents


def plain_words(docs):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def plain_variants(count):
    near = defaultdict(set)
    holes, less = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            less[w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for short in less.keys() & count.keys():
        for w in less[short]:
            near[short].add(w)
            near[w].add(short)
    form = {}
    for w in count:
        if near[w]:
            best = min(near[w], key=lambda x: (-count[x], x))
            if count[best] >= 5 * count[w]:
                form[w] = best
    out = set()
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return out


def rows(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    want = plain_variants(plain_words(docs))
    assert rows(op11_spelling_variants(spark, MEDIUM)) == want
    assert sum(1 for w in want if w[1]) > 20


def test_dense_words_of_few_letters(spark):
    """Runs of equal letters, chains of forms, words that begin and end alike,
    over many partitions."""
    rnd = random.Random(2)
    count = {}
    for _ in range(3000):
        w = "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9)))
        count[w] = rnd.choice([5, 6, 30, 30, 160, 900, 20000])
    count |= {"a" * n: 5 ** n for n in range(1, 12)}
    count["b" * 30_000] = 7
    count["b" * 29_999] = 70
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = rows(group_variants(df))
    long = {w for w in got if len(w[0]) > 100}
    assert long == {("b" * 30_000, "b" * 29_999, "b" * 29_999, 7, 1, 70), ("b" * 29_999, None, "b" * 29_999, 70, 1, None)}
    assert got - long == plain_variants({w: n for w, n in count.items() if len(w) < 100})


def test_nodes_are_prefixes(spark):
    """The same number exactly for the same prefix, whatever the partitions."""
    rnd = random.Random(7)
    words = {"".join(rnd.choice("aab") for _ in range(rnd.randrange(1, 12))) for _ in range(400)} | {"aa" * 20}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    out, aliases = numbered(df, "word", "fwd", 37)
    node_of, prefix_of = {}, {}
    got = out.collect()
    assert len(got) == len(words) and aliases
    for r in got:
        assert len(r["fwd"]) == len(r["word"]) + 1
        for d, x in enumerate(r["fwd"]):
            x = aliases.get(x, x)
            assert node_of.setdefault(r["word"][:d], x) == x and prefix_of.setdefault(x, r["word"][:d]) == r["word"][:d]
    assert [r["word"] for r in sorted(got, key=lambda r: r["fwd_id"])] == sorted(words)


def test_slips():
    hit = next(i for i in range(10_000) if zlib.crc32(f"{i}:straße".encode()) % 199 == 0)
    h = zlib.crc32(f"{hit}:straße".encode())
    assert slipped_words(str(hit), "STRAße, straße×2") == {"straße"[:h % 6] + "straße"[h % 6 + 1:]: 1, "straße×": 1}
    assert slipped_words("1", "") == {}


def test_edges(spark):
    texts = ["letter " * 60 + "lettre Letter leter " + "lettter " * 5 + "short " * 9, None, "", "12 %", "lettter " * 2 + "ÉCOLES écoles " * 5, "letter"]
    df = documents(spark, texts, ids=[1, 2, None, None, None, 1]).withColumn("n", F.lit("x")).withColumnRenamed("lang", "word")
    want = plain_variants(plain_words(zip([1, 2, None, None, None, 1], texts)))
    assert rows(spelling_variants(df)) == want and any(w[:2] == ("lettter", "letter") for w in want)
    assert spelling_variants(df.limit(0)).count() == 0
