"""Operator 7 against a plain computation."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from revsift.llm import mixing
from revsift.llm.mixing import mix_sources, mixed_documents
from revsift.llm.queries import op7_source_mix

from .conftest import MEDIUM, SMALL, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def plain_mix(rows, seed="mix"):
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(rows)}
    by = defaultdict(int)
    for k, (_, _, s) in enumerate(rows):
        by[s] += size[k]
    target, taken = plain_targets(by), {}
    for s in by:
        mine = [k for k in size if rows[k][2] == s]
        whole = math.floor(target[s] / by[s] + 1e-12) if by[s] else 0
        lack = max(0.0, target[s] - whole * by[s])
        mass = sum(size[k] * math.sqrt(size[k]) for k in mine)
        rank = {}
        for k in mine:
            taken[k] = whole * size[k]
            if size[k] and lack > 0:
                key = "" if rows[k][0] is None else str(rows[k][0])
                u = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                p = min(1 - 1e-9, lack / mass * math.sqrt(size[k]))
                rank[k] = (u * (1 - p)) / (u * (1 - p) + (1 - u) * p)
        total = 0
        same = defaultdict(list)  # equal rows go together
        for k in rank:
            same[rank[k], rows[k][0] or 0, size[k]].append(k)
        for key in sorted(same):
            words = sum(size[k] for k in same[key])
            if total >= lack or total + words - lack > lack - total:
                break
            for k in same[key]:
                taken[k] += size[k]
            total += words
    return size, by, target, taken


def test_query_matches_the_plain_mix(spark):
    for sf in (SMALL, MEDIUM):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        size, by, target, taken = plain_mix(rows)
        got = {r["doc_id"]: r for r in op7_source_mix(spark, sf).collect()}
        assert len(got) == len(rows)
        sums = defaultdict(int)
        for k, (i, _, s) in enumerate(rows):
            assert (got[i]["size"], got[i]["source_size"], got[i]["taken"]) == (size[k], by[s], taken[k])
            assert math.isclose(got[i]["target"], target[s], rel_tol=1e-9)
            assert got[i]["taken"] <= 3 * got[i]["size"]
            sums[s] += got[i]["taken"]
        for s in by:
            assert abs(sums[s] - target[s]) <= max(size[k] for k, r in enumerate(rows) if r[2] == s)


def test_many_bins_and_reruns_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    one = sorted(map(tuple, mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "LEAST_BINS", 3)
    assert sorted(map(tuple, mix_sources(df.repartition(5)).collect())) == one


def test_mixed_documents_repeat_rows_as_taken(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("row", F.lit(1)).withColumn("copies", F.lit("x"))
    want = {r["doc_id"]: r["copies"] for r in mix_sources(df).collect() if r["copies"]}
    out = mixed_documents(df)
    assert out.schema == df.schema
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == want and max(want.values()) > 1 and len(want) < df.count()
    assert mixed_documents(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op7_source_mix(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (4, "x", "b"), (4, "x", "b"), (None, "q w", "b"), (6, "w " * 50_000, "c")]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, lack int, bin int")
    size, by, target, taken = plain_mix(rows)
    got = mix_sources(df).collect()
    assert len(got) == 7
    assert sorted(r["taken"] for r in got) == sorted(taken.values())
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in target.items()}
    assert mix_sources(df.limit(0)).count() == 0
    zero = mix_sources(df.filter("doc_id <= 2")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in zero] == [(0, 0.0, 0)] * 2
