"""Operator 3: the table's fill against a plain one, balance and movement."""

import hashlib
from collections import Counter

import pytest

from revsift.llm.queries import SHARDS, op3_sharding
from revsift.llm.sharding import TABLE_SIZE, fill_table, place_documents

from .conftest import MEDIUM, documents, rows_by


def h(t):
    return int(hashlib.md5(t.encode()).hexdigest()[:15], 16)


def plain_fill(shards, size):
    prefs = [[(h(f"offset:{s}") % size + j * (h(f"skip:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner, at, left = [-1] * size, [0] * len(shards), size
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while owner[prefs[i][at[i]]] >= 0:
                at[i] += 1
            owner[prefs[i][at[i]]] = i
            left -= 1
    return owner


def test_fill_matches_a_plain_fill():
    names = [f"n{i}" for i in range(7)]
    assert fill_table(names, 211) == plain_fill(names, 211)
    assert fill_table(["only"], 2) == [0, 0]


def test_slots_are_even_weighted_and_stable():
    owner = fill_table(SHARDS)
    counts = Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = fill_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer) if a != len(SHARDS) - 1)
    assert moved < 0.03 * TABLE_SIZE
    w = Counter(fill_table(["a", "b"], 1009, [1.0, 3.0]))
    assert 2.8 < w[1] / w[0] < 3.2


def test_query_places_every_row(spark):
    docs = [r["doc_id"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id").collect()]
    owner, fewer = fill_table(SHARDS), fill_table(SHARDS[:-1])
    got = rows_by(op3_sharding(spark, MEDIUM))
    assert len(got) == len(docs)
    for i in docs:
        slot = h(str(i)) % TABLE_SIZE
        assert (got[i]["slot"], got[i]["shard"], got[i]["next_shard"]) == (slot, owner[slot], fewer[slot])


def test_plan_has_no_python_and_no_row_shuffle(spark):
    plan = op3_sharding(spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ReadSchema: struct<doc_id:bigint>" in plan


def test_edges(spark):
    df = documents(spark, ["a", None, "c"], ids=[None, 5, 5]).withColumnRenamed("lang", "slot").withColumnRenamed("source", "shard")
    got = place_documents(df, ["x", "y"], size=11).collect()
    assert len(got) == 3 and {r["next_shard"] for r in got} == {None}
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert {r["slot"] for r in got if r["doc_id"] is None} == {h("") % 11}
    assert place_documents(df.limit(0), ["x"], size=11).count() == 0
    for bad in ((["a", "a"], 11), ([], 11), (["a"], 10), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill_table(*bad)
