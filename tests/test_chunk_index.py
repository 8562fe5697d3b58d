"""The block-max index, the chunk index and the vector table's versions."""

import random

import pytest
from pyspark.sql import functions as F

from revsift.operators import evaluate as ev
from revsift.operators import retrieval as rt
from revsift.operators.blockmax import BlockMaxIndex
from revsift.operators.index import ChunkIndex
from revsift.sources.io import VectorTable
from tests.conftest import rows


def test_block_max_equals_exhaustive_and_skips_spans(spark, tmp_path):
    """Text ids, ties, repeated terms, documents without words, unknown words;
    most spans are ruled out by their bounds."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(3000):
        topic = i // 300  # near numbers are alike, as chunks of one text are
        n = rnd.randrange(3, 30)
        docs.append((f"d{i:05d}", " ".join(rnd.choice(words[topic * 30:topic * 30 + 30] if rnd.random() < 0.8 else words) for _ in range(n))))
    docs += [("e1", ""), ("e2", None), ("e3", "the of"), ("e4", docs[7][1]), ("e5", docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    queries = [(i, " ".join(rnd.choice(words[(i % 10) * 30:(i % 10) * 30 + 30]) for _ in range(4))) for i in range(20)]
    queries += [(50, docs[7][1]), (51, "unknown"), (52, ""), (53, "w1 w1 w290 unknown")]
    q = spark.createDataFrame(queries, "q int, text string")
    index = BlockMaxIndex.build_or_load(spark, str(tmp_path / "ix"), df)
    got, status = index.search(q, k=7, with_status=True)
    assert rows(got) == rows(rt.bm25_topk(q, df, k=7))
    read = status.agg(F.sum("scored").alias("s"), F.sum("spans").alias("n")).first()
    assert read["s"] < 0.5 * read["n"]
    again = BlockMaxIndex.build_or_load(spark, str(tmp_path / "ix"), df.limit(0))
    assert rows(again.search(q, k=7)) == rows(got)
    assert index.search(q.limit(0)).count() == 0


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "word")], "q long, text string")
    assert BlockMaxIndex.build_or_load(spark, str(tmp_path / "ix"), df).search(q).count() == 0


def test_chunk_index_names_nodes(spark, tmp_path):
    """Stored nodes go through every search and back to their texts."""
    docs = spark.createDataFrame([(7, "Cats sleep on mats. Dogs bark at cats. Stock markets fell. Bond markets rose."),
                                  (8, "A quiet cat on a warm mat."), (9, ""), (10, None)], "doc_id long, text string")
    path = str(tmp_path / "chunks")
    index = ChunkIndex.build_or_load(spark, path, docs)
    q = spark.createDataFrame([("a", "cat mat"), ("b", "markets"), ("c", "")], "q string, text string")
    hits = index.search(q).collect()
    assert {r["q"] for r in hits} >= {"a", "b"} and all(":" in r["doc"] for r in hits)
    assert next(r["doc"] for r in hits if r["q"] == "a" and r["rank"] == 1).startswith("8:")
    diverse = index.search(q, mode="mmr", k=2).collect()
    assert all(r["rank"] <= 2 for r in diverse) and {r["q"] for r in diverse} >= {"a", "b"}
    lists = spark.createDataFrame(diverse).groupBy("q").agg(F.collect_list("doc").alias("ids"))
    found, missing = ev.fetch_nodes(lists, index.nodes, node_id="node_id")
    assert found.count() == len(diverse) and missing.count() == 0
    near = rt.dense_topk(index.vectors.select(F.col("node_id").alias("q"), "embedding"), index.vectors, k=1, id_col="node_id").collect()
    assert near and all(r["score"] == 1.0 for r in near)
    reused = ChunkIndex.build_or_load(spark, path, docs.limit(0))
    assert rows(reused.search(q)) == sorted([tuple(r) for r in hits], key=repr)
    with pytest.raises(ValueError):
        index.search(q, mode="other")


def test_vector_table_versions(spark, tmp_path):
    """Vectors are made unit vectors; a reader keeps its version while others
    are written; a failed write changes nothing."""
    t = VectorTable(str(tmp_path / "v"), dim=2)
    assert not t.exists(spark) and t.count(spark) == 0
    with pytest.raises(FileNotFoundError):
        t.read(spark)
    schema = "id long, embedding array<float>"
    assert t.write(spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], schema)) == 1
    old = t.read(spark)
    assert {r["id"]: r["embedding"] and [round(x, 6) for x in r["embedding"]] for r in old.collect()} == {1: [0.6, 0.8], 2: None, 3: None}
    assert t.write(spark.createDataFrame([(4, [0.0, 9.0])], schema), recreate=False) == 2
    assert t.count(spark) == 4 == t.read(spark).count()
    with pytest.raises(Exception, match="vector dimension"):
        t.write(spark.createDataFrame([(5, [1.0])], schema))
    assert t.count(spark) == 4
    assert t.write(spark.createDataFrame([(6, [1.0, 1.0])], schema)) == 3
    assert old.count() == 3 and [r["id"] for r in t.read(spark).collect()] == [6]
    assert len(t.vacuum(spark)) == 3 and t.read(spark).count() == 1  # two versions and the failed one
    with pytest.raises(ValueError):
        VectorTable(t.path, dim=3).read(spark)


def test_chunk_search_leaves_stored_texts_where_they_are(spark, tmp_path):
    """The candidates are broadcast; no plan deals the stored texts or vectors by node."""
    docs = spark.createDataFrame([(i, f"The dog number {i} sleeps. The cat {i % 3} runs.") for i in range(30)], "doc_id long, text string")
    index = ChunkIndex.build_or_load(spark, str(tmp_path / "ix"), docs)
    q = spark.createDataFrame([(1, "dog cat"), (2, "number 7")], "q long, text string")
    plan = index.search(q)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" not in plan and "hashpartitioning(node_id" not in plan and "BroadcastHashJoin" in plan


def test_block_scores_by_broadcast_and_by_shuffle(spark, tmp_path, monkeypatch):
    """Wanted spans go to the blocks while they are few; beyond the bound the rows are the same."""
    from revsift.operators import blockmax
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{rnd.randrange(40)}" for _ in range(12))) for i in range(900)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i + 7} w{i + 11}") for i in range(12)], "q int, text string")
    index = BlockMaxIndex.build_or_load(spark, str(tmp_path / "ix"), docs)
    few = index.search(q, k=5)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
    got = rows(few)
    monkeypatch.setattr(blockmax, "MAX_WANTED", 1)
    assert rows(index.search(q, k=5)) == got == rows(rt.bm25_topk(q, docs, k=5))


def test_index_build_moves_no_chunk_texts(spark, tmp_path, monkeypatch):
    """the nodes of documents with one row each are made where the row is;
    rows that share an id or have none still share their nodes."""
    from revsift.operators import chunking as ch
    docs = [(i, f"The dog number {i} sleeps. The cat {i % 3} runs.", f"m{i}") for i in range(30)]
    schema = "doc_id long, text string, lang string"
    plans, write = [], ch.build_or_load
    monkeypatch.setattr(ch, "build_or_load", lambda spark, path, build, recreate=False: write(
        spark, path, lambda: plans.append(df := build()) or df, recreate))

    def built(rows_, name):
        nodes = ch.build_index(spark, spark.createDataFrame(rows_, schema).repartition(8), str(tmp_path / name), meta_cols=["lang"])
        return sorted((r["node_id"], r["doc_id"], r["chunk_no"], r["text"], r["metadata"] and r["metadata"]["lang"],
                       r["embedding"] and tuple(r["embedding"])) for r in nodes.collect())

    plain = built(docs, "plain")
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    assert [p[:4] for p in plain] == sorted((f"{r['doc']}:{r['chunk_no']}", r["doc"], r["chunk_no"], r["text"])
                                            for r in ch.semantic_chunks(spark.createDataFrame(docs, schema)).collect())
    assert all(p[4] == f"m{p[1]}" and abs(sum(x * x for x in p[5]) - 1) < 1e-6 for p in plain)
    more = [(5, "Another text of five.", "n5"), (None, "No id. Not one.", "x"), (40, ", ;", "y"), (41, None, "z")]
    odd = built([*docs, *more], "odd")
    assert [p for p in odd if p[1] is not None and p[1] not in (5, 40)] == [p for p in plain if p[1] != 5]
    five = [p for p in odd if p[1] == 5]
    assert len(five) == 2 * (1 + len([p for p in plain if p[1] == 5])) and {p[4] for p in five} == {"m5", "n5"}
    assert len({p[5] for p in five if p[2] == 0}) == 1 and five[0][5] != next(p[5] for p in plain if p[0] == "5:0")
    assert [(p[0], p[4]) for p in odd if p[1] is None][0] == ("0", None)
    assert [(p[0], p[5]) for p in odd if p[1] == 40] == [("40:0", None)]


def test_blocks_of_spans_cut_by_batches(spark):
    """Spans that end in, at, or beyond a batch are whole blocks."""
    import pyarrow as pa
    from revsift.operators.blockmax import _span_blocks
    rnd = random.Random(3)
    posts = [(rnd.choice("abcd"), s, o, rnd.random()) for s in (0, 2, 3, 7) for o in rnd.sample(range(s * 10, s * 10 + 10), 7)]
    posts += [("a", 7, 99, 0.5), ("a", 7, 98, 0.25)]
    want = sorted((t, s, max(x[3] for x in posts if x[:2] == (t, s)), [x[2] for x in sorted(posts, key=lambda x: x[2]) if x[:2] == (t, s)])
                  for t, s in {x[:2] for x in posts})
    table = pa.table(dict(zip(["term", "span", "ord", "w"], map(list, zip(*posts)))))
    for size in (1, 2, 5, 7, 13, 100):
        out = [r for b in _span_blocks(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted((r["term"], r["span"], r["top"], r["ords"]) for r in out) == want
        assert [r["span"] for r in out] == sorted(r["span"] for r in out)
        weight = {(x[0], x[2]): x[3] for x in posts}
        assert all(r["weights"] == [weight[r["term"], o] for o in r["ords"]] for r in out)
    assert list(_span_blocks(iter([]))) == []


def test_index_and_search_move_no_postings(spark, tmp_path, monkeypatch):
    """Spans are made and scored where their rows are: the build has no
    shuffle and no checkpoint of postings, and a task of the search hands on no
    more than the k best of a query (and rows level with the last of them)."""
    from revsift.operators import blockmax
    built, write = [], blockmax.build_or_load
    monkeypatch.setattr(blockmax, "build_or_load", lambda spark, path, build, recreate=False, **kw: write(
        spark, path, lambda: built.append(df := build()) or df, recreate, **kw))
    rnd = random.Random(4)
    docs = spark.createDataFrame([(f"d{i:04d}", " ".join(f"w{min(int(rnd.expovariate(0.2)), 30)}" for _ in range(rnd.randrange(5, 40)))) for i in range(4000)],
                                 "doc_id string, text string").coalesce(4)
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w0") for i in range(6)], "q int, text string")
    index = BlockMaxIndex.build_or_load(spark, str(tmp_path / "ix"), docs)
    plan = built[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[doc_id", "")
    seen, score = [], blockmax._score_rows

    def counted(asked, k):
        seen.append((asked, k))
        return score(asked, k)
    monkeypatch.setattr(blockmax, "_score_rows", counted)
    out = index.search(q, k=5)
    assert rows(out) == rows(rt.bm25_topk(q, docs, k=5))
    assert len(seen) == 2  # both passes
    qt = rt.query_terms(q).join(index.terms, "term").select("q", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    found = index.spans.coalesce(1).mapInArrow(score(blockmax._Batch(qt.toArrow()), 5), "q int, id string, score double").collect()
    assert 6 * 5 <= len(found) < 6 * 50  # of 6 x some thousand rows with a score


def test_level_scores_keep_the_smallest_ids(spark, tmp_path):
    """Thousands of equal documents in any order, without an id or with one twice: the ids decide, as in exhaustive search."""
    rnd = random.Random(8)
    ids = [f"{i}:{j}" for i in range(700) for j in range(3)]
    rnd.shuffle(ids)
    docs = [(x, "same words here") for x in ids] + [(None, "same words here"), ("0:0", "same words here"), ("zz", "other words"), ("zy", "")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    q = spark.createDataFrame([("a", "same words"), ("b", "other"), ("c", "nothing")], "q string, text string")
    got = [(r["q"], r["rank"], r["doc"]) for r in BlockMaxIndex.build_or_load(spark, str(tmp_path / "ix"), df).search(q, k=7).orderBy("q", "rank").collect()]
    best = [None, "0:0", "0:0", *sorted(set(ids))[1:5]]
    assert got == [("a", i + 1, x) for i, x in enumerate(best)] + [("b", 1, "zz")]


def test_mmr_over_chunks_leaves_the_vectors_where_they_are(spark, tmp_path):
    """the few candidates go to the stored vectors, also where Spark would not broadcast by itself."""
    docs = spark.createDataFrame([(i, f"The dog number {i} sleeps. The cat {i % 3} runs.") for i in range(30)], "doc_id long, text string")
    index = ChunkIndex.build_or_load(spark, str(tmp_path / "ix"), docs)
    q = spark.createDataFrame([(1, "dog cat"), (2, "number 7")], "q long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.search(q, mode="mmr", k=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning(id" not in plan and "BroadcastHashJoin" in plan
