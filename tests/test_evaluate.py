import math

import pytest

from revsift.operators import evaluate as ev
from tests.conftest import rows


def test_retrieval_metrics_edge_cases(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "q long")
    ranked = spark.createDataFrame(
        [(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 11),  # duplicate id in the list
         (2, 1, 20), (3, 1, 30)], "q long, rank int, doc long")
    qrels = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 21), (4, 40)], "q long, doc long")
    got = {r.q: r for r in ev.retrieval_metrics(queries, ranked, qrels, k=10).collect()}
    r1 = got[1]
    assert r1.hit_rate == 1.0 and r1.mrr == 0.5
    assert r1.precision == round(2 / 3, 6) and r1.recall == round(2 / 3, 6)
    assert r1.ap == round((1 / 2 + 2 / 3) / 3, 6)
    idcg = sum(1 / math.log2(i + 1) for i in range(1, 4))
    assert r1.ndcg == round((1 / math.log2(3) + 1 / math.log2(4)) / idcg, 6)
    assert got[2].hit_rate == 0.0 and got[2].mrr == 0.0 and got[2].ndcg == 0.0  # no hits
    assert got[3].hit_rate is None  # no relevant documents -> NULL metrics
    assert got[4].precision == 0.0 and got[4].recall == 0.0  # nothing retrieved
    for r in got.values():
        for m in ev.METRICS:
            v = getattr(r, m)
            assert v is None or 0.0 <= v <= 1.0
        assert (r.hit_rate == 1.0) == (r.mrr is not None and r.mrr > 0)


def test_summary_skips_queries_without_relevant_docs(spark):
    per_q = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, None, None, None, None, None, None),
                                   (3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                                  "q long, hit_rate double, mrr double, precision double, recall double, "
                                  "ap double, ndcg double")
    out = dict(rows(ev.summarise_metrics(per_q, "top_5_retrieval_eval")))
    assert out["top_5_retrieval_eval_hit_rate"] == 0.5
    assert out["top_5_retrieval_eval_n_queries"] == 3.0
    assert out["top_5_retrieval_eval_n_queries_without_relevant"] == 1.0


def test_passage_qrels_short_and_anchored_passages(spark):
    q = spark.createDataFrame([("1", "quick brown"), ("2", "absent"), ("3", ""), ("4", "brown"), ("5", "he quick brown fox jumps o"),
                               ("6", "quick brown fox jumps over the lazy dog"), ("7", "a  b\tc d\ne")], "item_id string, text string")
    d = spark.createDataFrame([("10", "the quick brown fox"), ("11", "brown bear"), ("12", None), ("13", "see the quick brown fox jumps over the lazy dogs"),
                               ("14", "quick brown cat jumps over the lazy dog"), ("15", "xa  b\tc d\nef"), ("16", "xa b c d ef")], "doc_id string, text string")
    want = sorted((x.item_id, y.doc_id) for x in q.collect() for y in d.collect() if x.text and y.text and x.text in y.text)
    assert ("5", "13") in want and ("7", "15") in want
    assert rows(ev.passage_qrels(q, d), "q", "doc") == want
    assert rows(ev.passage_qrels(q, d, max_broadcast_rows=1), "q", "doc") == want
    p = ev.passage_qrels(q.filter("item_id in (5, 6)"), d)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Python" not in p and "Pandas" not in p


def test_passage_qrels_repeated_ids_and_rows(spark):
    """An id with several texts has a pair if one of them holds the passage,
    once, whichever path finds it."""
    q = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, "two"), (None, "one two three four"),
                               (3, "zzz unheard of words"), (1, "ten eleven twelve")], "item_id int, text string")
    d = spark.createDataFrame([(1, "zero one two three four five six seven"), (1, "so: one two three four five six"), (1, "nothing"),
                               (2, "nine ten eleven twelve"), (None, "one two three four five six")], "doc_id long, text string")
    want = [(1, 1), (1, 2), (2, 1)]
    assert rows(ev.passage_qrels(q, d), "q", "doc") == want
    assert rows(ev.passage_qrels(q, d, max_broadcast_rows=1), "q", "doc") == want


def test_passage_qrels_moves_no_texts(spark):
    """Texts are shuffled by nothing but the spread of small inputs."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    d = spark.createDataFrame(base.collect(), base.schema).repartition(16)
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    p = ev.passage_qrels(q, d)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in p and "NestedLoop" not in p
    assert "Exchange hashpartitioning(_t" not in p and p.count("Exchange hashpartitioning(doc") <= 1  # that of the few (q, doc)


def test_retrieval_errors_with_texts(spark):
    per_q = spark.createDataFrame([(1, 0.0, 0.5, 0.1), (2, 1.0, 1.0, 1.0), (3, 0.0, 0.25, 0.1), (4, None, None, None)],
                                  "q long, hit_rate double, mrr double, ap double")
    ranked = spark.createDataFrame([(1, r, f"n{r}") for r in range(1, 6)] + [(2, 1, "n1"), (3, 1, "gone")], "q long, rank int, doc string")
    qrels = spark.createDataFrame([(1, "n9"), (1, "n8"), (1, "n8"), (1, "n7"), (3, "gone"), (2, "n1")], "q long, doc string")
    nodes = spark.createDataFrame([(f"n{i}", f"text {i}") for i in range(1, 10)], "node_id string, text string")
    got = ev.retrieval_errors(per_q, ranked, n_show=2, nodes=nodes, qrels=qrels).collect()
    assert [r["q"] for r in got] == [3, 1]
    assert got[1]["retrieved"] == "n1,n2" and got[1]["retrieved_texts"] == ["text 1", "text 2"]
    assert got[1]["expected"] == ["text 7", "text 8"] and got[1]["n_expected"] == 3
    assert (got[0]["retrieved"], got[0]["retrieved_texts"], got[0]["expected"], got[0]["n_expected"]) == ("gone", None, None, 1)


def test_answer_errors_and_score_table(spark):
    scores = spark.createDataFrame([(1, "relevancy", 0.5), (1, "correctness", 1.0), (2, "relevancy", 1.0), (3, "relevancy", 0.0)],
                                   "example_id long, metric string, score double")
    preds = spark.createDataFrame([(1, "why?", "because", ["a", "b"]), (2, "who?", "me", []), (3, "what?", None, None)],
                                  "example_id long, query string, answer string, contexts array<string>")
    table = ev.score_table(scores, ["relevancy", "correctness"], predictions=preds)
    assert table.columns == ["example_id", "query", "answer", "relevancy", "correctness", "contexts"]
    ex = spark.createDataFrame([(1, "why?", "old", ["x"]), (2, "why?", "new", ["y", "z"]), (3, "why?", None, ["n"])],
                               "example_id long, query string, expected string, reference_contexts array<string>")
    got = ev.answer_errors(table, ex, "relevancy").collect()
    assert [(r["example_id"], r["answer"], r["contexts"], r["expected"], r["expected_contexts"], r["missing"]) for r in got] == [
        (3, None, None, None, None, True), (1, "because", "a\n\nb", "new", "y\n\nz", False)]


def test_count_params(spark, tmp_path):
    from revsift.operators.runlog import count_params
    df = spark.range(7)
    got = count_params({"nodes": df, "none": df.limit(0)}, str(tmp_path / "out"))
    assert rows(got) == [("n_nodes", 7.0), ("n_none", 0.0)]
    assert spark.read.parquet(str(tmp_path / "out" / "nodes")).count() == 7 and count_params({}, str(tmp_path)).count() == 0


def test_make_pairs(spark):
    nodes = spark.createDataFrame([("n1", "text one"), ("n2", "text two"), ("n3", "unasked")], "node_id string, text string")
    qs = spark.createDataFrame([(1, "what?", "n1"), (2, "who?", "n2"), (3, "", "n2"), (4, "lost?", "n9"), (1, "what?", "n2")],
                               "q long, question string, node_id string")
    queries, corpus, relevant = ev.make_pairs(nodes, qs)
    assert rows(queries) == [(1, "what?"), (2, "who?")] and rows(corpus) == [("n1", "text one"), ("n2", "text two")]
    assert rows(relevant) == [(1, "n1"), (1, "n2"), (2, "n2")]


def test_ir_report_by_label(spark):
    items = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "vec_id long, label int")
    ranked = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (3, 1, 1), (3, 2, 4)], "q long, rank int, id long")
    hit, n_rel = ev.label_relevance(ranked, items)
    rep = {(r.cutoff, r.metric): r.value
           for r in ev.ir_report(items.selectExpr("vec_id as q"), ranked, hit, n_rel, cutoffs=(1, 3)).collect()}
    # queries 2 and 4 retrieved nothing but have one relevant item each
    assert rep[(1, "accuracy")] == 0.25
    assert rep[(3, "accuracy")] == 0.5 and rep[(3, "mrr")] == round((1 + 0.5) / 4, 6)


def test_attach_expected_last_wins_and_missing(spark):
    errors = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, None)], "doc_id long, query string")
    ex = spark.createDataFrame([(1, "q1", "old"), (2, "q1", "new"), (3, "q9", "x")],
                               "example_id long, query string, expected string")
    out = rows(ev.attach_expected(errors, ex), "doc_id", "expected", "missing")
    assert out == [(1, "new", False), (2, None, True), (3, None, True)]


def test_fetch_nodes_reports_missing(spark):
    lists = spark.createDataFrame([(1, [5, 3, 9])], "q long, ids array<long>")
    nodes = spark.createDataFrame([(3, "c"), (5, "e")], "doc_id long, text string")
    found, missing = ev.fetch_nodes(lists, nodes)
    assert rows(found, "pos", "text") == [(0, "e"), (1, "c")]
    assert rows(missing, "pos", "_nid") == [(2, 9)]


def test_score_table_and_compare(spark):
    long_ = spark.createDataFrame([(1, "relevancy", 1.0), (1, "correctness", 0.0), (2, "relevancy", None)],
                                  "example_id long, metric string, score double")
    assert rows(ev.summarise_scores(long_)) == [("correctness", 0.0), ("relevancy", 1.0)]
    wide = ev.score_table(long_, ["relevancy", "correctness"])
    assert wide.columns == ["example_id", "relevancy", "correctness"]
    rep = spark.createDataFrame([(1, "mrr", 0.5)], "cutoff int, metric string, value double")
    cmp_ = ev.compare_reports({"a": rep, "b": rep})
    assert rows(cmp_) == [("mrr@1", 0.5, 0.5)]


@pytest.mark.parametrize("n,expected", [(0, 0.0), (1, 1.0), (2, 1.0 + 1 / math.log2(3))])
def test_ideal_dcg(spark, n, expected):
    from pyspark.sql import functions as F
    v = spark.range(1).select(ev.ideal_dcg(F.lit(n)).alias("v")).first().v
    assert abs(v - expected) < 1e-12


def test_examples_from_pairs_and_pair_similarity(spark):
    pairs = spark.createDataFrame([(1, "best ramen in town?", "Try the noodle bar."),
                                   (2, "vegan brunch", "The garden cafe.")], "id long, query string, reference_answer string")
    ex = ev.examples_from_pairs(pairs, id_col="id").collect()
    assert [(r.example_id, r.reference_contexts, r.query_by) for r in ex] == [(1, [], "human"), (2, [], "human")]
    t = spark.createDataFrame([(1, "cat mat", "cat mat"), (2, "cat", "stock market"), (3, "", "x")],
                              "k long, a string, b string")
    got = dict(rows(ev.pair_similarity(t, "a", "b", "k")))
    assert got[1] == 1.0 and got[3] == 0.0 and -1.0 <= got[2] <= 1.0


def test_plugin_embedder_and_scorer(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from revsift.operators import retrieval as rt
    from revsift.operators.embed import embed

    @F.pandas_udf("array<double>")
    def length_embedder(s: pd.Series) -> pd.Series:  # stands in for a model
        return s.map(lambda t: [float(len(t)), 1.0])

    @F.pandas_udf("double")
    def shorter_is_better(q: pd.Series, d: pd.Series) -> pd.Series:
        return -d.str.len().astype(float)

    docs = spark.createDataFrame([(1, "aaaa"), (2, "bb")], "doc_id long, text string")
    out = embed(docs, "text", embedder=length_embedder)
    assert rows(out, "doc_id", "embedding") == [(1, [4.0, 1.0]), (2, [2.0, 1.0])]
    sim = dict(rows(ev.pair_similarity(docs.withColumn("t2", F.col("text")), "text", "t2", "doc_id",
                                       embedder=length_embedder)))
    assert sim == {1: 1.0, 2: 1.0}
    cands = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "q long, doc long, rank int")
    qs = spark.createDataFrame([(7, "query")], "q long, text string")
    top = rt.rerank(cands, qs, docs, k=1, scorer=shorter_is_better).first()
    assert top.doc == 2
