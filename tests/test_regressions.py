"""One test for each fault found in review."""

import os

import pytest
from pyspark.sql import functions as F

from tests.porter_plain import porter
from revsift.functions.text import to_number
from revsift.operators import evaluate as ev
from revsift.operators import prepare as pp
from revsift.operators import retrieval as rt
from revsift.operators.distributed import global_rank, spread
from revsift.operators.profile import profile
from revsift.operators.runlog import assemble_spans, parse_collect
from revsift.sources.io import build_or_load, read_lines
from tests.conftest import rows


def test_global_rank_beyond_sampling_size_with_payload(spark):
    n = 3_000_000
    df = spark.range(0, n, 1, 16).select(F.xxhash64("id").alias("k"), "id", F.concat(F.lit("p"), F.col("id")).alias("payload"))
    r = global_rank(df, ["k", "id"], num_partitions=16).select("_rank", "payload")
    s = r.agg(F.countDistinct("_rank").alias("d"), F.max("_rank").alias("m"), F.max("payload").alias("p")).first()
    assert (s["d"], s["m"]) == (n, n)


def test_join_m1_sees_duplicates_whatever_is_read(spark):
    left = spark.createDataFrame([(1, "x")], "k int, v string")
    dup = spark.createDataFrame([(7, "A", 1), (7, "B", 2)], "k int, a string, b int")
    for right in (dup, dup.select("k")):
        for use in (lambda j: j.select("k", *(["b"] if "b" in j.columns else [])).collect(), lambda j: j.count()):
            with pytest.raises(Exception, match="duplicate key"):
                use(pp.join_m1(left, right, "k"))


def test_log_lines_keep_their_order_and_their_last_value(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "a.log").write_text("noise\n[COLLECT] k=1\n")
    os.utime(d / "a.log", (1_000_000, 1_000_000))
    (d / "b.log").write_text("x" * 300_000 + "\n[COLLECT] k=2\n[COLLECT] end=5\n")
    os.utime(d / "b.log", (2_000_000, 2_000_000))
    assert rows(parse_collect(read_lines(spark, str(d)))) == [("end", 5.0), ("k", 2.0)]
    os.utime(d / "a.log", (3_000_000, 3_000_000))
    assert rows(parse_collect(read_lines(spark, str(d)))) == [("end", 5.0), ("k", 1.0)]


def test_pruned_search_keeps_stems_and_large_batches(spark):
    docs = spark.createDataFrame([(1, "running dogs bark"), (2, "a dog runs"), (3, "cats sleep")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "run dog"), (2, "cat")], "q long, text string")
    want = rows(rt.bm25_topk(qs, docs, k=5, stem=True))
    assert want and rows(rt.bm25_topk(qs, docs, k=5, stem=True, prune=True)) == want
    plain = rows(rt.bm25_topk(qs, docs, k=5))
    assert rows(rt.bm25_topk(qs, docs, k=5, prune=True, max_broadcast_rows=1)) == plain


def test_filter_spec_top_k(spark):
    df = spark.createDataFrame([(3, 1), (1, 2), (2, 3)], "n int, m int")
    schema = [pp.MetadataField("n", "int")]
    spec = {"filters": [{"key": "n", "operator": "GTE", "value": 1}], "top_k": 1}
    assert rows(pp.apply_filter_spec(df, spec, schema)) == [(1, 2)]
    assert rows(pp.apply_filter_spec(df, {**spec, "top_k": 2}, schema, [F.col("m").desc()])) == [(1, 2), (2, 3)]
    with pytest.raises(pp.FilterSpecError):
        pp.apply_filter_spec(df, {**spec, "top_k": 0}, schema)
    vecs = spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(6)], "id long, embedding array<float>, n int")
    got = rt.self_query_topk(vecs.filter("id = 0").withColumnRenamed("id", "q"), vecs, {"filters": [{"key": "n", "operator": "GT", "value": 2}], "top_k": 2}, schema)
    assert got.count() == 2


def test_repeated_id_counts_at_its_best_rank(spark):
    q = spark.createDataFrame([(1,)], "q long")
    ranked = spark.createDataFrame([(1, 3, 9), (1, 1, 9), (1, 2, 8)], "q long, rank int, doc long").repartition(3)
    rel = spark.createDataFrame([(1, 9)], "q long, doc long")
    assert ev.retrieval_metrics(q, ranked, rel, 5).first()["mrr"] == 1.0


def test_numbers_are_decimal_only(spark):
    texts = ["1d", "2.5D", "1f", "0x1p3", "1e3", " -2.5 ", ".5", "5.", "inf", "", "1 2", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(to_number("t")).collect()] == [
        None, None, None, None, 1000.0, -2.5, 0.5, 5.0, float("inf"), None, None, None]


def test_stemmer_takes_any_run_of_letters():
    assert porter("y" * 5000 + "ing")
    assert [porter(w) for w in ("happy", "sky", "syzygy", "toying", "dying")] == ["happi", "sky", "syzygi", "toi", "dy"]


def test_build_or_load_rebuilds_empty_and_raises_on_errors(spark, tmp_path):
    p = str(tmp_path / "t")
    one = spark.createDataFrame([(1,)], "a int")
    assert build_or_load(spark, p, lambda: one.limit(0)).count() == 0
    assert build_or_load(spark, p, lambda: one).count() == 1  # an empty table is not built yet
    assert build_or_load(spark, p, lambda: 1 / 0).count() == 1
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"this is not parquet")
    with pytest.raises(Exception):
        build_or_load(spark, str(bad), lambda: one)
    assert (bad / "part-0.parquet").exists()


def test_category_separator_is_literal(spark):
    df = spark.createDataFrame([("a|b",), ("a",)], "c string")
    assert [(r["category"], r["n"]) for r in pp.category_share(df, "c", "|").collect()] == [("a", 2), ("b", 1)]


def test_profile_covers_every_type(spark):
    df = spark.sql("""SELECT * FROM VALUES (true, DATE'2024-01-01', TIMESTAMP'2024-01-01 10:00:00', 1.50BD, array(1), X'01'),
        (true, DATE'2024-01-02', NULL, 2.50BD, array(1), X'01') AS t(b, d, ts, m, a, x)""")
    got = {r["column"]: r for r in profile(df).collect()}
    assert set(got) == {"b", "d", "ts", "m", "a", "x"}
    assert (got["b"]["top"], got["b"]["freq"], got["ts"]["count"], got["d"]["unique"]) == ("true", 2, 1, 2)
    assert (got["m"]["mean"], got["a"]["top"], got["x"]["top"]) == (2.0, "[1]", "01")


def test_spread_runs_no_job(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread-probe", "spread")
    try:
        spread(df, ["k"])
        assert not tracker.getJobIdsForGroup("spread-probe")
    finally:
        spark.sparkContext.setJobGroup("default", "default")


def test_step_takes_its_earliest_start(spark):
    e = spark.createDataFrame([("s", "query", "start", None, 5), ("s", "retrieve", "start", "p", 2), ("s", "query", "end", None, 9)],
                              "event_id string, event_type string, phase string, parent_id string, ts int").repartition(3)
    r = assemble_spans(e).first()
    assert (r["event_type"], r["start_ts"], r["end_ts"]) == ("retrieve", 2, 9)
