"""Plan-shape checks: the physical plans keep the properties the design
relies on at scale (see README, "Scale design")."""

import re

from pyspark.sql import functions as F

from revsift.operators import chunking as ch
from revsift.operators import prepare as pp
from revsift.operators import retrieval as rt
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))


def _docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def _queries(spark):
    return spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").selectExpr("item_id AS q", "text")


def test_bm25_topk_broadcasts_queries_and_limits_per_group(spark):
    p = plan_of(rt.bm25_topk(_queries(spark), _docs(spark), k=50))
    assert "BroadcastHashJoin" in p
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_dense_topk_is_block_scored_with_partial_limit(spark):
    v = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    out = rt.dense_topk(v.selectExpr("vec_id AS q", "embedding"), v.selectExpr("vec_id AS id", "embedding"),
                        k=10, exclude_self=True)
    p = plan_of(out)
    assert "MapInArrow" in p and "WindowGroupLimit" in p
    assert "Broadcast" not in p.replace("BroadcastNestedLoopJoin", "")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_corpus_postings_shuffle_once(spark):
    p = plan_of(rt.corpus_postings(_docs(spark)))
    assert exchanges(p) == 1  # the spread by document; the aggregation reuses it


def test_semantic_chunks_do_not_shuffle_split_input(spark):
    p = plan_of(ch.semantic_chunks(_docs(spark)))
    assert exchanges(p) <= 1  # one coarse file: its documents are spread once
    docs = spark.range(64, numPartitions=64).selectExpr("id AS doc_id", "concat('Text ', id, '. More of it.') AS text")
    p = plan_of(ch.semantic_chunks(docs))
    assert exchanges(p) == 0 and "Window" not in p and p.count("regexp_extract_all") <= 3


def test_join_m1_check_costs_no_extra_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("k"))
        c = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_name")
        checked = exchanges(plan_of(pp.join_m1(o, c, "k")))
        plain = exchanges(plan_of(o.join(c, "k", "left")))
        assert checked == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_single_partition_window_in_samples_and_splits(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey")
    train, _ = pp.split_by_group(o, "o_custkey")
    p = plan_of(train)
    assert "TakeOrderedAndProject" in plan_of(pp.sample_exact(o, 30, "o_orderkey"))
    # ranks come from one materialised ranged copy: its bounds are sampled
    # once; the only single-partition step is over per-partition counts
    assert "rangepartitioning" not in p and "Scan ExistingRDD" in p


def test_reference_blocks_deal_no_texts(spark):
    """The texts meet the line items by broadcast, after the last shuffle by order."""
    from revsift.plans.queries_more import q_reference_block
    p = plan_of(q_reference_block(spark, SF_SMALL))
    assert exchanges(p) == 1 and "hashpartitioning(l_orderkey" in p
    assert p.count("ObjectHashAggregate") == 2  # partial and final of one grouping, no shuffle between


def test_postings_of_asked_terms_keep_the_statistics(spark):
    """Only the rows of a batch's terms are made; N, avgdl and df stay, and no
    posting is shuffled after the texts were dealt by document."""
    docs = _docs(spark)
    every, some = rt.corpus_postings(docs), rt.corpus_postings(docs, terms=rt.asked_terms(_queries(spark).limit(3)))
    assert exchanges(plan_of(some)) <= 3 and "REPARTITION_BY_NUM" in plan_of(some)  # texts once, the few terms twice
    assert rt.bm25_corpus_stats(some).first() == rt.bm25_corpus_stats(every).first()
    assert some.count() < every.count()
    terms = [r["term"] for r in rt.asked_terms(_queries(spark).limit(3)).collect()]
    asked = F.col("term").isin(terms)
    a, b = (p.filter(asked).groupBy("term").agg(F.count(F.lit(1)), F.sum("tf")).collect() for p in (some, every))
    assert sorted(a) == sorted(b) and a
