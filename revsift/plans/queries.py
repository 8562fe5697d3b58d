"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the whole of the given tables (no id subsets or row caps);
a ``limit`` appears only where it is the feature (top-k reports, samples).
The DuckDB twin of each query is in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import retrieval as rt
from ..sources.io import read_table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def _bench_queries(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


# --- retrieval --------------------------------------------------------------------
def q_bm25_topk(spark, d):
    docs = _t(spark, d, "documents")
    out = rt.bm25_topk(_bench_queries(spark, d), docs, k=rt.SPARSE_TOP_K)
    return out.select(F.col("q").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def q_passage_qrels(spark, d):
    return ev.passage_qrels(_t(spark, d, "benchmark"), _t(spark, d, "documents")).select(
        F.col("q").alias("item_id"), F.col("doc").alias("doc_id"))


def _bm25_per_query(spark, d):
    bench = _t(spark, d, "benchmark")
    docs = _t(spark, d, "documents")
    ranked = rt.bm25_topk(_bench_queries(spark, d), docs, k=rt.SPARSE_TOP_K)
    qrels = ev.passage_qrels(bench, docs)
    return ev.retrieval_metrics(bench.select(F.col("item_id").alias("q")), ranked, qrels,
                                k=rt.SPARSE_TOP_K)


def q_retrieval_metrics(spark, d):
    return _bm25_per_query(spark, d).withColumnRenamed("q", "item_id")


def q_retrieval_summary(spark, d):
    return ev.summarise_metrics(_bm25_per_query(spark, d), f"top_{rt.SPARSE_TOP_K}_retrieval_eval")


QUERIES = {
    "bm25_topk": q_bm25_topk,
    "passage_qrels": q_passage_qrels,
    "retrieval_metrics": q_retrieval_metrics,
    "retrieval_summary": q_retrieval_summary,
}


# ==================================================================================
# Sources, preparation, joins, aggregations
# ==================================================================================
from ..functions import text as tx  # noqa: E402
from ..operators import answers as an  # noqa: E402
from ..operators import hours as hr  # noqa: E402
from ..operators import prepare as pp  # noqa: E402
from ..operators import runlog as rl  # noqa: E402
from ..operators.profile import profile  # noqa: E402
from ..sources import io as sio  # noqa: E402


def q_scan_parquet(spark, d):
    return (_t(spark, d, "documents").groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("total_chars")))


def q_qa_maps_explode(spark, d):
    bench, docs = _t(spark, d, "benchmark"), _t(spark, d, "documents")
    qrels = ev.passage_qrels(bench, docs).select(F.col("q").alias("query_id"), F.col("doc").alias("doc_id"))
    qa = sio.qa_rows(bench.select(F.col("item_id").alias("query_id"), "text"),
                     docs.select("doc_id", "text"), qrels)
    _, _, rel = sio.explode_qa(qa)
    return rel.select(F.col("query_id").cast("bigint").alias("query_id"),
                      F.col("doc_id").cast("bigint").alias("doc_id"))


def q_vector_table_stats(spark, d):
    return sio.vector_stats(_t(spark, d, "embeddings"))


def q_collect_log(spark, d):
    lines = rl.render_collect_lines(_t(spark, d, "events"))
    return rl.parse_collect(lines)


def q_metrics_long(spark, d):
    lab = _t(spark, d, "labels")
    wide = lab.agg(F.count(F.lit(1)).alias("n_labels"), F.avg("quality").alias("quality"),
                   F.avg("toxic").alias("toxic"))
    out = rl.log_metrics(wide, prefix="response_labels_eval__")
    return out.select("name", F.round("value", 6).alias("value"))


def _scores(spark, d):
    """documents left join labels: relevancy = quality, correctness = 1 - toxic."""
    docs = _t(spark, d, "documents").select("doc_id")
    lab = _t(spark, d, "labels")
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", F.col("quality").alias("relevancy"), (F.lit(1) - F.col("toxic")).alias("correctness"))


def q_drop_missing(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    j = docs.join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return pp.drop_missing(j, ["quality"])


MATCH_PATTERNS = ["RING", "gear"]


def q_match_any(spark, d):
    return pp.match_any(_t(spark, d, "part"), "p_name", MATCH_PATTERNS).select("p_partkey", "p_name")


def q_prefix_columns(spark, d):
    c = pp.strip_prefix(_t(spark, d, "customer"), "c_")
    c = pp.prefix_columns(c, "cust_", keep=["custkey"])
    return c.select("custkey", "cust_name", "cust_acctbal")


DOC_VISIBLE = ["l_returnflag", "l_linestatus", "p_brand", "p_type"]


def q_build_documents(spark, d):
    li = _t(spark, d, "lineitem")
    part = _t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    j = pp.join_m1(li, part, "l_partkey")
    docs = pp.build_documents(j, "p_name", drop=["l_shipdate"], visible=DOC_VISIBLE,
                              id_cols=["l_orderkey", "l_linenumber"])
    return docs.select("l_orderkey", "l_linenumber", "embed_text")


def q_error_rows(spark, d):
    return pp.error_rows(_scores(spark, d), "relevancy", "<", 1, ["relevancy", "correctness", "doc_id"])


PART_SCHEMA = [pp.MetadataField("p_size", "int"), pp.MetadataField("p_brand", "str"),
               pp.MetadataField("p_type", "str"), pp.MetadataField("p_retailprice", "float")]
PART_SPEC = {"query": "small economy parts", "filters": [
    {"key": "p_size", "operator": "GTE", "value": 10},
    {"key": "p_size", "operator": "LT", "value": 30},
    {"key": "p_type", "operator": "NE", "value": "SMALL"}], "top_k": None}


def q_filter_spec(spark, d):
    return pp.apply_filter_spec(_t(spark, d, "part"), PART_SPEC, PART_SCHEMA).select(
        "p_partkey", "p_size", "p_brand")


def q_stringify_nulls(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    j = docs.join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return pp.stringify(j, ["quality"]).select("doc_id", F.col("quality").alias("quality_text"))


TEST_MODE_ROWS = 20


def q_first_n(spark, d):
    return pp.first_n(_t(spark, d, "documents").select("doc_id"), TEST_MODE_ROWS, ["doc_id"])


def q_cascade_semi(spark, d):
    part = pp.match_any(_t(spark, d, "part"), "p_name", MATCH_PATTERNS)
    li, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    b, r, u = pp.cascade_sample(part, li, orders, "p_partkey", "l_partkey", "l_orderkey", "o_orderkey")
    def s(df, name, key):
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                      F.sum(key).cast("bigint").alias("key_sum"))
    return s(b, "part", "p_partkey").unionByName(s(r, "lineitem", "l_orderkey")).unionByName(
        s(u, "orders", "o_orderkey"))


def q_join_m1(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("cust_name"),
                                         F.col("c_mktsegment").alias("cust_mktsegment"))
    return pp.join_m1(o, c, "custkey").select("o_orderkey", "cust_name", "cust_mktsegment")


def q_last_by_key(spark, d):
    return pp.last_by_key(_t(spark, d, "part"), "p_name", "p_partkey", "p_partkey")


def q_category_share(spark, d):
    return pp.category_share(_t(spark, d, "part"), "p_name", " ")


def q_profile(spark, d):
    part = profile(_t(spark, d, "part"), "part.")
    ev_ = profile(_t(spark, d, "events"), "events.")
    return part.unionByName(ev_)


def q_distinct_ids(spark, d):
    return _t(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("partkeys"),
                                        F.countDistinct("l_suppkey").alias("suppkeys"))


def q_term_stats(spark, d):
    return rt.term_stats(_t(spark, d, "documents"))


def q_iso_dates(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), hr.iso("o_orderdate").alias("text"))


def q_hour_parts(spark, d):
    e = _t(spark, d, "events").select("event_id", hr.iso("ts").alias("text"))
    t = hr.parse_iso(F.col("text"))
    return e.select("event_id", "text", hr.weekday(t).alias("weekday"), F.hour(t).alias("hour"),
                    hr.hour_label(t).alias("label"))


def q_depunct(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), tx.depunct("url").alias("value"))


def q_to_number(spark, d):
    p = _t(spark, d, "part")
    suffix = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))
    return p.select(F.col("p_partkey").alias("id"), tx.to_number(suffix).alias("value"),
                    tx.is_integer_text(suffix).alias("is_int"), tx.to_number("p_type").alias("type_value"))


def q_flatten_struct(spark, d):
    e = _t(spark, d, "events")
    nested = e.select("event_id", F.struct(
        F.col("event_type"), F.from_json("props", "struct<k:int>").alias("props")).alias("meta"))
    return rl.flatten_struct(nested)


def q_sha_bucket(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", hr.slot_seed(F.col("user_id"), F.col("ts")).alias("seed"))


def q_slot_count(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", hr.slots(F.col("user_id"), F.col("ts")).alias("slots"))


def q_pair_cosine(spark, d):
    e = _t(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    j = a.join(b, F.col("b") == F.col("a") + 1)
    return j.select("a", "b", F.round(rt.cosine(F.col("ea"), F.col("eb")), 6).alias("cos"))


def q_keyword_query(spark, d):
    return _t(spark, d, "benchmark").select("item_id", tx.keyword_text("text").alias("keywords"))


def q_pair_turns(spark, d):
    return an.pair_turns(_t(spark, d, "conversations"))


SAMPLE_SEED = 42
SAMPLE_N = 30


def q_sample_exact(spark, d):
    return pp.sample_exact(_t(spark, d, "documents").select("doc_id"), SAMPLE_N, "doc_id", SAMPLE_SEED)


def q_sample_repl(spark, d):
    return pp.sample_with_replacement(_t(spark, d, "documents").select("doc_id"), SAMPLE_N, "doc_id",
                                      SAMPLE_SEED)


def q_group_split(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return pp.assign_split(o, "o_custkey", 0.7, SAMPLE_SEED).select("o_orderkey", "side")


QUERIES.update({
    "scan_parquet": q_scan_parquet,
    "qa_maps_explode": q_qa_maps_explode,
    "vector_table_stats": q_vector_table_stats,
    "collect_log": q_collect_log,
    "metrics_long": q_metrics_long,
    "drop_missing": q_drop_missing,
    "match_any": q_match_any,
    "prefix_columns": q_prefix_columns,
    "build_documents": q_build_documents,
    "error_rows": q_error_rows,
    "filter_spec": q_filter_spec,
    "stringify_nulls": q_stringify_nulls,
    "first_n": q_first_n,
    "cascade_semi": q_cascade_semi,
    "join_m1": q_join_m1,
    "last_by_key": q_last_by_key,
    "category_share": q_category_share,
    "profile": q_profile,
    "distinct_ids": q_distinct_ids,
    "term_stats": q_term_stats,
    "iso_dates": q_iso_dates,
    "hour_parts": q_hour_parts,
    "depunct": q_depunct,
    "to_number": q_to_number,
    "flatten_struct": q_flatten_struct,
    "sha_bucket": q_sha_bucket,
    "slot_count": q_slot_count,
    "pair_cosine": q_pair_cosine,
    "keyword_query": q_keyword_query,
    "pair_turns": q_pair_turns,
    "sample_exact": q_sample_exact,
    "sample_repl": q_sample_repl,
    "group_split": q_group_split,
})
