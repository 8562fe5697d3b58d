"""Registered queries of the sources and sinks: each writes a table into the
shared folder in its format, reads it back, and returns what was read. With
their DuckDB twins, which say what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import runlog as rl
from ..session import shared_dir
from ..sources import io as sio
from .queries import _t
from .queries_more import chunk_index, q_examples_from_pairs


def _folder(spark, name: str) -> str:
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


DOC_LINES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def q_jsonl_lines(spark, d):
    """Documents as JSON lines, read with a declared schema."""
    path = _folder(spark, "jsonl")
    sio.write_jsonl(_t(spark, d, "documents").select("doc_id", "text", "lang"), path)
    back = sio.read_jsonl(spark, path, DOC_LINES)
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def q_partitioned_table(spark, d):
    """S3: orders by status folder; the folder's column comes back from the
    path, and a filter on it reads one folder."""
    path = _folder(spark, "table")
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sio.write_table(orders.repartition("o_orderstatus"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


REPORT = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
                       T.StructField("p_retailprice", T.DoubleType())])


def q_report_csv(spark, d):
    """A report as CSV with a header, read with its types."""
    path = _folder(spark, "report")
    sio.write_report(_t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path, "csv")
    return sio.read_report(spark, path, REPORT)


def q_report_json(spark, d):
    """Per-item judgements as JSON lines."""
    path = _folder(spark, "report")
    sio.write_report(_t(spark, d, "labels").select("doc_id", "quality", "toxic"), path)
    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "quality", "toxic")]
    return sio.read_jsonl(spark, path, T.StructType(fields))


def q_examples_file(spark, d):
    """Curated examples saved and loaded."""
    path = _folder(spark, "examples")
    ex = q_examples_from_pairs(spark, d)
    sio.save_examples(ex.select("example_id", "query", "reference_answer", F.array(F.lit("a"), "query_by").alias("reference_contexts"), "query_by"), path)
    return sio.load_examples(spark, path).select("example_id", "query", F.md5("reference_answer").alias("answer_md5"),
                                                 F.array_join("reference_contexts", ",").alias("contexts"))


def q_node_store(spark, d):
    """The chunk nodes with their metadata and vectors, saved and loaded."""
    path = _folder(spark, "nodes")
    sio.save_nodes(chunk_index(spark, d).nodes, path)
    n = sio.load_nodes(spark, path)
    return n.select("node_id", "doc_id", "chunk_no", F.md5("text").alias("text_md5"), F.size("embedding").alias("dim"))


def q_vector_store(spark, d):
    """Two versions of a vector table; the second adds the long
    vectors of half the rows, which come back as unit vectors, and the
    manifest has the count."""
    t = sio.VectorTable(_folder(spark, "vectors"), 64)
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    t.write(v.filter("vec_id % 2 = 0"))
    t.write(v.filter("vec_id % 2 = 1").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(7).cast("float"))), recreate=False)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return t.read(spark).select("vec_id", F.round(norm, 5).alias("norm"), F.lit(t.count(spark)).cast("bigint").alias("n"))


def q_build_or_load(spark, d):
    """Built once; a second builder is not run; ``recreate`` runs it."""
    path, labels = _folder(spark, "built"), _t(spark, d, "labels").select("doc_id")
    steps = [("first", labels.filter("quality = 1"), False), ("again", labels, False), ("anew", labels, True)]
    out = None
    for name, df, recreate in steps:
        # each step is counted before the next one may write the folder anew
        got = sio.build_or_load(spark, path, lambda df=df: df, recreate).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).first()
        row = spark.createDataFrame([(name, got["n"], got["ids"])], "step string, n long, ids long")
        out = row if out is None else out.unionAll(row)
    return out


SPAN_TYPES = ("retrieve", "query", "function_call", "embedding", "chunking")


def q_trace_spans(spark, d):
    """L1: the events as a trace: two rows a span, of five types; every
    seventh span has no start, and each hangs on the one before."""
    e = _t(spark, d, "events")
    n = F.floor(F.col("event_id") / 2)
    kind = F.element_at(F.array(*[F.lit(t) for t in SPAN_TYPES]), (n % 5 + 1).cast("int"))
    phase = F.when(F.col("event_id") % 2 == 0, "start").otherwise("end")
    log = e.select(n.cast("string").alias("event_id"), kind.alias("event_type"), phase.alias("phase"), (n - 1).cast("string").alias("parent_id"), "ts")
    log = log.filter(~((F.col("phase") == "start") & (F.col("event_id").cast("long") % 7 == 0)))
    spans = rl.assemble_spans(log)
    return spans.select("event_id", "event_type", "parent_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start_ts", "end_ts")])


QUERIES_IO = {
    "jsonl_lines": q_jsonl_lines,
    "partitioned_table": q_partitioned_table,
    "report_csv": q_report_csv,
    "report_json": q_report_json,
    "examples_file": q_examples_file,
    "node_store": q_node_store,
    "vector_store": q_vector_store,
    "build_or_load": q_build_or_load,
    "trace_spans": q_trace_spans,
}
