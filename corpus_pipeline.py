"""A training-data pipeline over ``documents``: reject bad texts, keep one of
each near-duplicate group, mix the sources to target weights, encode.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a frame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.llm.common import run_folder, table
from revsift.llm.minhash import near_duplicates
from revsift.llm.mixing import mixed_documents
from revsift.llm.pieces import encode_documents
from revsift.llm.quality import keep_good
from revsift.llm.queries import piece_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps."""
    return keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by shingles of five words: the row of the smallest id
    of each group stays; rows without an id or without words all stay. Of
    rows that share an id, one stays (the smallest by its columns)."""
    count = "rows"
    while count in {c.lower() for c in docs.columns}:  # a name that the documents do not have
        count += "_"
    kept = near_duplicates(docs, size=5).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(count))
    one = docs.filter("doc_id is not null").join(kept, "doc_id").select(*docs.columns, count)
    single = one.filter(F.col(count) == 1).select(*docs.columns)
    # ids that occur on several rows; these are settled by a small aggregation of their own
    several = one.filter(F.col(count) > 1).groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionAll(several).unionAll(docs.filter("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it."""
    return mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the decoded text of every row."""
    return encode_documents(docs, piece_model(), with_texts=False)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("source_mix", mix_stage),
    ("sentencepiece", encode_stage),
]

# The classifier and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared
    folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), run_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
