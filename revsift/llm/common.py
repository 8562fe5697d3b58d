"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

# Upper bounds of one Arrow batch handed to a Python worker: rows and bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (the folder that every
    executor shares) for one run of an operator."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet into the shared folder and
    read it back, so later branches read a finished table and a lost
    executor costs one re-read. The schema is kept."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage of a small, narrow frame with a reliable checkpoint; Spark
    removes the files once nothing refers to them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch may hold, in rows and bytes, so a run of
    very long texts cannot fill a worker. Changes speed only, no results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: StructType | str, rows: int = BATCH_ROWS) -> DataFrame:
    bound_batches(df.sparkSession, rows)
    return df.mapInArrow(fn, schema)


def id_text(docs: DataFrame, id_col: str, text_col: str, id_type: str | None = None) -> DataFrame:
    """``(doc_id, text)``: only the two needed columns, under fixed names, a
    null text as the empty text. Other columns, whatever their names, go."""
    key = docs[id_col] if id_type is None else docs[id_col].cast(id_type)
    return docs.select(key.alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
