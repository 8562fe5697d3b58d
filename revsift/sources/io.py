"""Sources and sinks.

Schemas are declared, never inferred from JSON. Nothing here collects data to
the driver; the only driver-side values are row counts and path checks.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")
STORED = "zstd"   # codec of tables that are kept: indexes are a multiple of their texts


# S2 ---------------------------------------------------------------------------
def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet table ``base_dir/name.parquet`` (column pruning and row-group
    skipping come from the scan)."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


# S1 ---------------------------------------------------------------------------
def read_jsonl(spark: SparkSession, path: str, schema: T.StructType,
               first_n: int | None = None, order_by: list | None = None) -> DataFrame:
    """JSON lines with a declared schema. ``first_n`` keeps the first rows by
    ``order_by`` (file order is not a Spark guarantee, so a key is required)."""
    df = spark.read.schema(schema).json(path)
    if first_n is not None:
        if not order_by:
            raise ValueError("first_n needs order_by: Spark does not keep file order")
        df = df.orderBy(*order_by).limit(first_n)
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# S3 ---------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: list | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# S4 ---------------------------------------------------------------------------
def read_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Per-item judgements as JSON lines or CSV with header."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported report format: {fmt}")


# S5 ---------------------------------------------------------------------------
QA_SCHEMA = T.StructType([
    T.StructField("queries", T.MapType(T.StringType(), T.StringType())),
    T.StructField("corpus", T.MapType(T.StringType(), T.StringType())),
    T.StructField("relevant_docs", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

# One QA record per line: the scalable layout we write. Each line carries a
# slice of the three maps, so no single row has to hold the whole dataset.
QA_LINE_SCHEMA = QA_SCHEMA


def qa_rows(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """Pack (query_id, text), (doc_id, text), (query_id, doc_id) into QA
    records, one map entry per record: a query, a corpus text, or one
    relevant pair. No record gathers a query's whole relevant list, so a
    passage relevant to a third of the corpus still spreads over tasks."""
    none_s = F.lit(None).cast("map<string,string>")
    none_a = F.lit(None).cast("map<string,array<string>>")
    q = queries.select(F.create_map(F.col("query_id").cast("string"), F.col("text")).alias("queries"),
                       none_s.alias("corpus"), none_a.alias("relevant_docs"))
    c = corpus.select(none_s.alias("queries"),
                      F.create_map(F.col("doc_id").cast("string"), F.col("text")).alias("corpus"),
                      none_a.alias("relevant_docs"))
    r = qrels.select(none_s.alias("queries"), none_s.alias("corpus"),
                     F.create_map(F.col("query_id").cast("string"),
                                  F.array(F.col("doc_id").cast("string"))).alias("relevant_docs"))
    return q.unionByName(c).unionByName(r)


def explode_qa(qa: DataFrame):
    """QA records (three maps per row) -> (queries, corpus, qrels) DataFrames."""
    queries = qa.select(F.explode("queries").alias("query_id", "text"))
    corpus = qa.select(F.explode("corpus").alias("doc_id", "text"))
    qrels = (qa.select(F.explode("relevant_docs").alias("query_id", "ids"))
               .select("query_id", F.explode("ids").alias("doc_id")))
    return queries, corpus, qrels


def save_qa(qa: DataFrame, path: str) -> None:
    qa.write.mode("overwrite").json(path)


def load_qa(spark: SparkSession, path: str, multiline: bool = False):
    """Read QA records. ``multiline=True`` reads the single-object layout
    (one JSON document holding the three maps)."""
    qa = spark.read.schema(QA_SCHEMA).option("multiLine", multiline).json(path)
    return explode_qa(qa)


# S6 ---------------------------------------------------------------------------
EXAMPLE_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("reference_answer", T.StringType()),
    T.StructField("reference_contexts", T.ArrayType(T.StringType())),
    T.StructField("query_by", T.StringType()),
])


def save_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE_SCHEMA).json(path)


# S7 ---------------------------------------------------------------------------
NODE_SCHEMA = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def save_nodes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODE_SCHEMA).parquet(path)


# S8 ---------------------------------------------------------------------------
@dataclass
class VectorTable:
    """A vector collection on Parquet: fixed dimension, cosine metric, unit
    vectors (made on write; a null stays null, a zero vector becomes null).

    Every write makes a new folder under ``data`` and then adds one row to the
    ``manifest`` table: version, dimension, metric, count, folders. A reader
    takes the latest row, so it sees a whole version or the one before, and a
    table that is being read is never written over. ``vacuum`` deletes the
    folders that the latest version does not name."""

    path: str
    dim: int
    vector_col: str = "embedding"

    def write(self, df: DataFrame, recreate: bool = True) -> int:
        """Write a version (``recreate`` false: the latest one and these rows)
        and return its number. A vector of another dimension ends the job."""
        spark = df.sparkSession
        v, norm = F.col(self.vector_col), F.col("_norm")
        # a column of its own: inside the function of an element it would be reckoned for every element
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        unit = F.when(v.isNull() | (F.size(v) == self.dim), F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x / norm))) \
                .otherwise(F.raise_error(F.concat(F.lit(f"vector dimension is not {self.dim}: "), F.size(v).cast("string"))))
        count = Observation()
        checked = df.withColumn("_norm", length).withColumn(self.vector_col, unit.cast(df.schema[self.vector_col].dataType)).drop("_norm")
        checked = checked.observe(count, F.count(F.lit(1)).alias("n"))
        folder = f"{self.path.rstrip('/')}/data/{uuid.uuid4().hex}"
        checked.write.option("compression", STORED).parquet(folder)
        last = self.manifest(spark)
        kept = [] if recreate or last is None else list(last["folders"])
        version = 1 if last is None else last["version"] + 1
        row = (version, self.dim, "cosine", count.get["n"] + (last["count"] if kept else 0), [*kept, folder])
        spark.createDataFrame([row], "version long, dim int, metric string, count long, folders array<string>").coalesce(1) \
             .write.mode("append").parquet(f"{self.path.rstrip('/')}/manifest")
        return version

    def manifest(self, spark: SparkSession):
        """The latest version's row, or None."""
        rows = f"{self.path.rstrip('/')}/manifest"
        return spark.read.parquet(rows).orderBy(F.desc("version")).first() if _path_has_data(spark, rows) else None

    def exists(self, spark: SparkSession) -> bool:
        """Whether a version with rows is there."""
        last = self.manifest(spark)
        return last is not None and last["count"] > 0

    def read(self, spark: SparkSession) -> DataFrame:
        last = self.manifest(spark)
        if last is None:
            raise FileNotFoundError(f"no vector table at {self.path}")
        if last["dim"] != self.dim:
            raise ValueError(f"the table at {self.path} has dimension {last['dim']}, not {self.dim}")
        return spark.read.parquet(*last["folders"])

    def count(self, spark: SparkSession) -> int:
        """The number of rows, from the manifest."""
        last = self.manifest(spark)
        return 0 if last is None else last["count"]

    def vacuum(self, spark: SparkSession) -> list[str]:
        """Delete the data folders of earlier versions; returns them. Readers
        of those versions must have ended."""
        last = self.manifest(spark)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/data")
        fs = root.getFileSystem(conf)
        keep = {f.rstrip("/").rsplit("/", 1)[-1] for f in (last["folders"] if last else [])}
        old = [f.getPath() for f in (fs.listStatus(root) if last and fs.exists(root) else []) if f.getPath().getName() not in keep]
        for folder in old:
            fs.delete(folder, True)
        return [f.toString() for f in old]


def vector_stats(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """n, dim, min/max L2 norm of a vector table (one aggregation pass)."""
    sq = F.aggregate(F.col(vector_col), F.lit(0.0).cast("double"),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.sqrt(sq)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.max(F.size(vector_col)).cast("int").alias("dim"),
                  F.round(F.min(norm), 6).alias("min_norm"),
                  F.round(F.max(norm), 6).alias("max_norm"))


# S9 ---------------------------------------------------------------------------
def _path_has_data(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a Parquet table with at least one row. Only a
    missing path or a folder without data files counts as absent; any other
    error (permissions, network, damaged files) is raised."""
    from pyspark.errors import AnalysisException
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return not df.isEmpty()


def build_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  recreate: bool = False, **options) -> DataFrame:
    """Reuse the table at ``path`` when it holds data and ``recreate`` is
    false; otherwise build it, write it (with the writer's ``options``), and
    read the written copy back (the written table also cuts the lineage)."""
    if not recreate and _path_has_data(spark, path):
        return spark.read.parquet(path)
    built = build()
    built.write.mode("overwrite").options(**{"compression": STORED} | options).parquet(path)
    return spark.read.schema(built.schema).parquet(path)  # an empty table may have no file


def recreate_flags(recreate_index: bool, recreate_retrieval_eval: bool,
                   recreate_response_eval: bool) -> dict:
    """Recreating the index forces both evaluation sets to be rebuilt."""
    return {
        "recreate_index": recreate_index,
        "recreate_retrieval_eval": recreate_retrieval_eval or recreate_index,
        "recreate_response_eval": recreate_response_eval or recreate_index,
    }


# S10 --------------------------------------------------------------------------
def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (line_no, line). ``line_no`` orders lines over the file
    set: by modification time, path, where the split starts, and the place
    inside the split (rows of a split are numbered as they are read). Splits
    are packed into partitions by size, so a row number alone is no order.
    Each line gets back the line end that the source strips: a tagged value
    may be the last thing on its line."""
    df = spark.read.text(path)
    order = F.struct(F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"))
    return df.select(order.alias("line_no"), F.concat(F.col("value"), F.lit("\n")).alias("line"))
