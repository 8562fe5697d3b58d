"""Structured Streaming entry points.

The reference processes no data streams; these jobs exist because every
operator here is a DataFrame -> DataFrame function and so runs unchanged on
a streaming source:

* ``availability_stream``: booking requests arriving as files are checked
  against a static opening-hours table (stream-static left join) and the
  verdicts appended to a Parquet sink. Stateless, so exactly-once through
  the file sink and the checkpoint.
* ``collect_log_stream``: tagged ``[COLLECT] key=value`` log lines arriving
  as text files keep the last value per key (a stateful aggregation whose
  state is one row per key), emitted in update mode to ``foreachBatch``.

Checkpoints live under the session's checkpoint folder
(``spark.checkpoint.dir``), never in a machine-local temporary folder.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import hours as hr
from ..operators import runlog as rl
from ..session import shared_dir

REQUEST_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("business_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("pax", T.IntegerType()),
])


def availability_stream(spark: SparkSession, requests_dir: str, hours_rows: DataFrame, output_dir: str,
                        name: str = "availability", schema: T.StructType = REQUEST_SCHEMA,
                        available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the availability job; returns the StreamingQuery."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.parquet(requests_dir)
    checked = hr.check_availability(requests, hours_rows).select("event_id", "business_id", "ts", "pax", "is_open",
                                                                 "ok")
    w = (checked.writeStream.format("parquet").outputMode("append")
         .option("path", output_dir)
         .option("checkpointLocation", shared_dir(spark, f"streams/{name}")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def collect_log_stream(spark: SparkSession, log_dir: str, sink: Callable[[DataFrame, int], None],
                       name: str = "collect_log", available_now: bool = True):
    """Start the log-collection job; ``sink(batch_df, epoch_id)`` receives
    the keys updated in each micro-batch (key, value)."""
    # Each arriving log file is read whole (one row per file; log files are
    # bounded) and split into lines that keep their newline terminator.
    raw = spark.readStream.option("wholetext", True).text(log_dir)
    parts = raw.select(F.col("_metadata.file_modification_time").alias("_mt"),
                       F.col("_metadata.file_path").alias("_fp"), F.split("value", "\n").alias("_l"))
    ex = parts.select("_mt", "_fp", F.size("_l").alias("_n"), F.posexplode("_l").alias("_i", "_line"))
    # Line order across the stream: modification time, file path, line number.
    lines = ex.select(F.struct("_mt", "_fp", "_i").alias("line_no"),
                      F.when(F.col("_i") < F.col("_n") - 1, F.concat(F.col("_line"), F.lit("\n")))
                       .otherwise(F.col("_line")).alias("line"))
    latest = rl.parse_collect(lines)
    w = (latest.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", shared_dir(spark, f"streams/{name}")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
