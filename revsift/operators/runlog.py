"""Run bookkeeping: tagged log lines (S10, F6-F8, A8), nested-config
flattening (F9), long metric tables (S12, A4) and trace spans (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import depunct, to_number

# --- fixed values ---------------------------------------------------------------
# First tag on a line; key and value are the shortest runs, value must be
# followed by whitespace.
COLLECT_PATTERN = r"\[COLLECT\]\s*(.+?)=(.+?)\s"
# Trace event types that are not turned into steps, and those that are.
IGNORED_EVENT_TYPES = ("chunking", "synthesize", "embedding", "node_parsing", "tree")
STEP_EVENT_TYPES = ("retrieve", "query", "function_call")
# ----------------------------------------------------------------------------------


def parse_collect(lines: DataFrame, line_col: str = "line", order_col: str = "line_no",
                  remove_punct: bool = True) -> DataFrame:
    """(key, value): the last value per key over the tagged lines. Values
    are numbers (int, else float, else NULL)."""
    m = lines.filter(F.col(line_col).rlike(COLLECT_PATTERN))
    key = F.regexp_extract(line_col, COLLECT_PATTERN, 1)
    if remove_punct:
        key = depunct(key)
    kv = m.select(key.alias("key"), to_number(F.regexp_extract(line_col, COLLECT_PATTERN, 2)).alias("value"),
                  F.col(order_col).alias("_o"))
    return kv.groupBy("key").agg(F.max_by("value", "_o").alias("value"))


def flatten_columns(schema: T.StructType, sep: str = "__", prefix: str = "", path: list | None = None) -> list:
    """Columns for every leaf of a nested struct schema, named by the key
    path joined with ``sep``. Arrays and maps are leaves; empty structs
    vanish."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{sep}{f.name}" if prefix else f.name
        p = (path or []) + [f.name]
        if isinstance(f.dataType, T.StructType):
            out += flatten_columns(f.dataType, sep, name, p)
        else:
            c = F.col(p[0])
            for part in p[1:]:
                c = c.getField(part)
            out.append(c.alias(name))
    return out


def flatten_struct(df: DataFrame, sep: str = "__") -> DataFrame:
    """one column per leaf of every struct column."""
    return df.select(*flatten_columns(df.schema, sep))


def log_metrics(wide: DataFrame, prefix: str = "", run: str | None = None) -> DataFrame:
    """One-row metrics/params frame -> long (name, value[, run])."""
    cols = wide.columns
    stack = F.expr("stack({}, {})".format(len(cols), ", ".join(
        f"'{prefix}{c}', CAST(`{c}` AS DOUBLE)" for c in cols)))
    out = wide.select(stack.alias("name", "value"))
    if run is not None:
        out = out.withColumn("run", F.lit(run))
    return out


def count_params(frames: dict[str, DataFrame], folder: str, prefix: str = "n_") -> DataFrame:
    """A4: write every frame as Parquet under ``folder``/name and return its
    row count as a run parameter, (name, value) as ``write_metrics`` takes
    them. Rows are counted by the job that writes them, not by one of their
    own. An empty frame counts 0; no frames give no rows."""
    counts = []
    for name, df in frames.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
        counts.append((f"{prefix}{name}", float(seen.get["n"])))
    spark = next(iter(frames.values())).sparkSession if frames else SparkSession.active()
    return spark.createDataFrame(counts, "name string, value double")


def write_metrics(long_df: DataFrame, path: str) -> None:
    long_df.write.mode("append").parquet(path)


def assemble_spans(events: DataFrame) -> DataFrame:
    """L1: pair start/end events by event_id into steps.

    Only retrieve / query / function_call become steps (the five ignored
    types and any other type are dropped); an end without a start is
    dropped; the parent is kept only when it is itself a step.
    Output: (event_id, event_type, parent_id, start_ts, end_ts)."""
    kept = events.filter(F.col("event_type").isin(*STEP_EVENT_TYPES))
    g = kept.groupBy("event_id").agg(
        # of several start rows the earliest names the step (ties: by type, then parent)
        F.min(F.when(F.col("phase") == "start", F.struct("ts", "event_type", "parent_id"))).alias("_s"),
        F.min(F.when(F.col("phase") == "start", F.col("ts"))).alias("start_ts"),
        F.max(F.when(F.col("phase") == "end", F.col("ts"))).alias("end_ts"))
    steps = g.filter(F.col("start_ts").isNotNull()).select(
        "event_id", F.col("_s.event_type").alias("event_type"), F.col("_s.parent_id").alias("_parent"), "start_ts", "end_ts")
    ids = steps.select(F.col("event_id").alias("_pid"))
    j = steps.join(ids, steps["_parent"] == ids["_pid"], "left")
    return j.select("event_id", "event_type", F.col("_pid").alias("parent_id"), "start_ts", "end_ts")


def render_collect_lines(events: DataFrame) -> DataFrame:
    """Log lines ``[COLLECT] <type>(n)=<round(value*100)> `` ordered by
    event_id (the test-data stand-in for a run log)."""
    return events.select(F.col("event_id").alias("line_no"), F.concat(
        F.lit("[COLLECT] "), F.col("event_type"), F.lit("(n)="),
        F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit(" ")).alias("line"))
