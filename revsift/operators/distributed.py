"""Scale helpers shared by the operators.

* ``bounded_count`` / ``broadcast_if_small``: broadcast a side only after a
  bounded count proves it small; otherwise the caller takes a shuffle path.
* ``global_rank``: exact 1-based row number in a total order without a
  single-partition window (range partitioning + per-partition offsets).
* ``salted``: spread a hot join key over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default ceiling for a broadcast side, in rows. Callers pass their own.
DEFAULT_BROADCAST_ROWS = 200_000


def bounded_count(df: DataFrame, limit: int) -> int:
    """Row count of ``df`` capped at ``limit + 1`` (stops reading early)."""
    return df.limit(limit + 1).count()


def is_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    return bounded_count(df, max_rows) <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS):
    """``(df_or_broadcast_df, was_broadcast)`` after a bounded size check."""
    if is_small(df, max_rows):
        return F.broadcast(df), True
    return df, False


def global_rank(df: DataFrame, order_cols: list, rank_col: str = "_rank",
                num_partitions: int | None = None) -> DataFrame:
    """Add an exact 1-based rank of every row under ``order_cols``.

    ``order_cols`` must be a total order (ties broken by a key). The rows are
    range-partitioned and sorted inside each partition; the partition id and
    local position come from ``monotonically_increasing_id`` (partition id in
    the upper bits). This ranged frame is written once (``cut_lineage``):
    range bounds are sampled, so two evaluations of it could deal the rows
    differently. Per-partition counts of that copy (one row per partition, so
    bounded by the partition count) give the offsets, which are broadcast
    back. No step holds more than one partition of rows.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (df.repartitionByRange(n, *order_cols)
                 .sortWithinPartitions(*order_cols)
                 .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = (ordered.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
                      .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
    ordered = cut_lineage(ordered)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the single-partition window is bounded
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = ordered.join(F.broadcast(offsets), "_pid")
    return (out.withColumn(rank_col, F.col("_off") + F.col("_pos") + 1)
               .drop("_mid", "_pid", "_pos", "_off"))


def salted(df: DataFrame, salt_buckets: int, by: Column | None = None,
           replicate: bool = False, salt_col: str = "_salt") -> DataFrame:
    """Add a salt column for a skew-proof equi-join.

    The big side gets ``pmod(hash(by), buckets)``; the small side is
    replicated once per bucket (``replicate=True``). Joining on
    ``(key, _salt)`` splits any hot key over ``salt_buckets`` tasks.
    """
    if replicate:
        return df.withColumn(salt_col, F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return df.withColumn(salt_col, F.pmod(F.xxhash64(by), F.lit(salt_buckets)).cast("int"))


def rank_within(partition_cols: list, order_cols: list) -> Column:
    """``row_number()`` per group; with ``<= k`` Spark plans a partial
    WindowGroupLimit before the shuffle, so a hot group sends at most k rows
    per map partition."""
    return F.row_number().over(Window.partitionBy(*partition_cols).orderBy(*order_cols))


def top_k_per_group(df: DataFrame, partition_cols: list, order_cols: list, k: int,
                    rank_col: str = "rank") -> DataFrame:
    ranked = df.withColumn(rank_col, rank_within(partition_cols, order_cols))
    return ranked.filter(F.col(rank_col) <= k)


def spread(df: DataFrame, keys: list | None = None, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenising, hashing, substring search)
    enough tasks. Small or unsplittable input files arrive as fewer
    partitions than the session can run at once; only then the rows are
    redistributed, hashed by ``keys`` so that later aggregations keyed by a
    superset of them reuse the partitioning. At cluster scale the scan
    already has thousands of splits and this is a no-op (one planning step,
    no job). A frame that is already shuffled (its plan has an exchange) is
    left alone: Spark sizes its partitions, and counting them would run the
    shuffle."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if _shuffles(df):
        return df
    if df.rdd.getNumPartitions() >= target:
        return df
    # by key without a fixed count: AQE sizes the partitions (and keeps at
    # least the session's parallelism while coalescing)
    return df.repartition(*keys) if keys else df.repartition(target)


DEALT_BYTES = 8 << 20   # bytes of texts (Spark's estimate) of a task that counts their words


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key, for groupings by it that hold much more than the
    rows: with a stated number of partitions where the plan knows the size of
    its input (AQE would join partitions that are narrow before the grouping)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT_BYTES))
    return df.repartition(parts, key) if size < 1 << 50 and parts <= 1 << 17 else df.repartition(key)


def _shuffles(df: DataFrame) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once so several branches of a plan read it instead
    of recomputing it, and a lost executor does not replay the whole
    lineage. Uses a reliable ``checkpoint()`` into the session's checkpoint
    folder (``spark.checkpoint.dir``; required on a cluster, see
    ``ensure_checkpoint_dir``)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
