"""A2: describe every column of a table, exactly.

count, unique, top (most frequent value, ties -> smallest), freq, mean,
sample std, min, linear-interpolated quartiles, max. Quartiles are exact:
values are ranked with range partitioning (``global_rank``), so no task
holds more than one partition of values (``percentile`` would gather all
distinct values of a column in one final task; ``percentile_approx`` is not
exact). Numeric and decimal columns get moments and quartiles; all others
(text, dates, timestamps, booleans, binary, nested) get count, unique, top and
freq of their text (JSON for nested, hex for binary).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distributed import global_rank

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))

PROFILE_COLUMNS = ["column", "count", "unique", "top", "freq", "mean", "std", "min",
                   "p25", "p50", "p75", "max"]


def _long(df: DataFrame, cols: list, cast: str, label_prefix: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(label_prefix + c).alias("column"), F.col(c).cast(cast).alias("x"))
                    for c in cols])
    return df.select(F.explode(arr).alias("_e")).select("_e.column", "_e.x").filter(F.col("x").isNotNull())


def exact_quantiles(long_df: DataFrame, probs=QUARTILES) -> DataFrame:
    """(column, <name> per prob) from a long (column, x DOUBLE) table."""
    # A unique tie-breaker lets range partitioning split a value held by a
    # third of the rows over several tasks (equal values are interchangeable
    # for quantiles, so the result does not depend on it).
    tb = long_df.withColumn("_tb", F.monotonically_increasing_id())
    ranked = global_rank(tb, [F.col("column"), F.col("x"), F.col("_tb")])
    per_col = ranked.groupBy("column").agg(F.min("_rank").alias("_r0"), F.count(F.lit(1)).alias("_n"))
    r = ranked.join(F.broadcast(per_col), "column").withColumn("_pos", F.col("_rank") - F.col("_r0"))
    keep = F.lit(False)
    for _, p in probs:
        lo = F.floor((F.col("_n") - 1) * F.lit(p))
        keep = keep | (F.col("_pos") == lo) | (F.col("_pos") == lo + 1)
    near = r.filter(keep)  # at most 2 rows per quantile per column
    aggs = []
    for name, p in probs:
        h = (F.col("_n") - 1) * F.lit(p)
        lo = F.floor(h)
        aggs += [F.max(F.when(F.col("_pos") == lo, F.col("x"))).alias(f"{name}_lo"),
                 F.max(F.when(F.col("_pos") == lo + 1, F.col("x"))).alias(f"{name}_hi"),
                 F.first(h - lo).alias(f"{name}_f")]
    g = near.groupBy("column").agg(*aggs)
    out = [F.col("column")]
    for name, _ in probs:
        lo_v, hi_v, f = F.col(f"{name}_lo"), F.coalesce(F.col(f"{name}_hi"), F.col(f"{name}_lo")), F.col(f"{name}_f")
        out.append((lo_v + (hi_v - lo_v) * f).alias(name))
    return g.select(*out)


def profile(df: DataFrame, label_prefix: str = "") -> DataFrame:
    dtypes = dict(df.dtypes)
    num = [c for c in df.columns if dtypes[c] in NUMERIC or dtypes[c].startswith("decimal")]
    strs = [c for c in df.columns if c not in num]
    nested = {c: F.to_json(c) for c in strs if dtypes[c].startswith(("struct", "map", "array"))}
    df = df.withColumns(nested | {c: F.hex(c) for c in strs if dtypes[c] == "binary"})
    parts = []
    if num:
        nl = _long(df, num, "double", label_prefix)
        stats = nl.groupBy("column").agg(
            F.count(F.lit(1)).alias("count"), F.countDistinct("x").alias("unique"),
            F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
            F.min("x").alias("min"), F.max("x").alias("max"))
        q = exact_quantiles(nl)
        parts.append(stats.join(q, "column").select(
            "column", "count", "unique", F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("bigint").alias("freq"),
            *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]))
    if strs:
        sl = _long(df, strs, "string", label_prefix)
        vc = sl.groupBy("column", "x").agg(F.count(F.lit(1)).alias("c"))
        stats = vc.groupBy("column").agg(
            F.sum("c").cast("bigint").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min_by("x", F.struct((-F.col("c")).alias("nc"), F.col("x").alias("v"))).alias("top"),
            F.max("c").alias("freq"))
        parts.append(stats.select("column", "count", "unique", "top", "freq",
                                  *[F.lit(None).cast("double").alias(c)
                                    for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*PROFILE_COLUMNS)
