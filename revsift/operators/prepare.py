"""Dataset preparation.

Sampling is by hash order (``md5(seed ':' key)``), so a sample is exact in
size, repeatable, independent of partitioning, and reproducible in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_int, seeded_key, seeded_md5
from .distributed import global_rank


# P1 ------------------------------------------------------------------------------
def drop_missing(df: DataFrame, cols: list) -> DataFrame:
    return df.na.drop(subset=cols)


# P2 / F2 ---------------------------------------------------------------------------
def match_any(df: DataFrame, col: str, patterns: list) -> DataFrame:
    """Case-insensitive substring regex over alternatives (the patterns are
    regular expressions, not escaped; "Food" also matches "Seafood")."""
    return df.filter(F.col(col).rlike("(?i)" + "|".join(patterns)))


# P6 ------------------------------------------------------------------------------
def prefix_columns(df: DataFrame, prefix: str, keep: list = ()) -> DataFrame:
    """Prefix every column except those in ``keep``."""
    return df.select([F.col(c).alias(c if c in keep else prefix + c) for c in df.columns])


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(c[len(prefix):] if c.startswith(prefix) else c) for c in df.columns])


# P8 / F13 / R1 -----------------------------------------------------------------------
def embed_text(visible: list, text_col: str) -> Column:
    """Visible metadata as ``key: value`` lines, a blank line, then the text."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
             for c in visible]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.coalesce(F.col(text_col), F.lit("")))


def build_documents(df: DataFrame, text_col: str, drop: list, visible: list,
                    id_cols: list = ()) -> DataFrame:
    """One document per row: text, metadata map (every column except the
    dropped ones and the text, as strings) and the embed-visible text."""
    meta_cols = [c for c in df.columns if c not in set(drop) | {text_col}]
    meta = F.map_from_arrays(F.array(*[F.lit(c) for c in meta_cols]),
                             F.array(*[F.col(c).cast("string") for c in meta_cols]))
    return df.select(*id_cols, F.col(text_col).alias("text"), meta.alias("metadata"),
                     embed_text(visible, text_col).alias("embed_text"))


# P9 / T1 -------------------------------------------------------------------------
_OPS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}


def error_rows(df: DataFrame, metric: str, op: str, threshold: float, sort_cols: list) -> DataFrame:
    cond = getattr(F.col(metric), _OPS[op])(F.lit(threshold))
    return df.filter(cond).orderBy(*[F.col(c).asc_nulls_last() for c in sort_cols])


# P10 ------------------------------------------------------------------------------
class FilterSpecError(ValueError):
    pass


@dataclass(frozen=True)
class MetadataField:
    name: str
    type: str  # "str" | "int" | "float"


FILTER_OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE")


def _check_value(field: MetadataField, value):
    ok = {"str": isinstance(value, str),
          "int": isinstance(value, int) and not isinstance(value, bool),
          "float": isinstance(value, (int, float)) and not isinstance(value, bool)}[field.type]
    if not ok:
        raise FilterSpecError(f"value {value!r} does not fit {field.name}:{field.type}")


def filter_predicate(filters: list, schema: list) -> Column:
    """AND of typed metadata predicates. Raises on an unknown attribute, an
    unsupported operator (only EQ NE GT GTE LT LTE) or a mistyped value."""
    fields = {f.name: f for f in schema}
    cond = F.lit(True)
    for f in filters:
        key, op, value = f["key"], f["operator"], f["value"]
        if key not in fields:
            raise FilterSpecError(f"unknown attribute {key!r}")
        if op not in FILTER_OPERATORS:
            raise FilterSpecError(f"unsupported operator {op!r}")
        _check_value(fields[key], value)
        c, v = F.col(key), F.lit(value)
        cond = cond & {"EQ": c == v, "NE": c != v, "GT": c > v, "GTE": c >= v,
                       "LT": c < v, "LTE": c <= v}[op]
    return cond


def apply_filter_spec(df: DataFrame, spec: dict, schema: list, order: list | None = None) -> DataFrame:
    """P10: a plain Column predicate, so Catalyst pushes it to the scan. A
    ``top_k`` of the spec keeps the first rows by ``order`` (default: by all
    columns)."""
    out = df.filter(filter_predicate(spec.get("filters", []), schema))
    k = spec.get("top_k")
    if k is None:
        return out
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise FilterSpecError(f"top_k must be a positive integer, not {k!r}")
    return out.orderBy(*(order or out.columns)).limit(k)


# P12 -------------------------------------------------------------------------------
def stringify(df: DataFrame, cols: list, null_text: str = "None") -> DataFrame:
    """Cast to text with NULL rendered as ``null_text``; NaN becomes ``nan``;
    structs, maps and arrays become JSON."""
    out = df
    for c in cols:
        dt = df.schema[c].dataType.typeName()
        if dt in ("struct", "map", "array"):
            s = F.to_json(F.col(c))
        elif dt in ("double", "float"):
            s = F.when(F.isnan(F.col(c)), F.lit("nan")).otherwise(F.col(c).cast("string"))
        else:
            s = F.col(c).cast("string")
        out = out.withColumn(c, F.coalesce(s, F.lit(null_text)))
    return out


# P13 / T6 ----------------------------------------------------------------------------
def first_n(df: DataFrame, n: int, order: list) -> DataFrame:
    """First ``n`` rows by a key order (TakeOrderedAndProject: per-partition
    top-n, then a merge of n rows per partition)."""
    return df.orderBy(*order).limit(n)


# J1 --------------------------------------------------------------------------------
def semi_join(df: DataFrame, ids: DataFrame, on) -> DataFrame:
    return df.join(ids, on, "left_semi")


def cascade_sample(business: DataFrame, review: DataFrame, user: DataFrame,
                   biz_key: str, review_biz_key: str, review_user_key: str, user_key: str):
    """Keep the reviews of the chosen businesses, then the users of those
    reviews (two semi joins; Spark may add runtime Bloom filters)."""
    r = review.join(business.select(F.col(biz_key).alias(review_biz_key)), review_biz_key, "left_semi")
    u = user.join(r.select(F.col(review_user_key).alias(user_key)), user_key, "left_semi")
    return business, r, u


# J2 --------------------------------------------------------------------------------
def join_m1(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Left join that enforces many-to-one: a right key seen twice raises,
    whether or not a left row matches it. The check is its own job over the
    right keys (partial counts, then one row per duplicate at most), run
    before the join is built: inside the lazy plan, column pruning or join
    elimination could drop it."""
    keys = right.filter(F.col(on).isNotNull())
    twice = keys.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key in right side of m:1 join on {on}: {twice[0][on]}")
    return left.join(keys, on, how)


# J4 / V6 ---------------------------------------------------------------------------
def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key -> value with the last row (by ``order``) winning, NULLs dropped.
    ``max_by`` is a partial+final aggregate: a hot key costs one row per
    map task."""
    return (df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
              .groupBy(key).agg(F.max_by(value, order).alias(value)))


def lookup(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Point lookup: NULL on a miss."""
    return df.join(mapping, key, "left")


# A1 --------------------------------------------------------------------------------
def category_share(df: DataFrame, col: str, sep: str) -> DataFrame:
    """Count of rows per category (list split on the literal ``sep``) and the share of
    rows (not of categories), largest first, ties by name."""
    total = df.filter(F.col(col).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    cats = (df.select(F.explode(F.split(F.col(col), "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E")).alias("category"))
              .groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    out = cats.join(F.broadcast(total))  # one-row total
    return (out.select("category", "n", "total",
                       F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("perc"))
               .orderBy(F.col("n").desc(), "category"))


# A3 --------------------------------------------------------------------------------
def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# T3 --------------------------------------------------------------------------------
def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: the n smallest ``md5(seed ':' key)``, ties
    by key. Planned as TakeOrderedAndProject (n rows per partition)."""
    h = seeded_md5(seed, F.col(key))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


# T4 --------------------------------------------------------------------------------
def sample_with_replacement(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Draw j = 0..n-1 takes the row at a random place in the order of the
    keys (nulls first): the first 15 hex digits of ``md5(seed ':' j)`` modulo
    the row count. n is clamped to the row count; 0 = every row once. Rows
    are ranked once by range partitions and meet the draws in one join, so
    the cost is that of the rows plus that of the draws."""
    if n == 0:
        return df.select(F.col(key)).withColumn("draw", F.lit(None).cast("int"))
    ranked = global_rank(df.select(key), [F.col(key)])
    total = ranked.agg(F.max("_rank")).first()[0] or 0  # one number
    draws = df.sparkSession.range(min(n, total)).select(
        F.col("id").cast("int").alias("draw"),
        (hex_int(seeded_key(seed, F.col("id")), 1, 15) % F.lit(max(total, 1)) + 1).alias("_rank"))
    return draws.join(ranked, "_rank").select(key, "draw")


# T5 / J3 / U3 ----------------------------------------------------------------------
def assign_split(df: DataFrame, key: str, ratio: float = 0.7, seed: int = 42,
                 side_col: str = "side") -> DataFrame:
    """Group split as a column: distinct keys in ``md5(seed ':' key)`` order,
    the first floor(ratio * n) are ``train``, the rest ``val`` (NULL keys are
    ``val``). Exact global ranks come from range partitioning (no single-task
    sort or window); rows get their side through one join on the key."""
    keys = df.select(key).distinct().filter(F.col(key).isNotNull())
    ranked = global_rank(keys.withColumn("_h", seeded_md5(seed, F.col(key))), [F.col("_h"), F.col(key)])
    n = keys.agg(F.count(F.lit(1)).alias("_n"))  # one row
    sides = ranked.join(F.broadcast(n)).select(
        key, F.when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(ratio)), F.lit("train")).otherwise(F.lit("val"))
             .alias(side_col))
    return df.join(sides, key, "left").withColumn(side_col, F.coalesce(F.col(side_col), F.lit("val")))


def split_by_group(df: DataFrame, key: str, ratio: float = 0.7, seed: int = 42):
    """(train, val): no group on both sides (see ``assign_split``)."""
    tagged = assign_split(df, key, ratio, seed, "_side")
    return (tagged.filter(F.col("_side") == "train").drop("_side"),
            tagged.filter(F.col("_side") == "val").drop("_side"))
