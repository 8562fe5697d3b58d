"""Opening-hours availability.

Rules: a business is open at t when ``open <= hour(t) < close`` on t's
weekday; minutes are ignored; a NULL or absent day, or an unknown business,
means closed (so overnight 18-2 and 0-0 ranges are never open). Slots come
from ``s = sha_mod(id '_' yyyy-MM-dd_HH, 10^8)``: 0 when s % 5 = 0, else
1 + (s div 5) % 10 (the Mersenne Twister draw is not reproduced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sha_mod
from .distributed import broadcast_if_small

HOURS_BROADCAST_ROWS = 5_000_000

# --- fixed values ---------------------------------------------------------------
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
HOUR_LABEL = "yyyy-MM-dd HH:00"
SEED_FORMAT = "yyyy-MM-dd_HH"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
SLOT_MODULUS = 10 ** 8
# ----------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def iso(col) -> Column:
    """timestamp -> ISO text (seconds precision)."""
    return F.date_format(_c(col), ISO_FORMAT)


def parse_iso(col) -> Column:
    """ISO text -> TIMESTAMP_NTZ (NULL when unparsable)."""
    return _c(col).try_cast("timestamp_ntz")


def weekday(col) -> Column:
    return F.date_format(_c(col), "EEEE")


def hour_label(col) -> Column:
    return F.date_format(_c(col), HOUR_LABEL)


def iso_micros(col) -> Column:
    """ISO text with a microsecond fraction only when it is non-zero."""
    c = _c(col)
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, ISO_FORMAT)).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def now_label() -> Column:
    """current local time as ISO text plus `` (Weekday)``."""
    ts = F.localtimestamp()
    return F.concat(iso_micros(ts), F.lit(" ("), weekday(ts), F.lit(")"))


# V1 / F10 -------------------------------------------------------------------------
def hour_of(part: Column) -> Column:
    """'9:30' -> 9 (the hour before the colon; minutes dropped)."""
    return F.split_part(part, F.lit(":"), F.lit(1)).try_cast("int")


def parse_hours(biz: DataFrame, id_col: str = "business_id", hours_col: str = "hours") -> DataFrame:
    """(business_id, day, open_hour, close_hour) from a weekday -> 'H:M-H:M'
    map; a NULL range gives NULL hours."""
    ex = biz.select(F.col(id_col).alias("business_id"), F.explode(hours_col).alias("day", "_range"))
    return ex.select("business_id", "day",
                     hour_of(F.split_part("_range", F.lit("-"), F.lit(1))).alias("open_hour"),
                     hour_of(F.split_part("_range", F.lit("-"), F.lit(2))).alias("close_hour"))


# V2 / J9 --------------------------------------------------------------------------
def open_condition(open_h: Column, close_h: Column, hour: Column, overnight: bool = False) -> Column:
    cond = (open_h <= hour) & (hour < close_h)
    if overnight:  # optional extension: 18-2 means open from 18 to 2 next day
        cond = cond | ((close_h < open_h) & ((hour >= open_h) | (hour < close_h)))
    return F.coalesce(cond, F.lit(False))


def is_open(requests: DataFrame, hours_rows: DataFrame, id_col: str = "business_id",
            ts_col: str = "ts", overnight: bool = False) -> DataFrame:
    """Adds ``is_open``. An equi join on (business, weekday) with the range
    test on the joined row; unknown business / absent day -> false. Above
    the broadcast bound it is a shuffle join whose hot keys AQE's skew join
    splits (the hours side has one row per key)."""
    r = requests.withColumn("_day", weekday(ts_col)).withColumn("_hour", F.hour(ts_col))
    h = hours_rows.select(F.col("business_id").alias("_bid"), F.col("day").alias("_hday"),
                          "open_hour", "close_hour")
    # one row per (business, weekday): broadcast after a bounded check, so a
    # business holding a third of the requests never meets a skewed join
    h, _ = broadcast_if_small(h, HOURS_BROADCAST_ROWS)
    j = r.join(h, (r[id_col] == h["_bid"]) & (r["_day"] == h["_hday"]), "left")
    return (j.withColumn("is_open", open_condition(F.col("open_hour"), F.col("close_hour"), F.col("_hour"),
                                                   overnight))
             .drop("_bid", "_hday", "_day", "_hour", "open_hour", "close_hour"))


# V3 / F11 -------------------------------------------------------------------------
def slot_seed(business_id, ts) -> Column:
    return sha_mod(F.concat(_c(business_id).cast("string"), F.lit("_"), F.date_format(_c(ts), SEED_FORMAT)),
                   SLOT_MODULUS)


def slots(business_id, ts) -> Column:
    s = slot_seed(business_id, ts)
    return F.when(F.pmod(s, F.lit(5)) == 0, F.lit(0)).otherwise(
        (F.lit(1) + F.pmod(F.floor(s / 5), F.lit(10))).cast("int")).cast("int")


# V4 -------------------------------------------------------------------------------
def check_availability(requests: DataFrame, hours_rows: DataFrame, id_col: str = "business_id",
                       ts_col: str = "ts", pax_col: str = "pax") -> DataFrame:
    """Adds ``ok`` = open and slots >= pax."""
    j = is_open(requests, hours_rows, id_col, ts_col)
    return j.withColumn("ok", F.col("is_open") & (slots(F.col(id_col), F.col(ts_col)) >= F.col(pax_col)))


# V5 -------------------------------------------------------------------------------
def availability_range(requests: DataFrame, hours_rows: DataFrame, id_col: str = "business_id",
                       start_col: str = "start", end_col: str = "end", pax_col: str = "pax") -> DataFrame:
    """One row per hour from start to end inclusive (step one hour; start
    after end gives no rows): (..., hour (label), ok)."""
    seq = F.when(F.col(start_col) <= F.col(end_col),
                 F.sequence(F.col(start_col), F.col(end_col), F.expr("INTERVAL 1 HOUR")))
    ex = requests.withColumn("_t", F.explode(seq))
    j = check_availability(ex, hours_rows, id_col, "_t", pax_col)
    return j.withColumn("hour", hour_label("_t")).drop("_t", "is_open")


def availability_json(rows: DataFrame, key_cols: list, label_col: str = "hour", ok_col: str = "ok",
                      requests: DataFrame | None = None) -> DataFrame:
    """per request, an ordered JSON object label -> bool. Bounded by the
    request's hour range. With ``requests``, a request whose range is empty
    gets ``{}``."""
    g = rows.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct(label_col, ok_col))).alias("_e"))
    out = g.select(*key_cols, F.to_json(F.map_from_entries("_e")).alias("availability"))
    if requests is not None:
        out = (requests.select(*key_cols).join(out, key_cols, "left")
                       .withColumn("availability", F.coalesce(F.col("availability"), F.lit("{}"))))
    return out


# X4 -------------------------------------------------------------------------------
def register_functions(spark: SparkSession) -> list:
    """Register SQL functions callable by name (temporary SQL UDFs: they
    inline into the plan): is_open_hour, slot_count, now_label, and the three
    that a caller with a business at hand uses - ``check_availability(id,
    open_hour, close_hour, ts, pax)``, ``check_availability_range(id,
    open_hour, close_hour, start, end, pax)`` (a JSON object, hour label ->
    whether there is a table; the hours are those of the day of ``start``)
    and ``get_business_id(names, ids, name)`` (the last id of a name)."""
    def slot_sql(ts: str) -> str:
        seed = ("pmod(" * 8 + "0L" + "".join(
            f" * 4294967296L + CAST(conv(substring(sha2(concat(business_id, '_', "
            f"date_format({ts}, '{SEED_FORMAT}')), 256), {8 * i + 1}, 8), 16, 10) AS BIGINT), {SLOT_MODULUS})"
            for i in range(8)))
        return f"CASE WHEN pmod({seed}, 5) = 0 THEN 0 ELSE CAST(1 + pmod(floor({seed} / 5), 10) AS INT) END"

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_open_hour(open_hour INT, close_hour INT, h INT) "
              "RETURNS BOOLEAN RETURN coalesce(open_hour <= h AND h < close_hour, false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION slot_count(business_id STRING, ts TIMESTAMP_NTZ) "
              f"RETURNS INT RETURN {slot_sql('ts')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION now_label() RETURNS STRING RETURN "
              "concat(CASE WHEN date_format(localtimestamp(), 'SSSSSS') = '000000' "
              "THEN date_format(localtimestamp(), \"yyyy-MM-dd'T'HH:mm:ss\") "
              "ELSE date_format(localtimestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") END, ' (', "
              "date_format(localtimestamp(), 'EEEE'), ')')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION check_availability(business_id STRING, open_hour INT, close_hour INT, "
              "ts TIMESTAMP_NTZ, pax INT) RETURNS BOOLEAN RETURN "
              "is_open_hour(open_hour, close_hour, hour(ts)) AND slot_count(business_id, ts) >= pax")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION check_availability_range(business_id STRING, open_hour INT, close_hour INT, "
              "first TIMESTAMP_NTZ, last TIMESTAMP_NTZ, pax INT) RETURNS STRING RETURN "
              f"to_json(map_from_entries(transform(CASE WHEN first <= last THEN sequence(first, last, INTERVAL 1 HOUR) "
              f"ELSE array() END, t -> struct(date_format(t, '{HOUR_LABEL}'), "
              # a lambda takes no SQL functions, so the test is written out
              f"coalesce(open_hour <= hour(t) AND hour(t) < close_hour, false) AND ({slot_sql('t')}) >= pax))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION get_business_id(names ARRAY<STRING>, ids ARRAY<STRING>, name STRING) "
              "RETURNS STRING RETURN try_element_at(filter(ids, (x, i) -> names[i] = name), -1)")
    return ["is_open_hour", "slot_count", "now_label", "check_availability", "check_availability_range", "get_business_id"]
