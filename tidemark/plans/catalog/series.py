"""Series queries on ``events`` (device = user_id, lane = event_type, traffic = value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import series as SR
from tidemark.operators import table as TB
from tidemark.plans.registry import query
from tidemark.sources.tables import table

KEYS = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]

# SQL building blocks shared by the oracles below.
GAPPED = ("g AS (SELECT event_id, ts, user_id, event_type, value, "
          "CASE WHEN value > 10 THEN value END AS gv FROM events)")
WIN = "PARTITION BY user_id, event_type ORDER BY ts, event_id"


def gapped_events(spark, sf_dir):
    """Series columns plus the gapped value (the raw value is not carried along)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "user_id", "event_type", S.gapped("value").alias("gv"))


# W1 ------------------------------------------------------------------------------------
@query("forward_fill", f"""
WITH {GAPPED}
SELECT event_id, user_id, event_type, ts,
       last_value(gv IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS gv_filled
FROM g""")
def forward_fill(spark, sf_dir):
    ev = gapped_events(spark, sf_dir)
    res = SR.fill_gaps(ev, KEYS, ORDER, ["gv"], backward=False, suffix="_filled")
    return res.select("event_id", "user_id", "event_type", "ts", "gv_filled")


# W2 ------------------------------------------------------------------------------------
FFILL_BFILL_SQL = f"""coalesce(
  last_value(gv IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(gv IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("forward_backward_fill", f"""
WITH {GAPPED}
SELECT event_id, user_id, event_type, ts, {FFILL_BFILL_SQL} AS gv_filled
FROM g""")
def forward_backward_fill(spark, sf_dir):
    ev = gapped_events(spark, sf_dir)
    res = SR.fill_gaps(ev, KEYS, ORDER, ["gv"], backward=True, suffix="_filled")
    return res.select("event_id", "user_id", "event_type", "ts", "gv_filled")


# A4 + F8 + W1/W2: the flagship (traffic per weekday per lane) ----------------------------
@query("sum_by_weekday", f"""
WITH {GAPPED},
f AS (SELECT event_type, ts, {FFILL_BFILL_SQL} AS gv FROM g)
SELECT event_type, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
       CAST(SUM(CAST(gv AS DECIMAL(18,2))) AS DOUBLE) AS traffic,
       COUNT(*) AS n_rows
FROM f GROUP BY 1, 2""")
def sum_by_weekday(spark, sf_dir):
    ev = gapped_events(spark, sf_dir)
    filled = SR.fill_gaps(ev, KEYS, ORDER, ["gv"])
    return (filled.groupBy("event_type", S.weekday_monday0("ts").alias("weekday"))
                  .agg(F.sum(F.col("gv").cast("decimal(18,2)")).cast("double").alias("traffic"),
                       F.count(F.lit(1)).alias("n_rows")))


# W3 ------------------------------------------------------------------------------------
@query("series_row_number", f"""
SELECT event_id, user_id, event_type, row_number() OVER ({WIN}) - 1 AS pos FROM events""")
def series_row_number(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return SR.with_position(ev, KEYS, ORDER).select("event_id", "user_id", "event_type", "pos")


# W5 ------------------------------------------------------------------------------------
N_LAGS, N_LEADS = 20, 10
_lag_sql = ",\n".join([f"lag(gv, {i}) OVER ({WIN}) AS gv_lag_{i}" for i in range(1, N_LAGS + 1)]
                      + [f"lead(gv, {i}) OVER ({WIN}) AS gv_lead_{i}"
                         for i in range(1, N_LEADS + 1)])


@query("lag_features", f"""
WITH {GAPPED}
SELECT event_id, user_id, event_type, gv,
{_lag_sql}
FROM g""")
def lag_features(spark, sf_dir):
    ev = gapped_events(spark, sf_dir)
    res = SR.lag_features(ev, KEYS, ORDER, "gv", lags=N_LAGS, leads=N_LEADS)
    cols = (["event_id", "user_id", "event_type", "gv"]
            + [f"gv_lag_{i}" for i in range(1, N_LAGS + 1)]
            + [f"gv_lead_{i}" for i in range(1, N_LEADS + 1)])
    return res.select(*cols)


# W6 ------------------------------------------------------------------------------------
WINDOW_SIZE = 30


@query("sliding_windows", f"""
SELECT event_id, user_id, event_type,
       COUNT(*) OVER ({WIN} ROWS BETWEEN {WINDOW_SIZE - 1} PRECEDING AND CURRENT ROW) AS win_n,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER
            ({WIN} ROWS BETWEEN {WINDOW_SIZE - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) AS win_sum,
       COUNT(*) OVER ({WIN} ROWS BETWEEN {WINDOW_SIZE - 1} PRECEDING AND CURRENT ROW)
         = {WINDOW_SIZE} AS is_full
FROM events""")
def sliding_windows(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value")
    res = SR.sliding_sum(ev, KEYS, ORDER, "value", size=WINDOW_SIZE, cast="decimal(18,2)")
    return res.select("event_id", "user_id", "event_type", "win_n",
                      F.col("win_sum").cast("double").alias("win_sum"),
                      (F.col("win_n") == WINDOW_SIZE).alias("is_full"))


# W7 ------------------------------------------------------------------------------------
PERIOD = 200


@query("periodic_phase", f"""
SELECT event_id, user_id, event_type,
       CAST((row_number() OVER ({WIN}) - 1) % {PERIOD} AS BIGINT) AS phase
FROM events""")
def periodic_phase(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    res = SR.periodic_phase(ev, KEYS, ORDER, PERIOD)
    return res.select("event_id", "user_id", "event_type", F.col("phase").cast("long"))


# W8 ------------------------------------------------------------------------------------
@query("argmax_rows", """
SELECT event_id, event_type, value FROM events e
WHERE value = (SELECT max(value) FROM events m WHERE m.event_type = e.event_type)""")
def argmax_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return SR.rows_at_max(ev, "value", ["event_type"])


# J6 + A5 -------------------------------------------------------------------------------
@query("rows_at_global_max", """
SELECT event_id, user_id, event_type, value FROM events
WHERE value = (SELECT max(value) FROM events)""")
def rows_at_global_max(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return SR.rows_at_max(ev, "value")


# W4 ------------------------------------------------------------------------------------
@query("shared_key_flag", """
SELECT o_orderkey, o_custkey,
       CAST(COUNT(*) OVER (PARTITION BY o_custkey) > 1 AS INTEGER) AS key_shared
FROM orders""")
def shared_key_flag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return TB.shared_key_flag(orders, "o_custkey", out="key_shared")


# O1 ------------------------------------------------------------------------------------
@query("sort_series", """
SELECT event_id, user_id, event_type, ts, value FROM events
ORDER BY user_id, event_type, ts, event_id""")
def sort_series(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts",
                                               "value")
    return ev.orderBy(*KEYS, *ORDER)


# O5 ------------------------------------------------------------------------------------
SLICE_START, SLICE_STOP = 5, 9


@query("row_range_slice", f"""
SELECT * FROM (
  SELECT event_id, user_id, event_type, value, row_number() OVER ({WIN}) - 1 AS pos FROM events)
WHERE pos BETWEEN {SLICE_START} AND {SLICE_STOP}""")
def row_range_slice(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value")
    res = SR.row_range(ev, KEYS, ORDER, SLICE_START, SLICE_STOP)
    return res.select("event_id", "user_id", "event_type", "value", "pos")


# F7 ------------------------------------------------------------------------------------
@query("date_time_parts", """
SELECT event_id, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M:%S') AS time_of_day FROM events""")
def date_time_parts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.date_part("ts").alias("date"),
                     S.time_of_day("ts").alias("time_of_day"))


# F8 + F9 -------------------------------------------------------------------------------
@query("calendar_features", """
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(hour(ts) AS INTEGER) AS hour
FROM events""")
def calendar_features(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.weekday_monday0("ts").alias("dayofweek"),
                     S.hour_of_day("ts").alias("hour"))


# W6 (training windows: full windows only, reproducibly sampled) -------------------------
SAMPLE_FRACTION, SAMPLE_SALT = 0.25, "windows:"
# One long series per lane, as in the autoregressive training.
LANE_WIN = "PARTITION BY event_type ORDER BY ts, event_id"


@query("training_windows", f"""
WITH w AS (
  SELECT event_id, user_id, event_type,
         COUNT(*) OVER ({LANE_WIN} ROWS BETWEEN {WINDOW_SIZE - 1} PRECEDING AND CURRENT ROW)
           AS win_n,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER
              ({LANE_WIN} ROWS BETWEEN {WINDOW_SIZE - 1} PRECEDING AND CURRENT ROW) AS DOUBLE)
           AS win_sum
  FROM events)
SELECT event_id, user_id, event_type, win_sum FROM w
WHERE win_n = {WINDOW_SIZE}
  AND substr(md5('{SAMPLE_SALT}' || CAST(event_id AS VARCHAR)), 1, 4)
      < '{format(int(round(SAMPLE_FRACTION * 65536)), "04x")}'""")
def training_windows(spark, sf_dir):
    from tidemark.operators import split as SP
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value")
    res = SR.sliding_sum(ev, ["event_type"], ORDER, "value", size=WINDOW_SIZE,
                         cast="decimal(18,2)")
    keep = (F.col("win_n") == WINDOW_SIZE) & SP.hash_sample("event_id", SAMPLE_FRACTION,
                                                            SAMPLE_SALT)
    return res.where(keep).select("event_id", "user_id", "event_type",
                                  F.col("win_sum").cast("double").alias("win_sum"))
