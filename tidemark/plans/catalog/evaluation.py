"""SQL-checkable models and metrics (2.11: M6, M15 regression form, M14 lag-1 form,
M23-M25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as EV
from tidemark.operators import series as SR
from tidemark.plans.catalog.splits import OOF_SQL, oof_group_mean_frame
from tidemark.plans.registry import query
from tidemark.sources.tables import table

R6 = ["slope", "intercept", "r2"]


def _round(df, cols, nd=6):
    return df.select(*[F.round(c, nd).alias(c) if c in cols else F.col(c) for c in df.columns])


# M6 ------------------------------------------------------------------------------------
@query("ols_per_group", """
SELECT event_type, round(regr_slope(value, CAST(hour(ts) AS DOUBLE)), 6) AS slope,
       round(regr_intercept(value, CAST(hour(ts) AS DOUBLE)), 6) AS intercept,
       round(regr_r2(value, CAST(hour(ts) AS DOUBLE)), 6) AS r2,
       CAST(regr_count(value, CAST(hour(ts) AS DOUBLE)) AS BIGINT) AS n
FROM events GROUP BY 1""")
def ols_per_group(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_type", "value", F.hour("ts").cast("double").alias("hour"))
    return _round(EV.group_ols(ev, "value", "hour", ["event_type"]), R6)


# M15 (regression form: one model per device) -------------------------------------------
@query("model_per_group", """
WITH s AS (SELECT user_id, value,
                  CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS k
           FROM events)
SELECT user_id, round(regr_slope(value, k), 6) AS slope,
       round(regr_intercept(value, k), 6) AS intercept, round(regr_r2(value, k), 6) AS r2,
       CAST(regr_count(value, k) AS BIGINT) AS n
FROM s GROUP BY 1""")
def model_per_group(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "user_id", "value", F.get_json_object("props", "$.k").cast("int").cast("double").alias("k"))
    return _round(EV.group_ols(ev, "value", "k", ["user_id"]), R6)


# M14 (lag-1 autoregression per lane) ----------------------------------------------------
@query("ar1_per_series", """
WITH l AS (SELECT event_type, value,
                  lag(value, 1) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS lag1
           FROM events)
SELECT event_type, round(regr_slope(value, lag1), 6) AS slope,
       round(regr_intercept(value, lag1), 6) AS intercept, round(regr_r2(value, lag1), 6) AS r2,
       CAST(regr_count(value, lag1) AS BIGINT) AS n
FROM l GROUP BY 1""")
def ar1_per_series(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                               "value")
    lagged = SR.lag_features(ev, ["user_id", "event_type"], ["ts", "event_id"], "value", lags=1)
    return _round(EV.group_ols(lagged, "value", "value_lag_1", ["event_type"]), R6)


# M23 -----------------------------------------------------------------------------------
@query("regression_metrics", OOF_SQL + """
SELECT COUNT(*) AS n, round(avg((value - oof_pred) * (value - oof_pred)), 6) AS mse,
       round(avg(abs(value - oof_pred)), 6) AS mae,
       round(1 - sum((value - oof_pred) * (value - oof_pred)) / (var_pop(value) * COUNT(*)), 6)
         AS r2
FROM p""")
def regression_metrics(spark, sf_dir):
    p = oof_group_mean_frame(spark, sf_dir)
    m = EV.regression_metrics(p, "value", "oof_pred")
    return _round(m, ["mse", "mae", "r2"])


# M24 -----------------------------------------------------------------------------------
def rule_predictions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id", "quality", (F.col("n_chars") > 1000).cast("int").alias("pred"))


RULE_SQL = """
WITH r AS (SELECT d.doc_id, l.quality, CAST(d.n_chars > 1000 AS INTEGER) AS pred
           FROM documents d JOIN labels l USING (doc_id))"""


@query("accuracy", RULE_SQL + """
SELECT round(avg(CAST(quality = pred AS DOUBLE)), 6) AS accuracy, COUNT(*) AS n FROM r""")
def accuracy(spark, sf_dir):
    a = EV.accuracy(rule_predictions(spark, sf_dir), "quality", "pred")
    return _round(a, ["accuracy"])


# M25 -----------------------------------------------------------------------------------
@query("classification_report", RULE_SQL + """,
cls AS (SELECT quality AS c FROM r UNION SELECT pred FROM r),
per AS (SELECT CAST(c AS VARCHAR) AS class,
               coalesce(sum(CAST(pred = c AND quality = c AS INTEGER)) / nullif(sum(CAST(pred = c AS INTEGER)), 0), 0) AS precision,
               coalesce(sum(CAST(pred = c AND quality = c AS INTEGER)) / nullif(sum(CAST(quality = c AS INTEGER)), 0), 0) AS recall,
               sum(CAST(quality = c AS INTEGER)) AS support
        FROM cls, r GROUP BY c),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       CAST(support AS BIGINT) AS support, round(f1, 6) AS f1 FROM per2
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), CAST(sum(support) AS BIGINT),
       round(avg(f1), 6) FROM per2
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), CAST(sum(support) AS BIGINT),
       round(sum(f1 * support) / sum(support), 6) FROM per2""")
def classification_report(spark, sf_dir):
    rep = EV.classification_report(rule_predictions(spark, sf_dir), "quality", "pred")
    return _round(rep, ["precision", "recall", "f1"])
