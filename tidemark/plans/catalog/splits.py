"""Splits and folds (2.10), plus the out-of-fold group-mean model (K6, pure SQL form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import split as SP
from tidemark.plans.registry import query
from tidemark.sources.tables import table

MD5_ORDER = "md5(CAST(o_orderkey AS VARCHAR)), o_orderkey"


# K1 ------------------------------------------------------------------------------------
@query("train_test_split", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {MD5_ORDER}) - 1 AS pos,
                  COUNT(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(pos < ceil(n * 0.25) AS INTEGER) AS is_test FROM r""")
def train_test_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return SP.train_test_split(o, "o_orderkey", 0.25)


# K2 ------------------------------------------------------------------------------------
@query("three_way_split", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {MD5_ORDER}) - 1 AS pos,
                  COUNT(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos < ceil(n * 0.6) THEN 'train'
                        WHEN pos < ceil(n * 0.8) THEN 'validation' ELSE 'test' END AS split
FROM r""")
def three_way_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return SP.three_way_split(o, "o_orderkey", (0.6, 0.2, 0.2))


# K3 ------------------------------------------------------------------------------------
K_FOLDS = 7


@query("kfold_assign", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
                  COUNT(*) OVER () AS n FROM orders),
q AS (SELECT o_orderkey, pos, n // {K_FOLDS} AS q, n % {K_FOLDS} AS r FROM r)
SELECT o_orderkey, CAST(CASE WHEN pos < r * (q + 1) THEN pos // (q + 1)
                             ELSE r + (pos - r * (q + 1)) // q END AS INTEGER) AS fold
FROM q""")
def kfold_assign(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return SP.kfold_assign(o, ["o_orderkey"], K_FOLDS)


# K4 ------------------------------------------------------------------------------------
@query("stratified_split", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5_ORDER}) - 1 AS pos,
                  COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(pos < ceil(n * 0.2) AS INTEGER) AS is_test FROM r""")
def stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_split(o, "o_orderkey", "o_orderstatus", 0.2)


# K5 ------------------------------------------------------------------------------------
@query("stratified_kfold", f"""
SELECT o_orderkey, o_orderstatus,
       CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5_ORDER}) - 1) % 3
            AS INTEGER) AS fold
FROM orders""")
def stratified_kfold(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_kfold(o, "o_orderkey", "o_orderstatus", 3)


# K6 (group-mean base model: pure SQL) ---------------------------------------------------
OOF_K = 5

OOF_SQL = f"""
WITH f AS (SELECT event_id, event_type, value,
                  CAST((row_number() OVER (PARTITION BY event_type
                        ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1) % {OOF_K}
                       AS INTEGER) AS fold FROM events),
tf AS (SELECT event_type, fold, SUM(CAST(value AS DECIMAL(18,2))) AS s, COUNT(*) AS c
       FROM f GROUP BY 1, 2),
t AS (SELECT event_type, SUM(s) AS s, SUM(c) AS c FROM tf GROUP BY 1),
p AS (SELECT f.event_id, f.event_type, f.fold, f.value,
             CAST(t.s - tf.s AS DOUBLE) / (t.c - tf.c) AS oof_pred
      FROM f JOIN tf USING (event_type, fold) JOIN t USING (event_type))"""


def oof_group_mean_frame(spark, sf_dir):
    """Each row predicted by the mean of its group over the *other* folds."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    f = SP.stratified_kfold(ev, "event_id", "event_type", OOF_K)
    dec = F.col("value").cast("decimal(18,2)")
    tf = f.groupBy("event_type", "fold").agg(F.sum(dec).alias("_s"), F.count(F.lit(1)).alias("_c"))
    t = tf.groupBy("event_type").agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    model = tf.join(t, "event_type").select(
        "event_type", "fold",
        ((F.col("_ts") - F.col("_s")).cast("double") / (F.col("_tc") - F.col("_c")))
        .alias("oof_pred"))
    return f.join(model, ["event_type", "fold"], "inner")


@query("oof_group_mean", OOF_SQL + """
SELECT event_id, event_type, fold, round(oof_pred, 6) AS oof_pred FROM p""")
def oof_group_mean(spark, sf_dir):
    p = oof_group_mean_frame(spark, sf_dir)
    return p.select("event_id", "event_type", "fold", F.round("oof_pred", 6).alias("oof_pred"))


# K4 (repeated) --------------------------------------------------------------------------
N_SPLITS = 10
_sss_sql = "\nUNION ALL\n".join(
    f"""SELECT {s} AS split, o_orderkey, o_orderstatus,
       CAST(row_number() OVER (PARTITION BY o_orderstatus
            ORDER BY md5('split{s}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1
            < ceil(COUNT(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS INTEGER) AS is_test
FROM orders""" for s in range(N_SPLITS))


@query("stratified_shuffle_split", _sss_sql)
def stratified_shuffle_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_shuffle_splits(o, "o_orderkey", "o_orderstatus", N_SPLITS, 0.2)
