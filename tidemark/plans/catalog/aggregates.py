"""Aggregations and profiles (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import features as FE
from tidemark.operators import table as TB
from tidemark.plans.catalog.relational import LINE_NUMERIC, STATUSES
from tidemark.plans.registry import query
from tidemark.sources.tables import table


def gapped_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", "user_id", "event_type",
                     S.gapped("value").alias("gv"), "props")


GAPPED_SQL = ("SELECT event_id, ts, user_id, event_type, CASE WHEN value > 10 THEN value END "
              "AS gv, props FROM events")


# A1 ------------------------------------------------------------------------------------
@query("value_counts", """
SELECT o_orderpriority, COUNT(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count DESC, o_orderpriority""")
def value_counts(spark, sf_dir):
    return TB.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


# A2 ------------------------------------------------------------------------------------
@query("group_count_two_keys", """
SELECT o_orderstatus, o_orderpriority, COUNT(o_totalprice) AS n_price FROM orders GROUP BY 1, 2""")
def group_count_two_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("o_totalprice").alias("n_price"))


# A3 + F2 -------------------------------------------------------------------------------
@query("rate_by_text_length", """
SELECT CAST(floor(length(d.text) / 1000) AS BIGINT) AS length_bucket,
       round(avg(l.quality), 6) AS quality_rate, COUNT(*) AS n_docs
FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""")
def rate_by_text_length(spark, sf_dir):
    # the length, not the text, goes through the join
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.length("text") / 1000).cast("long").alias("length_bucket"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "inner").groupBy("length_bucket").agg(
        F.round(F.avg("quality"), 6).alias("quality_rate"), F.count(F.lit(1)).alias("n_docs"))


# A7 ------------------------------------------------------------------------------------
@query("group_median", """
SELECT o_orderpriority, round(median(o_totalprice), 6) AS median_price,
       round(quantile_cont(o_totalprice, 0.25), 6) AS q25_price
FROM orders GROUP BY 1""")
def group_median(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    q = TB.group_quantiles(o, "o_totalprice", [0.5, 0.25], ["o_orderpriority"],
                           ["median_price", "q25_price"])
    return q.select("o_orderpriority", F.round("median_price", 6).alias("median_price"),
                    F.round("q25_price", 6).alias("q25_price"))


# A8 ------------------------------------------------------------------------------------
@query("column_mode", """
SELECT p_brand AS mode FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY COUNT(*) DESC, p_brand LIMIT 1""")
def column_mode(spark, sf_dir):
    return TB.group_mode(table(spark, sf_dir, "part"), "p_brand")


@query("group_mode", """
SELECT p_type, mode FROM (
  SELECT p_type, p_brand AS mode,
         row_number() OVER (PARTITION BY p_type ORDER BY COUNT(*) DESC, p_brand) AS rk
  FROM part GROUP BY p_type, p_brand) WHERE rk = 1""")
def group_mode(spark, sf_dir):
    return TB.group_mode(table(spark, sf_dir, "part"), "p_brand", ["p_type"])


# A9 ------------------------------------------------------------------------------------
@query("nonnull_counts", f"""
SELECT COUNT(event_id) AS event_id, COUNT(ts) AS ts, COUNT(user_id) AS user_id,
       COUNT(event_type) AS event_type, COUNT(gv) AS gv, COUNT(props) AS props
FROM ({GAPPED_SQL})""")
def nonnull_counts(spark, sf_dir):
    return TB.nonnull_counts(gapped_events(spark, sf_dir))


# A11 -----------------------------------------------------------------------------------
_schema_rows = [(0, "event_id", "bigint"), (1, "ts", "timestamp_ntz"), (2, "user_id", "bigint"),
                (3, "event_type", "string"), (4, "gv", "double"), (5, "props", "string")]


@query("schema_report", "WITH g AS (" + GAPPED_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column, '{t}' AS type, COUNT({c}) AS non_null FROM g"
    for i, c, t in _schema_rows))
def schema_report(spark, sf_dir):
    return TB.schema_report(gapped_events(spark, sf_dir))


# A10 -----------------------------------------------------------------------------------
_describe_sql = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column, COUNT({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min,
       round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
       round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"""
    for c in LINE_NUMERIC)


@query("describe_numeric", _describe_sql)
def describe_numeric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LINE_NUMERIC)
    d = TB.describe_numeric(li)
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in
                                         ["mean", "std"]], "min",
                    *[F.round(c, 6).alias(c) for c in ["q25", "q50", "q75"]], "max")


# A12 + O3 ------------------------------------------------------------------------------
@query("distinct_values", "SELECT DISTINCT event_type FROM events ORDER BY event_type")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


# A13 -----------------------------------------------------------------------------------
@query("having_count", """
SELECT o_custkey, COUNT(*) AS count FROM orders GROUP BY 1 HAVING COUNT(*) > 1""")
def having_count(spark, sf_dir):
    return TB.having_count(table(spark, sf_dir, "orders"), "o_custkey", min_count=2)


# A14 -----------------------------------------------------------------------------------
_corr_sql = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in LINE_NUMERIC for b in LINE_NUMERIC)


@query("correlation_matrix", _corr_sql)
def correlation_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LINE_NUMERIC)
    cm = TB.correlation_matrix(li, LINE_NUMERIC)
    return cm.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


# A15 -----------------------------------------------------------------------------------
_ct_cols = ", ".join(f"COUNT(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in STATUSES)


@query("crosstab_pivot", f"""
SELECT o_orderpriority, {_ct_cols} FROM orders GROUP BY 1""")
def crosstab_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    return TB.crosstab(o, "o_orderpriority", "o_orderstatus", FE.fit_levels(o, "o_orderstatus"))


# A16 -----------------------------------------------------------------------------------
@query("rowwise_mean", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount > 0.05 THEN (l_discount + l_tax) / 2 ELSE l_tax END, 6)
         AS row_mean
FROM lineitem""")
def rowwise_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    gd = S.gapped("l_discount", 0.05)
    return li.select("l_orderkey", "l_linenumber",
                     F.round(S.row_mean(gd, "l_tax"), 6).alias("row_mean"))


# A17 -----------------------------------------------------------------------------------
@query("rowwise_mode", """
SELECT l_orderkey, l_linenumber,
       (SELECT v FROM (SELECT unnest([l_discount, l_tax, round(l_discount * 2, 2)]) AS v)
        GROUP BY v ORDER BY COUNT(*) DESC, v LIMIT 1) AS row_mode
FROM lineitem""")
def rowwise_mode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax",
        F.round(F.col("l_discount") * 2, 2).alias("d2"))
    return TB.rowwise_mode(li, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax", "d2"])


# A18 -----------------------------------------------------------------------------------
def direction_long(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    direction = F.when(F.col("event_type").isin("click", "view"), F.lit("1")).otherwise(F.lit("3"))
    return ev.groupBy(F.col("user_id").alias("device"),
                      F.date_trunc("hour", "ts").alias("time"), direction.alias("direction")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def direction_wide(spark, sf_dir):
    """(device, time, "1", "3"): the direction sums side by side."""
    return (direction_long(spark, sf_dir).groupBy("device", "time")
            .pivot("direction", ["1", "3"]).agg(F.first("total")))


@query("direction_rollup", """
SELECT user_id AS device, date_trunc('hour', ts) AS time,
       CASE WHEN event_type IN ('click', 'view') THEN '1' ELSE '3' END AS direction,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2, 3""")
def direction_rollup(spark, sf_dir):
    return direction_long(spark, sf_dir)


# A19 -----------------------------------------------------------------------------------
KDE_GRID = [float(x) for x in range(0, 501, 10)]


@query("kde_grid", """
WITH s AS (SELECT event_type, COUNT(value) AS n, stddev_samp(value) AS sd FROM events GROUP BY 1),
p AS (SELECT event_type, sd * pow(n, -0.2) AS h FROM s),
grid AS (SELECT CAST(g AS DOUBLE) AS x FROM range(0, 501, 10) t(g)),
k AS (SELECT p.event_type, grid.x, p.h,
             avg(exp(-0.5 * ((grid.x - e.value) / p.h) * ((grid.x - e.value) / p.h))) AS a
      FROM events e JOIN p USING (event_type) CROSS JOIN grid GROUP BY 1, 2, 3)
SELECT event_type, x, round(a / (h * sqrt(2 * pi())), 9) AS density FROM k""")
def kde_grid(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    k = TB.kde_grid(ev, "value", KDE_GRID, ["event_type"])
    return k.select("event_type", "x", F.round("density", 9).alias("density"))
