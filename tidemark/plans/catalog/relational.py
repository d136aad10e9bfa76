"""Projections, predicates, joins, sorts and set operations (2.2, 2.3, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import features as FE
from tidemark.operators import series as SR
from tidemark.operators import table as TB
from tidemark.plans.registry import query
from tidemark.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


# P1 ------------------------------------------------------------------------------------
@query("project_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def project_columns(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice")


# P2 ------------------------------------------------------------------------------------
@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf_dir):
    return orders(spark, sf_dir).drop("o_orderdate", "o_orderpriority")


# P3 ------------------------------------------------------------------------------------
@query("select_by_name_regex", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_by_name_regex(spark, sf_dir):
    return TB.select_by_name_regex(orders(spark, sf_dir), r"price|key")


# P4 ------------------------------------------------------------------------------------
RENAMED = ["id", "customer", "status", "fare", "date", "priority"]


@query("rename_columns", """
SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS fare,
       o_orderdate AS date, o_orderpriority AS priority FROM orders""")
def rename_columns(spark, sf_dir):
    return TB.rename_all(orders(spark, sf_dir), RENAMED)


# P5 ------------------------------------------------------------------------------------
@query("derived_ratios", """
SELECT l_orderkey, l_linenumber,
       l_extendedprice / (l_quantity + 1) AS price_per_unit,
       l_discount * l_extendedprice AS discount_amount,
       l_quantity * l_quantity AS quantity_sq,
       l_quantity + l_linenumber AS qty_plus_line,
       1 AS one
FROM lineitem""")
def derived_ratios(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / (F.col("l_quantity") + 1)).alias("price_per_unit"),
        (F.col("l_discount") * F.col("l_extendedprice")).alias("discount_amount"),
        (F.col("l_quantity") * F.col("l_quantity")).alias("quantity_sq"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("qty_plus_line"),
        F.lit(1).alias("one"))


# P6 ------------------------------------------------------------------------------------
@query("filter_conjunction", """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""")
def filter_conjunction(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW"))


# P7 ------------------------------------------------------------------------------------
@query("null_filter", """
SELECT event_id, user_id, event_type FROM events WHERE NOT (value > 10)""")
def null_filter(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type",
                                               S.gapped("value").alias("gv"))
    return ev.where(F.col("gv").isNull()).drop("gv")


# P8 ------------------------------------------------------------------------------------
@query("rows_with_any_null", """
SELECT DISTINCT user_id, event_type,
       CASE WHEN value > 10 THEN value END AS gv,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 20
            THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS gk
FROM events
WHERE NOT (value > 10) OR NOT (CAST(json_extract_string(props, '$.k') AS INTEGER) > 20)""")
def rows_with_any_null(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    d = ev.select("user_id", "event_type", S.gapped("value").alias("gv"),
                  S.gapped(k, 20).alias("gk"))
    return TB.rows_with_any_null(d)


# P9 ------------------------------------------------------------------------------------
@query("conditional_assign", """
WITH a AS (SELECT o_orderkey, o_orderstatus,
                  CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 2 ELSE o_totalprice END AS fare
           FROM orders)
SELECT o_orderkey, CASE WHEN fare > 250000 THEN 250000.0 ELSE fare END AS fare FROM a""")
def conditional_assign(spark, sf_dir):
    o = orders(spark, sf_dir)
    # Masks applied in order; the second reads the result of the first.
    fare = F.col("o_totalprice")
    fare = F.when(F.col("o_orderstatus") == "P", fare / 2).otherwise(fare)
    step = o.select("o_orderkey", fare.alias("fare"))
    return step.select("o_orderkey",
                       F.when(F.col("fare") > 250000, F.lit(250000.0))
                        .otherwise(F.col("fare")).alias("fare"))


# P10 -----------------------------------------------------------------------------------
def _title_sql(col):
    hits = ", ".join([f"CASE WHEN instr({col}, '{t}') > 0 THEN '{t}' END"
                      for t in S.TITLE_SEARCH_ORDER])
    return f"coalesce({hits})"


def _fold_sql(title, male):
    groups = " ".join([f"WHEN {title} IN ({', '.join(repr(m) for m in members)}) THEN '{g}'"
                       for g, members in S.TITLE_GROUPS.items()])
    return (f"CASE {groups} WHEN {title} = 'Dr' THEN CASE WHEN {male} THEN 'Mr' ELSE 'Mrs' END "
            f"WHEN {title} IS NULL OR {title} = '' THEN CASE WHEN {male} THEN 'Master' "
            f"ELSE 'Miss' END ELSE {title} END")


@query("case_mapping", f"""
WITH t AS (SELECT doc_id, lang, {_title_sql('text')} AS title FROM documents)
SELECT doc_id, title, {_fold_sql('title', "lang = 'en'")} AS title_group FROM t""")
def case_mapping(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sex = F.when(F.col("lang") == "en", F.lit("male")).otherwise(F.lit("female"))
    t = d.select("doc_id", S.first_substring("text", S.TITLE_SEARCH_ORDER).alias("title"),
                 sex.alias("sex"))
    return t.select("doc_id", "title", S.fold_title("title", "sex").alias("title_group"))


# P11 -----------------------------------------------------------------------------------
@query("dict_mapping", """
SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END
       AS INTEGER) AS status_code FROM orders""")
def dict_mapping(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.select("o_orderkey",
                    S.dict_map("o_orderstatus", {"F": 0, "O": 1, "P": 2}).alias("status_code"))


# P12 -----------------------------------------------------------------------------------
@query("cast_columns", """
SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS fare_int,
       CAST(o_custkey AS DOUBLE) AS customer_f,
       CAST(trunc(-o_totalprice / 1000) AS INTEGER) AS neg_thousands FROM orders""")
def cast_columns(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.select("o_orderkey", F.col("o_totalprice").cast("int").alias("fare_int"),
                    F.col("o_custkey").cast("double").alias("customer_f"),
                    (-F.col("o_totalprice") / 1000).cast("int").alias("neg_thousands"))


# P13 -----------------------------------------------------------------------------------
@query("string_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'blue')")
def string_contains(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.where(F.col("p_name").contains("blue"))


# P14 -----------------------------------------------------------------------------------
@query("membership_flag", """
SELECT c_custkey,
       CASE WHEN c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)
            THEN 1 ELSE 0 END AS is_member
FROM customer""")
def membership_flag(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    repeat = TB.having_count(orders(spark, sf_dir), "o_custkey", min_count=11)
    return TB.membership_flag(c, "c_custkey", repeat, "o_custkey")


# J1 ------------------------------------------------------------------------------------
@query("join_features_by_id", """
SELECT o.o_orderkey, o.o_totalprice, l.line_total, l.n_lines
FROM orders o JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
                           AS line_total, COUNT(*) AS n_lines
                    FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""")
def join_features_by_id(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("line_total"),
        F.count(F.lit(1)).alias("n_lines"))
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    return (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "inner")
             .select("o_orderkey", "o_totalprice", "line_total", "n_lines"))


# J2 ------------------------------------------------------------------------------------
@query("full_outer_counts", """
SELECT o_orderpriority, f_count, other_count FROM
  (SELECT o_orderpriority, COUNT(*) AS f_count FROM orders
   WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1) a
FULL OUTER JOIN
  (SELECT o_orderpriority, COUNT(*) AS other_count FROM orders
   WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1) b
USING (o_orderpriority)""")
def full_outer_counts(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderstatus", "o_orderpriority")
    a = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW"))
    b = o.where((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") != "1-URGENT"))
    return TB.full_outer_counts(a, b, "o_orderpriority", "f_count", "other_count")


# J3 + A7 -------------------------------------------------------------------------------
@query("group_stat_lookup", """
SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice, round(m.prio_median, 6) AS prio_median
FROM orders o JOIN (SELECT o_orderpriority, median(o_totalprice) AS prio_median
                    FROM orders GROUP BY 1) m USING (o_orderpriority)""")
def group_stat_lookup(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    med = FE.small_side(TB.group_median(o, "o_totalprice", ["o_orderpriority"], out="prio_median"))
    res = o.join(med, "o_orderpriority", "inner")
    return res.select("o_orderkey", "o_orderpriority", "o_totalprice",
                      F.round("prio_median", 6).alias("prio_median"))


# J4 ------------------------------------------------------------------------------------
RULE_CUTOFF = "1998-01-01"


@query("bad_cases_semi_join", f"""
SELECT * FROM orders WHERE o_orderkey IN (
  SELECT o_orderkey FROM orders
  WHERE (CASE WHEN o_orderdate < TIMESTAMP '{RULE_CUTOFF}' THEN 'F' ELSE 'O' END) <> o_orderstatus)""")
def bad_cases_semi_join(spark, sf_dir):
    o = orders(spark, sf_dir)
    pred = F.when(F.col("o_orderdate") < F.lit(RULE_CUTOFF).cast("timestamp_ntz"),
                  F.lit("F")).otherwise(F.lit("O"))
    wrong = o.select("o_orderkey", pred.alias("pred"), "o_orderstatus").where(
        F.col("pred") != F.col("o_orderstatus")).select(F.col("o_orderkey").alias("bad_id"))
    return o.join(wrong, o.o_orderkey == wrong.bad_id, "left_semi")


# J5 ------------------------------------------------------------------------------------
@query("zip_by_row_number", """
WITH p AS (SELECT event_id, user_id, event_type, value,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos
           FROM events WHERE event_type IN ('click', 'view'))
SELECT c.user_id, c.pos, c.event_id AS click_id, v.event_id AS view_id,
       c.value AS click_value, v.value AS view_value
FROM p c JOIN p v ON c.user_id = v.user_id AND c.pos = v.pos
WHERE c.event_type = 'click' AND v.event_type = 'view'""")
def zip_by_row_number(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    p = SR.with_position(ev.select("event_id", "ts", "user_id", "event_type", "value"),
                         ["user_id", "event_type"], ["ts", "event_id"])
    c = p.where(F.col("event_type") == "click").select(
        "user_id", "pos", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    v = p.where(F.col("event_type") == "view").select(
        "user_id", "pos", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return c.join(v, ["user_id", "pos"], "inner").select(
        "user_id", "pos", "click_id", "view_id", "click_value", "view_value")


# O2 ------------------------------------------------------------------------------------
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("sorted_correlations", """
SELECT col_b AS feature, round(c, 6) AS corr FROM (
  SELECT 'l_quantity' AS col_b, corr(l_extendedprice, l_quantity) AS c FROM lineitem
  UNION ALL SELECT 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem)
ORDER BY corr DESC""")
def sorted_correlations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LINE_NUMERIC)
    cm = TB.correlation_matrix(li, LINE_NUMERIC)
    return (cm.where((F.col("col_a") == "l_extendedprice") & (F.col("col_b") != "l_extendedprice"))
              .select(F.col("col_b").alias("feature"), F.round("corr", 6).alias("corr"))
              .orderBy(F.desc("corr")))


# O4 ------------------------------------------------------------------------------------
TOP_N = 100


@query("top_n", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOP_N}""")
def top_n(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(TOP_N)


# U1 ------------------------------------------------------------------------------------
@query("union_all", """
SELECT o_orderkey, o_orderstatus, 'finished' AS part FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_orderstatus, 'other' AS part FROM orders WHERE o_orderstatus <> 'F'""")
def union_all(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    a = o.where(F.col("o_orderstatus") == "F").withColumn("part", F.lit("finished"))
    b = o.where(F.col("o_orderstatus") != "F").withColumn("part", F.lit("other"))
    return a.unionByName(b)


# U2 ------------------------------------------------------------------------------------
@query("drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


# U3 ------------------------------------------------------------------------------------
DIRECTION_SQL = """
SELECT user_id AS device, date_trunc('hour', ts) AS time,
       CASE WHEN event_type IN ('click', 'view') THEN '1' ELSE '3' END AS direction,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2, 3"""


@query("unpivot", f"""
WITH d AS ({DIRECTION_SQL}),
w AS (SELECT device, time, max(CASE WHEN direction = '1' THEN total END) AS d1,
             max(CASE WHEN direction = '3' THEN total END) AS d3 FROM d GROUP BY 1, 2)
SELECT device, time, '1' AS direction, d1 AS predictedValue FROM w
UNION ALL SELECT device, time, '3', d3 FROM w""")
def unpivot(spark, sf_dir):
    from tidemark.plans.catalog.aggregates import direction_wide
    wide = direction_wide(spark, sf_dir)
    return wide.unpivot(["device", "time"], ["1", "3"], "direction", "predictedValue")


# U4 ------------------------------------------------------------------------------------
_prio_cols = ", ".join(
    [f"max(CASE WHEN o_orderpriority = '{p}' THEN n END) AS \"{p}\"" for p in PRIORITIES])


@query("transpose_counts", f"""
WITH c AS (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderstatus AS field, {_prio_cols} FROM c GROUP BY 1""")
def transpose_counts(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderpriority", "o_orderstatus")
    statuses, priorities = (FE.fit_levels(o, c) for c in ("o_orderstatus", "o_orderpriority"))
    ct = TB.crosstab(o, "o_orderpriority", "o_orderstatus", statuses)
    return TB.transpose(ct, "o_orderpriority", statuses, priorities)
