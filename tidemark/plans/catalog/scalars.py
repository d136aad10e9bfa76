"""Scalar functions (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.plans.catalog.relational import _title_sql
from tidemark.plans.registry import query
from tidemark.sources.tables import table


# F1 ------------------------------------------------------------------------------------
@query("first_substring_match", f"""
SELECT doc_id, {_title_sql('text')} AS title FROM documents""")
def first_substring_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.first_substring("text", S.TITLE_SEARCH_ORDER).alias("title"))


PART_WORDS = ["red", "blue", "small", "gear", "ring"]


@query("first_substring_part", "SELECT p_partkey, " + "coalesce(" + ", ".join(
    f"CASE WHEN instr(p_name, '{w}') > 0 THEN '{w}' END" for w in PART_WORDS)
    + ") AS word FROM part")
def first_substring_part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.first_substring("p_name", PART_WORDS).alias("word"))


# F3 ------------------------------------------------------------------------------------
@query("strip_units", """
SELECT event_id,
       CAST(regexp_replace(CAST(value AS VARCHAR) || '米', '[^0-9.\\-]', '', 'g') AS DOUBLE)
         AS traffic,
       CAST(regexp_replace(json_extract_string(props, '$.k') || '%', '[^0-9.\\-]', '', 'g')
            AS INTEGER) AS occupancy
FROM events""")
def strip_units(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw_t = F.concat(F.col("value").cast("string"), F.lit("米"))
    raw_o = F.concat(F.get_json_object("props", "$.k"), F.lit("%"))
    return ev.select("event_id", S.strip_units(raw_t).alias("traffic"),
                     S.strip_units(raw_o, "int").alias("occupancy"))


# F4 ------------------------------------------------------------------------------------
@query("path_pieces", """
SELECT page_id, string_split(url, '/')[-1] AS last_piece, string_split(url, '/')[3] AS host,
       split_part(split_part(string_split(url, '/')[-1], '?', 1), '#', 1) AS stem
FROM pages""")
def path_pieces(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    last = S.path_piece("url", "/", -1)
    stem = F.substring_index(F.substring_index(last, "?", 1), "#", 1)
    return p.select("page_id", last.alias("last_piece"),
                    S.path_piece("url", "/", 3).alias("host"), stem.alias("stem"))


# F5 ------------------------------------------------------------------------------------
@query("format_key", """
SELECT event_id, CAST(user_id AS VARCHAR) || '_' || event_type AS series_key FROM events""")
def format_key(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.format_key("user_id", "event_type").alias("series_key"))


# F6 ------------------------------------------------------------------------------------
@query("parse_timestamp", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text,
       strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed,
       CAST(NULL AS TIMESTAMP) AS bad_parsed
FROM events""")
def parse_timestamp(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.select("event_id", text.alias("time_text"),
                     S.parse_timestamp(text).alias("parsed"),
                     S.parse_timestamp(F.concat(text, F.lit("x"))).alias("bad_parsed"))


# F10 -----------------------------------------------------------------------------------
@query("absolute_value", "SELECT c_custkey, abs(c_acctbal) AS acctbal_abs FROM customer")
def absolute_value(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.abs("c_acctbal").alias("acctbal_abs"))


# F11 -----------------------------------------------------------------------------------
@query("zero_to_null", """
SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount FROM lineitem""")
def zero_to_null(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.zero_to_null("l_discount").alias("discount"))


# F12 -----------------------------------------------------------------------------------
@query("fill_constant", """
SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), 0.05) AS discount,
       coalesce(CASE WHEN l_tax > 0.04 THEN 'taxed' END, 'S') AS tax_class
FROM lineitem""")
def fill_constant(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.zero_to_null("l_discount").alias("discount"),
        F.when(F.col("l_tax") > 0.04, F.lit("taxed")).alias("tax_class"))
    return li.fillna({"discount": 0.05, "tax_class": "S"})


# F13 -----------------------------------------------------------------------------------
@query("bin_numeric", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity <= 10 THEN 'child'
            WHEN l_quantity <= 30 THEN 'adult' WHEN l_quantity <= 60 THEN 'senior'
            ELSE 'aged' END AS quantity_bin,
       CASE WHEN l_extendedprice / 1000 <= 10 THEN 'child'
            WHEN l_extendedprice / 1000 <= 30 THEN 'adult'
            WHEN l_extendedprice / 1000 <= 60 THEN 'senior' ELSE 'aged' END AS price_bin
FROM lineitem""")
def bin_numeric(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.bin_right_closed("l_quantity").alias("quantity_bin"),
                     S.bin_right_closed(F.col("l_extendedprice") / 1000).alias("price_bin"))


# F14 -----------------------------------------------------------------------------------
@query("threshold_flag", """
SELECT event_id, CASE WHEN gv < 20 THEN 'Low' WHEN gv >= 20 THEN 'High' END AS level
FROM (SELECT event_id, CASE WHEN value > 10 THEN value END AS gv FROM events)""")
def threshold_flag(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.threshold_flag(S.gapped("value"), 20.0).alias("level"))


# F15 -----------------------------------------------------------------------------------
@query("presence_flag", """
SELECT event_id, CASE WHEN value > 10 THEN 'Yes' ELSE 'No' END AS has_value FROM events""")
def presence_flag(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", S.presence_flag(S.gapped("value")).alias("has_value"))
