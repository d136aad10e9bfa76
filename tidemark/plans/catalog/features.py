"""Feature building and imputation by statistics (2.9, SQL-checkable part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as FE
from tidemark.plans.catalog.relational import PRIORITIES
from tidemark.plans.registry import query
from tidemark.sources.tables import table


# E1 ------------------------------------------------------------------------------------
_oh_sql = ", ".join(
    f"CAST(coalesce(o_orderpriority = '{p}', false) AS INTEGER) AS \"o_orderpriority_{p}\""
    for p in PRIORITIES)


@query("one_hot", f"SELECT o_orderkey, {_oh_sql} FROM orders")
def one_hot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    levels = FE.fit_levels(o, "o_orderpriority")
    return FE.one_hot(o, "o_orderpriority", levels, drop_source=True)


# E2 ------------------------------------------------------------------------------------
@query("label_encode", """
SELECT o_orderkey,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS priority_code,
       CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS DOUBLE) AS ticket_code
FROM orders""")
def label_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_custkey").cast("string").alias("ticket"))
    res = FE.label_encode(o, FE.fit_label_dictionary(o, "o_orderpriority"), "o_orderpriority",
                          out="priority_code")
    res = FE.label_encode(res, FE.fit_label_dictionary(o, "ticket"), "ticket",
                          out="ticket_code")
    return res.select("o_orderkey", "priority_code", "ticket_code")


# E3 ------------------------------------------------------------------------------------
@query("standardize", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / (CASE WHEN sd > 0 THEN sd ELSE 1 END), 6)
         AS o_totalprice_scaled
FROM orders, s""")
def standardize(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stats = FE.fit_standard_scaler(o, ["o_totalprice"])
    res = FE.standardize(o, stats)
    return res.select("o_orderkey", F.round("o_totalprice_scaled", 6).alias("o_totalprice_scaled"))


# E4 ------------------------------------------------------------------------------------
_fd_sql = ", ".join(
    f"CAST(o_orderpriority = '{p}' AS DOUBLE) AS \"C(o_orderpriority)[T.{p}]\""
    for p in PRIORITIES[1:])


@query("formula_design", f"""
SELECT o_orderkey, 1.0 AS Intercept, {_fd_sql}, o_totalprice FROM orders
WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL""")
def formula_design(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    levels = {"o_orderpriority": FE.fit_levels(o, "o_orderpriority")}
    return FE.formula_design(o, ["o_orderpriority"], ["o_totalprice"], levels,
                             keep=["o_orderkey"])


# E9 ------------------------------------------------------------------------------------
GAP_PRICE = 100000.0


@query("impute_group_stat", f"""
WITH g AS (SELECT o_orderkey, o_orderpriority,
                  CASE WHEN o_totalprice > {GAP_PRICE} THEN o_totalprice END AS price FROM orders),
m AS (SELECT o_orderpriority, median(price) AS med, avg(price) AS mean FROM g GROUP BY 1)
SELECT o_orderkey, round(coalesce(price, med), 6) AS price_median_filled,
       round(coalesce(price, mean), 6) AS price_mean_filled
FROM g JOIN m USING (o_orderpriority)""")
def impute_group_stat(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.select("o_orderkey", "o_orderpriority",
                 F.when(F.col("o_totalprice") > GAP_PRICE, F.col("o_totalprice")).alias("price"))
    med = FE.fit_group_stat(g, "price", ["o_orderpriority"], "median")
    mean = FE.fit_group_stat(g, "price", ["o_orderpriority"], "mean")
    r = FE.impute_group_stat(g, "price", med, ["o_orderpriority"], out="price_median_filled")
    r = FE.impute_group_stat(r, "price", mean, ["o_orderpriority"], out="price_mean_filled")
    return r.select("o_orderkey", F.round("price_median_filled", 6).alias("price_median_filled"),
                    F.round("price_mean_filled", 6).alias("price_mean_filled"))


# E5 ------------------------------------------------------------------------------------
from tidemark.functions import scalar as S  # noqa: E402
from tidemark.operators import split as SP  # noqa: E402
from tidemark.plans import cleaning as CL  # noqa: E402
from tidemark.plans.catalog.relational import _fold_sql, _title_sql  # noqa: E402

_TITLE_WORD = {"BUILDING": "Mr.", "AUTOMOBILE": "Mrs.", "MACHINERY": "Master",
               "HOUSEHOLD": "Miss"}


def passengers(spark, sf_dir):
    """Passenger-shaped rows derived from orders joined to their customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    word = S.case_map("c_mktsegment", {v: [k] for k, v in _TITLE_WORD.items()}, "Dr.")
    nk = F.col("c_nationkey")
    return j.select(
        F.col("o_orderkey").alias("PassengerId"),
        (F.col("o_orderstatus") == "F").cast("int").alias("Survived"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("Pclass"),
        F.concat_ws("", "c_name", F.lit(", "), word, F.lit(" "), "o_orderpriority").alias("Name"),
        F.when(nk % 2 == 0, F.lit("male")).otherwise(F.lit("female")).alias("Sex"),
        F.when(F.col("o_totalprice") < 50000, F.lit(None).cast("double"))
         .otherwise((F.col("o_totalprice") % 7000) / 100).alias("Age"),
        (nk % 4).alias("SibSp"), (F.col("o_custkey") % 3).cast("int").alias("Parch"),
        F.col("o_custkey").cast("string").alias("Ticket"),
        F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000)
         .alias("Fare"),
        F.when(F.col("c_acctbal") > 9000, F.lit(None).cast("string"))
         .when(nk % 3 == 0, F.lit("S")).when(nk % 3 == 1, F.lit("C")).otherwise(F.lit("Q"))
         .alias("Embarked"))


_word_sql = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLE_WORD.items())


def _dict_sql(name, col):
    return (f"d_{name} AS (SELECT {col} AS v, dense_rank() OVER (ORDER BY {col}) - 1 AS code "
            f"FROM (SELECT DISTINCT {col} FROM b4 WHERE NOT is_test AND {col} IS NOT NULL))")


def _scaled_sql(col, i):
    return f"round(({col} - m{i}) / (CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END), 6)"


CLEAN_SQL = f"""
WITH base AS (
  SELECT o.o_orderkey AS PassengerId, CAST(o.o_orderstatus = 'F' AS INTEGER) AS Survived,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS Pclass,
         c.c_name || ', ' || CASE c.c_mktsegment {_word_sql} ELSE 'Dr.' END || ' '
           || o.o_orderpriority AS Name,
         CASE WHEN c.c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END AS Sex,
         CASE WHEN o.o_totalprice < 50000 THEN NULL ELSE (o.o_totalprice % 7000) / 100 END AS Age,
         c.c_nationkey % 4 AS SibSp, CAST(o.o_custkey % 3 AS INTEGER) AS Parch,
         CAST(o.o_custkey AS VARCHAR) AS Ticket,
         CASE WHEN c.c_acctbal < 0 THEN 0.0 ELSE o.o_totalprice / 1000 END AS Fare,
         CASE WHEN c.c_acctbal > 9000 THEN NULL WHEN c.c_nationkey % 3 = 0 THEN 'S'
              WHEN c.c_nationkey % 3 = 1 THEN 'C' ELSE 'Q' END AS Embarked
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
sp AS (SELECT *, (row_number() OVER (ORDER BY md5(CAST(PassengerId AS VARCHAR)), PassengerId) - 1)
                 < ceil(COUNT(*) OVER () * 0.25) AS is_test FROM base),
b0 AS (SELECT *, {_title_sql('Name')} AS RawTitle FROM sp),
b1 AS (SELECT *, nullif(Fare, 0) AS Fare0, {_fold_sql('RawTitle', "lower(Sex) = 'male'")} AS Title,
              SibSp + Parch AS Family_Size, coalesce(Embarked, 'S') AS Emb,
              CAST(length(Name) AS INTEGER) AS Name_length FROM b0),
fm AS (SELECT Pclass, median(Fare0) AS fmed FROM b1 WHERE NOT is_test GROUP BY 1),
b2 AS (SELECT b1.*, coalesce(Fare0, fm.fmed) AS Fare1 FROM b1 LEFT JOIN fm USING (Pclass)),
am AS (SELECT Title, avg(Age) AS amean FROM b2 WHERE NOT is_test GROUP BY 1),
b3 AS (SELECT b2.*, coalesce(Age, am.amean) AS AgeFill FROM b2 LEFT JOIN am USING (Title)),
b4 AS (SELECT *, CASE WHEN AgeFill IS NULL THEN NULL WHEN AgeFill <= 10 THEN 'child'
                      WHEN AgeFill <= 30 THEN 'adult' WHEN AgeFill <= 60 THEN 'senior'
                      ELSE 'aged' END AS AgeCat,
              Fare1 / (Family_Size + 1) AS FPP, AgeFill * Pclass AS AgeClass,
              Pclass * (Fare1 / (Family_Size + 1)) AS ClassFare, AgeFill * AgeFill AS AgeSqure,
              CASE WHEN Fare1 / (Family_Size + 1) < 8 THEN 'Low'
                   WHEN Fare1 / (Family_Size + 1) >= 8 THEN 'High' END AS HighLow
       FROM b3),
{_dict_sql('sex', 'Sex')}, {_dict_sql('title', 'Title')}, {_dict_sql('hl', 'HighLow')},
{_dict_sql('age', 'AgeCat')}, {_dict_sql('emb', 'Emb')}, {_dict_sql('tk', 'Ticket')},
e AS (SELECT b4.*, CAST(a.code AS DOUBLE) AS SexC, CAST(b.code AS DOUBLE) AS TitleC,
             CAST(c.code AS DOUBLE) AS HighLowC, CAST(d.code AS DOUBLE) AS AgeCatC,
             CAST(f.code AS DOUBLE) AS EmbC, CAST(g.code AS DOUBLE) AS TicketC
      FROM b4 LEFT JOIN d_sex a ON b4.Sex = a.v LEFT JOIN d_title b ON b4.Title = b.v
      LEFT JOIN d_hl c ON b4.HighLow = c.v LEFT JOIN d_age d ON b4.AgeCat = d.v
      LEFT JOIN d_emb f ON b4.Emb = f.v LEFT JOIN d_tk g ON b4.Ticket = g.v),
st AS (SELECT avg(FPP) AS m2, stddev_pop(FPP) AS s2, avg(TicketC) AS m3, stddev_pop(TicketC) AS s3,
              avg(ClassFare) AS m5, stddev_pop(ClassFare) AS s5,
              avg(AgeSqure) AS m6, stddev_pop(AgeSqure) AS s6
       FROM e WHERE NOT is_test)
SELECT PassengerId, SexC AS Sex, AgeCatC AS AgeCat, {_scaled_sql('FPP', 2)} AS Fare_Person_scaled,
       Family_Size, {_scaled_sql('AgeSqure', 6)} AS Age_suqre_scaled,
       {_scaled_sql('TicketC', 3)} AS Ticket_scaled, EmbC AS Embarked,
       round(AgeClass, 6) AS AgeClass, Name_length, {_scaled_sql('ClassFare', 5)} AS Class_scaled,
       TitleC AS Title, round(Fare1, 6) AS Fare, Pclass
FROM e, st WHERE is_test"""


@query("clean_features", CLEAN_SQL)
def clean_features(spark, sf_dir):
    p = SP.train_test_split(passengers(spark, sf_dir), "PassengerId", 0.25)
    state = CL.fit(p.where("is_test = 0"))
    out = CL.transform(p.where("is_test = 1"), state)
    dbl = ["Fare_Person_scaled", "Age_suqre_scaled", "Ticket_scaled", "AgeClass", "Class_scaled",
           "Fare"]
    return out.select(*[F.round(c, 6).alias(c) if c in dbl else F.col(c) for c in out.columns])
