"""Model queries in closed form, which SQL can follow number by number (2.11 with oracles).

They stand beside the fitted models of ``models.py``: the same tasks with models whose
coefficients are aggregates, or given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluate as EV
from tidemark.operators import exact_tree as XT
from tidemark.operators import linear as LN
from tidemark.operators import series as SR
from tidemark.operators import split as SP
from tidemark.plans.catalog.series import KEYS, ORDER, WIN, WINDOW_SIZE
from tidemark.plans.registry import query
from tidemark.plans.traffic import direction_of
from tidemark.functions import scalar as S
from tidemark.sources.tables import table

# M27, M26: a linear score with given coefficients -----------------------------------------
_SCORE_SQL = """s AS (SELECT doc_id, lang, source, n_chars,
       CAST(n_chars AS DOUBLE) / 1000 - 1.5 + CASE WHEN lang = 'en' THEN 0.25 ELSE 0 END AS score
       FROM documents)"""


def _linear_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    score = F.col("n_chars").cast("double") / 1000 - 1.5 + F.when(F.col("lang") == "en", 0.25).otherwise(0.0)
    return d.withColumn("score", score).withColumn("prediction", (F.col("score") > 0).cast("int"))


@query("linear_batch_score", f"""
WITH {_SCORE_SQL}
SELECT doc_id, round(score, 6) AS score, CAST(score > 0 AS INTEGER) AS prediction FROM s""")
def linear_batch_score(spark, sf_dir):
    return _linear_score(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "prediction")


@query("linear_bad_cases", f"""
WITH {_SCORE_SQL}
SELECT s.doc_id, s.lang, s.source, s.n_chars, CAST(s.score > 0 AS INTEGER) AS prediction,
       CAST(l.quality AS INTEGER) AS quality
FROM s JOIN labels l USING (doc_id) WHERE CAST(s.score > 0 AS INTEGER) <> l.quality""")
def linear_bad_cases(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    j = _linear_score(spark, sf_dir).join(lab, "doc_id").where("prediction <> quality")
    return j.select("doc_id", "lang", "source", "n_chars", "prediction", "quality")


# M5: leave-one-out ridge --------------------------------------------------------------------
ALPHAS = (0.1, 1.0, 10.0)
_alphas = ", ".join(f"({a})" for a in ALPHAS)


@query("ridge_leave_one_out", f"""
WITH d AS (SELECT value AS y, CAST(hour(ts) AS DOUBLE) AS x FROM events),
m AS (SELECT COUNT(*) AS n, avg(x) AS mx, avg(y) AS my FROM d),
c AS (SELECT n, mx, my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy
      FROM d, m GROUP BY 1, 2, 3),
a AS (SELECT CAST(alpha AS DOUBLE) AS alpha, n, mx, my, sxx + alpha AS den, sxy / (sxx + alpha) AS b
      FROM c, (VALUES {_alphas}) v(alpha))
SELECT alpha, COUNT(*) AS n,
       round(avg(pow((y - my - b * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / den), 2)), 6) AS loo_mse
FROM d, a GROUP BY 1""")
def ridge_leave_one_out(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("value").alias("y"), F.hour("ts").cast("double").alias("x"))
    out = EV.ridge_leave_one_out(ev, ["x"], "y", ALPHAS)
    return out.select("alpha", "n", F.round("loo_mse", 6).alias("loo_mse"))


# E7: ridge imputation on one feature --------------------------------------------------------
@query("impute_ridge_one_feature", """
WITH d AS (SELECT event_id, CAST(hour(ts) AS DOUBLE) AS x, CASE WHEN value > 10 THEN value END AS gv FROM events),
m AS (SELECT avg(x) AS mx, avg(gv) AS my FROM d WHERE gv IS NOT NULL),
c AS (SELECT mx, my, sum((x - mx) * (gv - my)) / (sum((x - mx) * (x - mx)) + 1.0) AS b
      FROM d, m WHERE gv IS NOT NULL GROUP BY 1, 2)
SELECT event_id, round(coalesce(gv, abs(my + b * (x - mx))), 6) AS gv_filled FROM d, c""")
def impute_ridge_one_feature(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.hour("ts").cast("double").alias("x"), S.gapped("value").alias("gv"))
    coef, intercept, _ = EV.ridge_solve(EV.ridge_state(ev, ["x"], "gv"), 1.0)
    filled = F.coalesce("gv", F.abs(EV.ridge_predict(["x"], coef, intercept)))
    return ev.select("event_id", F.round(filled, 6).alias("gv_filled"))


# M15, M23: a model per device and lane -------------------------------------------------------
_LANE_SQL = """t AS (SELECT user_id, event_type, ts, value, CAST(hour(ts) AS DOUBLE) AS x,
       CAST(row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1
            < ceil(COUNT(*) OVER () * 0.25) AS INTEGER) AS is_test FROM events),
f AS (SELECT user_id, event_type, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, avg(value) AS m
      FROM t WHERE is_test = 0 GROUP BY 1, 2)"""


def _lanes(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value",
                                               F.hour("ts").cast("double").alias("x"))
    return SP.train_test_split(ev, "event_id", 0.25)


@query("lane_linear_metrics", f"""
WITH {_LANE_SQL},
p AS (SELECT user_id, event_type, value, coalesce(CASE WHEN isfinite(b) THEN a + b * x END, m) AS p
      FROM t LEFT JOIN f USING (user_id, event_type) WHERE is_test = 1)
SELECT user_id, event_type, COUNT(*) AS n, round(avg((value - p) * (value - p)) + 1e-7, 4) AS mse,
       round(avg(abs(value - p)) + 1e-7, 4) AS mae
FROM p GROUP BY 1, 2""")
def lane_linear_metrics(spark, sf_dir):
    out = EV.group_linear_metrics(_lanes(spark, sf_dir), "value", "x", ["user_id", "event_type"], "is_test")
    # money-like values tie at the last place; the nudge rounds both engines the same way
    return out.select("user_id", "event_type", "n",
                      *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mse", "mae")])


# M16: directions from a linear model per lane --------------------------------------------------
_LANE_CODE = {"click": 11, "view": 12, "purchase": 31, "signup": 32, "error": 33}
_code = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _LANE_CODE.items())


@query("predict_direction_linear", f"""
WITH {_LANE_SQL.split('f AS (')[0].rstrip().rstrip(',')},
f AS (SELECT event_type, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM t WHERE is_test = 0 GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS Jtstation,
       CASE WHEN CASE event_type {_code} END < 30 THEN '1' ELSE '3' END AS direction,
       CAST(x AS INTEGER) AS hour, round(sum(a + b * x), 4) AS predictedValue
FROM t JOIN f USING (event_type) GROUP BY 1, 2, 3""")
def predict_direction_linear(spark, sf_dir):
    ev = _lanes(spark, sf_dir)
    fit = EV.group_ols(ev.where("is_test = 0"), "value", "x", ["event_type"])
    scored = ev.join(F.broadcast(fit) if fit.count() <= len(_LANE_CODE) else fit, "event_type")
    lane = S.dict_map("event_type", _LANE_CODE)
    return scored.withColumn("lane", lane).groupBy(
        F.col("user_id").cast("string").alias("Jtstation"), direction_of("lane").alias("direction"),
        F.col("x").cast("int").alias("hour")).agg(
        F.round(F.sum(F.col("intercept") + F.col("slope") * F.col("x")), 4).alias("predictedValue"))


# W6 in array form --------------------------------------------------------------------------------
@query("window_values", f"""
SELECT event_id, user_id, event_type,
       array_to_string(list(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)) OVER
         ({WIN} ROWS BETWEEN {WINDOW_SIZE - 1} PRECEDING AND CURRENT ROW), ',') AS win
FROM events""")
def window_values(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    res = SR.sliding_window(ev, KEYS, ORDER, "value", size=WINDOW_SIZE)
    text = F.transform("win_values", lambda v: v.cast("decimal(18,2)").cast("string"))
    return res.select("event_id", "user_id", "event_type", F.array_join(text, ",").alias("win"))


# A20: mean over the fold models ------------------------------------------------------------------
@query("oof_test_mean", """
WITH r AS (SELECT event_id, event_type, value, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
s AS (SELECT event_id, event_type, value,
             CAST((row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) - 1) % 5 AS INTEGER) AS fold
      FROM r WHERE event_id % 10 <> 0),
k AS (SELECT event_type, g.fold, avg(value) AS m FROM s JOIN range(5) g(fold) ON s.fold <> g.fold GROUP BY 1, 2)
SELECT t.event_id, t.event_type, round(avg(k.m), 6) AS oof
FROM r t JOIN k USING (event_type) WHERE t.event_id % 10 = 0 GROUP BY 1, 2""")
def oof_test_mean(spark, sf_dir):
    """Held-out rows get the mean of the five fold models, each the group mean of its fold's
    training rows."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    train = SP.stratified_kfold(ev.where("event_id % 10 <> 0"), "event_id", "event_type", 5)
    folds = [F.avg(F.when(F.col("fold") != f, F.col("value"))) for f in range(5)]
    model = train.groupBy("event_type").agg((sum(folds[1:], folds[0]) / 5).alias("_m"))
    test = ev.where("event_id % 10 = 0")
    return test.join(model, "event_type").select("event_id", "event_type", F.round("_m", 6).alias("oof"))


# M3, M1: a tree over every different value -------------------------------------------------------
TREE_FEATURES = ["n_chars", "n_words", "n_lines", "digits"]
_TREE_PARTS = ["n_chars", "len(regexp_extract_all(text, '[^\\t\\n\\v\\f\\r ]+'))",
               "len(text) - len(replace(text, chr(10), '')) + 1", "len(text) - len(regexp_replace(text, '[0-9]', '', 'g'))"]
_PURE = "(CAST({o} AS DOUBLE) * {o} + CAST({n} - {o} AS DOUBLE) * ({n} - {o})) / {n}"


def _tree_level(rows: str, out: str) -> str:
    """SQL of the best cut of every node in ``rows`` (node, y, x): the list of features is x."""
    before = _PURE.format(o="ob", n="b")
    after = _PURE.format(o="(oa - ob)", n="(a - b)")
    whole = _PURE.format(o="oa", n="a")
    return f"""{out}_c AS (SELECT node, g.f, CAST(x[g.f + 1] AS DOUBLE) AS v, count(*) AS w, sum(y) AS o
  FROM {rows}, range({len(TREE_FEATURES)}) g(f) GROUP BY ALL),
{out}_s AS (SELECT node, f, v, lag(v) OVER q AS u, sum(w) OVER q - w AS b, sum(o) OVER q - o AS ob,
    sum(w) OVER p AS a, sum(o) OVER p AS oa FROM {out}_c
  WINDOW q AS (PARTITION BY node, f ORDER BY v), p AS (PARTITION BY node, f)),
{out}_g AS (SELECT node, f, u + (v - u) / 2 AS cut, v, round({before} + {after} - {whole}, {XT.PLACES}) AS gain
  FROM {out}_s WHERE b > 0),
{out} AS (SELECT node, f, cut, gain FROM {out}_g WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)"""


_LEVELS = f"""r0 AS (SELECT doc_id, 0 AS node, CAST(quality AS INTEGER) AS y, [{", ".join(f"CAST({p} AS DOUBLE)" for p in _TREE_PARTS)}] AS x
  FROM documents JOIN labels USING (doc_id)),
{_tree_level("r0", "s0")},
r1 AS (SELECT doc_id, CASE WHEN x[f + 1] <= cut THEN 1 ELSE 2 END AS node, y, x FROM r0 JOIN s0 USING (node)),
{_tree_level("r1", "s1")},
r2 AS (SELECT doc_id, 2 * node + CASE WHEN x[f + 1] <= cut THEN 1 ELSE 2 END AS node, y, x FROM r1 JOIN s1 USING (node))"""


def _tree_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_count("text", F.lit(r"[^\t\n\x0B\f\r ]+")).cast("double").alias("n_words"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return d.join(lab, "doc_id")


@query("tree_nodes_exact", f"""
WITH {_LEVELS},
n AS (SELECT node, count(*) AS n, sum(y) AS ones FROM (SELECT node, y FROM r0 UNION ALL SELECT node, y FROM r1
      UNION ALL SELECT node, y FROM r2) GROUP BY node),
s AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)
SELECT CAST(n.node AS INTEGER) AS node, n.n, CAST(n.ones AS BIGINT) AS ones, CAST(s.f AS INTEGER) AS feature,
       s.cut, round(s.gain, 6) AS gain
FROM n LEFT JOIN s USING (node)""")
def tree_nodes_exact(spark, sf_dir):
    """A tree of depth 2: counts, features and cuts of all its nodes."""
    rows = _tree_rows(spark, sf_dir).checkpoint(eager=True)
    tree = XT.exact_tree(rows, TREE_FEATURES, max_depth=2)
    data = [(i, n, o, f, c, None if g is None else round(g, 6)) for i, (n, o, g, f, c) in sorted(tree.nodes.items())]
    return spark.createDataFrame(data, "node int, n long, ones long, feature int, cut double, gain double")


@query("tree_scores_exact", f"""
WITH {_LEVELS},
e AS (SELECT doc_id, node, y FROM r2 UNION ALL SELECT doc_id, node, y FROM r1 WHERE node NOT IN (SELECT node FROM s1)
      UNION ALL SELECT doc_id, node, y FROM r0 WHERE node NOT IN (SELECT node FROM s0))
SELECT doc_id, round(avg(y) OVER (PARTITION BY node), 6) AS probability_1,
       CAST(avg(y) OVER (PARTITION BY node) > 0.5 AS DOUBLE) AS prediction FROM e""")
def tree_scores_exact(spark, sf_dir):
    """The labelled documents scored by that tree."""
    rows = _tree_rows(spark, sf_dir).checkpoint(eager=True)
    out = XT.exact_tree(rows, TREE_FEATURES, max_depth=2).transform(rows)
    return out.select("doc_id", F.round("probability_1", 6).alias("probability_1"), "prediction")


# M15, M2: a model of several features per device and lane -----------------------------------------
@query("lane_least_squares", """
WITH d AS (SELECT user_id % 7 AS device, event_type, value AS y, CAST(hour(ts) AS DOUBLE) AS a,
                  CAST(json_extract(props, '$.k') AS DOUBLE) AS b FROM events),
m AS (SELECT device, event_type, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM d GROUP BY ALL),
c AS (SELECT device, event_type, n, my, ma, mb, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab,
             sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_
      FROM d JOIN m USING (device, event_type) GROUP BY ALL),
s AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb FROM c)
SELECT device, event_type, n, round(ca, 6) AS coef_hour, round(cb, 6) AS coef_k,
       round(my - ca * ma - cb * mb, 6) AS intercept FROM s""")
def lane_least_squares(spark, sf_dir):
    """Two features for every (device, lane) at once, solved from the groups' sums."""
    ev = table(spark, sf_dir, "events").select(
        F.expr("user_id % 7").alias("device"), "event_type", "value", F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))
    out = LN.group_least_squares(ev, "value", ["hour", "k"], ["device", "event_type"])
    at = lambda i: F.round(F.get("coef", F.lit(i)), 6)
    return out.select("device", "event_type", "n", at(0).alias("coef_hour"), at(1).alias("coef_k"),
                      F.round("intercept", 6).alias("intercept"))


# M18, M20: a cross-validated grid of penalties and feature lists ------------------------------------
GRID_ALPHAS = (10.0, 1000.0, 100000.0)
GRID_FEATURES = {"hour": [0], "k": [1], "hour,k": [0, 1]}
_grid = ", ".join(f"({i}, {a}, '{names}', {int(0 in use)}, {int(1 in use)})" for i, (a, names, use) in enumerate(
    (a, names, use) for a in GRID_ALPHAS for names, use in GRID_FEATURES.items()))


@query("ridge_grid_folds", f"""
WITH d AS (SELECT event_id, value AS y, CAST(hour(ts) AS DOUBLE) AS a, CAST(json_extract(props, '$.k') AS DOUBLE) AS b,
                  CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) - 1)
                       % 5 AS INTEGER) AS fold FROM events),
t AS (SELECT g.fold, y, a, b FROM d JOIN range(5) g(fold) ON d.fold <> g.fold),
m AS (SELECT fold, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM t GROUP BY fold),
c AS (SELECT fold, my, ma, mb, sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb,
             sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_ FROM t JOIN m USING (fold) GROUP BY ALL),
g AS (SELECT *, aa + alpha AS pa, bb + alpha AS pb
      FROM c, (VALUES {_grid}) v(map, alpha, features, has_a, has_b)),
s AS (SELECT map, CAST(alpha AS DOUBLE) AS alpha, features, fold, my, ma, mb,
             CASE WHEN has_a = 0 THEN 0 WHEN has_b = 0 THEN ay / pa ELSE (pb * ay - ab * by_) / (pa * pb - ab * ab) END AS ca,
             CASE WHEN has_b = 0 THEN 0 WHEN has_a = 0 THEN by_ / pb ELSE (pa * by_ - ab * ay) / (pa * pb - ab * ab) END AS cb
      FROM g),
e AS (SELECT map, alpha, features, s.fold, avg(pow(y - my - ca * (a - ma) - cb * (b - mb), 2)) AS mse
      FROM s JOIN d ON d.fold = s.fold GROUP BY ALL),
o AS (SELECT map, avg(mse) AS mean_mse FROM e GROUP BY map),
w AS (SELECT map FROM o ORDER BY round(mean_mse, {LN.PLACES}), map LIMIT 1)
SELECT alpha, features, fold, round(mse, 6) AS mse, round(mean_mse, 6) AS mean_mse, map IN (SELECT map FROM w) AS is_best
FROM e JOIN o USING (map)""")
def ridge_grid_folds(spark, sf_dir):
    """Nine ridges by five folds from one pair of passes: every fold's error, the mean, and the
    first best map."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.array(F.hour("ts").cast("double"), F.get_json_object("props", "$.k").cast("double"),
                                          F.col("value").cast("double")).alias("row"))
    dealt = SP.stratified_kfold(ev, "event_id", "event_type", 5)
    maps = [(a, names, use) for a in GRID_ALPHAS for names, use in GRID_FEATURES.items()]
    found = LN.ridge_grid_cv(dealt, "row", 3, [(a, use) for a, _, use in maps], "fold", 5)
    out = [(a, names, f, round(float(found.scores[i, f]), 6), round(float(found.means[i]), 6), i == found.best)
           for i, (a, names, _) in enumerate(maps) for f in range(5)]
    return spark.createDataFrame(out, "alpha double, features string, fold int, mse double, mean_mse double, is_best boolean")
