"""Model fits, selection and scoring (2.11 rows-only part; S7; E6-E8; K6 model form; K7).

Random streams of the analysed libraries cannot be reproduced, so these queries are
checked by properties in ``tests/`` (beats a trivial baseline on separable data, same
seed -> same output, save/load -> same predictions) rather than against SQL. Forest and
boosting sizes are parameters; the catalogue uses small ones so that every query runs in
seconds at the test scale.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import evaluate as EV
from tidemark.operators import forest_grid as FG
from tidemark.operators import linear as LN
from tidemark.operators import models as MD
from tidemark.operators import split as SP
from tidemark.plans import stacking as ST
from tidemark.plans import traffic as TR
from tidemark.plans.catalog.scans import station_readings
from tidemark.plans.registry import query
from tidemark.session import drop_path, scratch_path
from tidemark.sources import csv as C
from tidemark.sources.tables import table

DOC_FEATURES = ["n_chars", "n_words", "n_lines", "digits", "uppers",
                "lang_en", "lang_fr", "lang_de", "lang_es"]
EVENT_FEATURES = ["hour", "dayofweek", "k", "lane"]
N_TREES = 500        # classification forests
TRAFFIC_TREES = 30   # traffic forests, per device
ROUNDS = 50          # boosting rounds alone; the analysed code runs 500 to 2000
BASE_SIZE = 500      # trees or rounds of each of a stack's ensembles
META_ROUNDS = 3000   # boosting rounds of a stack's second level
K = 5


def doc_features(spark, sf_dir):
    """Numeric features of every document (whole texts), one row per doc."""
    d = table(spark, sf_dir, "documents").fillna({"text": "", "n_chars": 0, "lang": ""})
    return d.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("n_words"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("double").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^0-9]+", "")).cast("double").alias("digits"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("double").alias("uppers"),
        *[(F.col("lang") == lg).cast("double").alias(f"lang_{lg}") for lg in ["en", "fr", "de", "es"]])


def labelled_docs(spark, sf_dir):
    """Labelled documents with features, a stratified 5-fold column and a 25 % test flag."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    # Folds and test rows follow the same seeded order: one ranking of (id, label) gives both.
    ranked = SP.ranked(lab, "doc_id", groups=["label"])
    flagged = ranked.select("doc_id", "label", F.pmod("_pos", F.lit(K)).cast("int").alias("fold"),
                            (F.col("_pos") < F.ceil(F.col("_n") * F.lit(0.25))).cast("int").alias("is_test"))
    j = doc_features(spark, sf_dir).join(flagged, "doc_id", "inner")
    return MD.training_table(MD.assemble(j, DOC_FEATURES))


def event_frame(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    lane = S.dict_map("event_type", {"click": 11, "view": 12, "purchase": 31, "signup": 32,
                                     "error": 33}).cast("double")
    return ev.select("event_id", "user_id", "event_type", "ts",
                     F.hour("ts").cast("double").alias("hour"),
                     F.weekday("ts").cast("double").alias("dayofweek"),
                     F.get_json_object("props", "$.k").cast("double").alias("k"),
                     lane.alias("lane"), F.col("value").alias("label"),
                     S.gapped("value").alias("gv"))


def _p1(col="probability"):
    return vector_to_array(F.col(col))[1]


def _scored(model, df, id_col="doc_id"):
    out = model.transform(df)
    cols = [id_col, "label", F.col("prediction").cast("double").alias("prediction")]
    if "probability" in out.columns:
        cols.append(_p1().alias("p1"))
    return out.select(*cols)


# P15 -----------------------------------------------------------------------------------
_parts = ["n_chars", "len(regexp_extract_all(text, '[^\\t\\n\\v\\f\\r ]+'))",
          "len(text) - len(replace(text, chr(10), '')) + 1", "len(text) - len(regexp_replace(text, '[0-9]', '', 'g'))",
          "len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))",
          *[f"CAST(lang = '{lg}' AS INTEGER)" for lg in ("en", "fr", "de", "es")]]


@query("assemble_features", f"""
SELECT doc_id, CAST(quality AS DOUBLE) AS label,
       concat_ws(',', {', '.join(f"CAST({p} AS VARCHAR)" for p in _parts)}) AS features
FROM documents JOIN labels USING (doc_id)""")
def assemble_features(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    counts = F.transform(vector_to_array("features"), lambda x: x.cast("long").cast("string"))
    return d.select("doc_id", "label", F.array_join(counts, ",").alias("features"))


# M1 ------------------------------------------------------------------------------------
@query("rf_classifier")
def rf_classifier(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    m = MD.rf_classifier(N_TREES, 5, "entropy").fit(d.where("is_test = 0"))
    return _scored(m, d.where("is_test = 1"))


# M2 ------------------------------------------------------------------------------------
def _event_split(spark, sf_dir):
    """Events with features (NaN where one is null) and a 25 % test flag, pinned."""
    e = MD.assemble(event_frame(spark, sf_dir), EVENT_FEATURES, handle_invalid="keep")
    return MD.training_table(SP.train_test_split(e, "event_id", 0.25))


@query("rf_regressor")
def rf_regressor(spark, sf_dir):
    e = _event_split(spark, sf_dir)
    m = MD.rf_regressor(TRAFFIC_TREES, 10).fit(MD.complete_rows(e.where("is_test = 0"), EVENT_FEATURES))
    return m.transform(e.where("is_test = 1")).select("event_id", "label", "prediction")


# M3 ------------------------------------------------------------------------------------
@query("decision_tree")
def decision_tree(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    m = MD.decision_tree(5).fit(d.where("is_test = 0"))
    return _scored(m, d.where("is_test = 1"))


# M4 ------------------------------------------------------------------------------------
def _scaled_docs(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    train = d.where("is_test = 0")
    sm = MD.StandardScaler(inputCol="features", outputCol="scaled", withMean=True,
                           withStd=True).fit(train)
    return sm.transform(d)


@query("logistic_l1")
def logistic_l1(spark, sf_dir):
    d = _scaled_docs(spark, sf_dir)
    m, = LN.logistic_l1_fits(d.where("is_test = 0"), [1.0], features="scaled")
    return _scored(m, d.where("is_test = 1"))


# M5 ------------------------------------------------------------------------------------
@query("ridge_cv")
def ridge_cv(spark, sf_dir):
    """Penalty by leave-one-out error over all features (closed form, so no fold is fitted)."""
    out = EV.ridge_leave_one_out(event_frame(spark, sf_dir), EVENT_FEATURES, "label", (0.1, 1.0, 10.0))
    return out.select(F.concat(F.lit("alpha="), F.col("alpha").cast("string")).alias("params"),
                      F.sqrt("loo_mse").alias("rmse"))


# M7 ------------------------------------------------------------------------------------
@query("gbt_regressor")
def gbt_regressor(spark, sf_dir):
    e = _event_split(spark, sf_dir)
    m = MD.gbt_regressor(max_iter=ROUNDS, max_depth=3, step=0.1).fit(
        MD.complete_rows(e.where("is_test = 0"), EVENT_FEATURES))
    return m.transform(e.where("is_test = 1")).select("event_id", "label", "prediction")


# M8 ------------------------------------------------------------------------------------
@query("gbt_classifier")
def gbt_classifier(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    m = MD.gbt_classifier(max_iter=ROUNDS, max_depth=5).fit(d.where("is_test = 0"))
    return _scored(m, d.where("is_test = 1"))


# M10 -----------------------------------------------------------------------------------
@query("adaboost")
def adaboost(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    m = MD.real_adaboost(d.where("is_test = 0"), rounds=ROUNDS, learning_rate=0.75)
    return m.transform(d.where("is_test = 1")).select("doc_id", "label", "prediction")


# M11 -----------------------------------------------------------------------------------
@query("extra_trees")
def extra_trees(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    m = MD.extra_trees(d.where("is_test = 0"), n_trees=N_TREES, max_depth=8, min_instances=2)
    return m.transform(d.where("is_test = 1")).select("doc_id", "label", "prediction",
                                                      "probability_1")


# M12 -----------------------------------------------------------------------------------
@query("linear_svc")
def linear_svc(spark, sf_dir):
    d = _scaled_docs(spark, sf_dir)
    train = d.where("is_test = 0")
    m = MD.linear_svc(train.count(), 0.025, features="scaled").fit(train)
    return m.transform(d.where("is_test = 1")).select("doc_id", "label", "prediction")


def embedding_frame(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    e = e.select("vec_id", array_to_vector("embedding").alias("features"),
                 F.col("label").cast("double").alias("label"))
    return MD.training_table(SP.stratified_split(e, "vec_id", "label", 0.25))


@query("svc_multiclass")
def svc_multiclass(spark, sf_dir):
    e = embedding_frame(spark, sf_dir)
    m, = LN.svm_fits(e.where("is_test = 0"), [1.0])
    return m.transform(e.where("is_test = 1")).select("vec_id", "label", "prediction")


# M13 -----------------------------------------------------------------------------------
@query("bagging_logistic")
def bagging_logistic(spark, sf_dir):
    d = _scaled_docs(spark, sf_dir)
    return MD.bagging_logistic(d.where("is_test = 0"), "doc_id", d.where("is_test = 1"), c=1.0, n_models=20,
                               vote="unanimous", features="scaled")


# M9 ------------------------------------------------------------------------------------
def _meta_estimator():
    """The boosted meta model: second-order steps, a floor on a split's summed gain, row and
    column draws for each tree."""
    return _Fits(lambda d: MD.newton_boosting(d, "doc_id", rounds=META_ROUNDS, max_depth=4, eta=0.1, gamma=0.9,
                                              min_child_weight=2.0, subsample=0.8, colsample=0.8))


class _Fits:
    """An estimator from a fitting function, for learners that are not Spark ML's."""

    def __init__(self, fit):
        self.fit = fit


def _bases(n: int):
    """The five base learners, each of the analysed size in every fold."""
    return {
        "et": lambda: _Fits(lambda d: MD.extra_trees(d, n_trees=BASE_SIZE, max_depth=8, min_instances=2)),
        "rf": lambda: _Fits(lambda d: MD.forest_classifier(d, n_trees=BASE_SIZE, max_depth=6, min_instances=2)),
        "ada": lambda: _Fits(lambda d: MD.real_adaboost(d, rounds=BASE_SIZE)),
        "gb": lambda: _Fits(lambda d: MD.boosted_classifier(d, rounds=BASE_SIZE, max_depth=5)),
        "svc": lambda: MD.Pipeline(stages=[
            MD.StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True),
            MD.linear_svc(n, 0.025, features="_z")]),
    }


def _stack_parts(spark, sf_dir):
    """Training and test rows with contiguous unshuffled folds in id order."""
    d = labelled_docs(spark, sf_dir).drop("fold")
    train = MD.spread_table(SP.kfold_assign(d.where("is_test = 0"), ["doc_id"], K))
    return train, d.where("is_test = 1"), train.count()


@query("stack_meta_model")
def stack_meta_model(spark, sf_dir):
    train, test, n = _stack_parts(spark, sf_dir)
    bases = _bases(n)
    tr, te = ST.meta_features(train, test, bases, "doc_id", "fold", K)
    m = _meta_estimator().fit(MD.assemble(tr, list(bases)))
    return m.transform(MD.assemble(te, list(bases))).select("doc_id", "prediction", *bases)


# M17 -----------------------------------------------------------------------------------
@query("stacking")
def stacking(spark, sf_dir):
    train, test, n = _stack_parts(spark, sf_dir)
    return ST.stack(train, test, _bases(n), _meta_estimator(), "doc_id", "fold", K)


# K6 (model form) -----------------------------------------------------------------------
@query("oof_model")
def oof_model(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    oof, tst = MD.oof_predictions(d.where("is_test = 0"), d.where("is_test = 1"),
                                  lambda: MD.decision_tree(4), "doc_id", "fold", K, out="oof")
    return oof.withColumn("part", F.lit("train")).unionByName(tst.withColumn("part", F.lit("test")))


# M18 -----------------------------------------------------------------------------------
@query("grid_search_cv")
def grid_search_cv(spark, sf_dir):
    """9 + 18 combinations, the forests of the second grid not bootstrapped, all in shared passes."""
    d = labelled_docs(spark, sf_dir).where("is_test = 0")
    maps = [FG.ForestMap(n, m) for m in (1, 2, 3) for n in (10, 30, 50)]
    maps += [FG.ForestMap(n, m, False) for m in (1, 2, 3) for n in (300, 400, 500, 600, 700, 800)]
    return FG.forest_grid_cv(d, maps, "fold", K, "doc_id", "accuracy").table(spark, "accuracy")


# M19 -----------------------------------------------------------------------------------
GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


@query("grid_search_holdout")
def grid_search_holdout(spark, sf_dir):
    """All 36 pairs of gamma and C on one holdout. A linear kernel has no gamma, so six fits in
    shared passes score every pair; the first strictly best pair in the order tried is marked."""
    e = embedding_frame(spark, sf_dir)
    scored, shares = e.where("is_test = 1"), []
    for i, m in enumerate(LN.svm_fits(e.where("is_test = 0"), GRID)):
        scored = m.transform(scored, f"_p{i}")
        shares.append(F.avg((F.col(f"_p{i}") == F.col("label")).cast("double")))
    scores = scored.agg(*shares).first()
    rows, best = [], None
    for gamma in GRID:
        for c, score in zip(GRID, scores):
            if best is None or score > best[0]:
                best = (score, len(rows))
            rows.append((f"gamma={gamma}, C={c}", float(score)))
    return spark.createDataFrame([(*r, i == best[1]) for i, r in enumerate(rows)],
                                 "params string, accuracy double, is_best boolean")


# M20 -----------------------------------------------------------------------------------
@query("cross_val_scores")
def cross_val_scores(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    scores = MD.cross_val_scores(d, lambda: MD.decision_tree(4), MD.EVALUATORS["accuracy"](),
                                 "fold", K)
    df = spark.createDataFrame(scores, "fold int, score double")
    return df.unionByName(df.agg(F.lit(-1).alias("fold"), F.avg("score").alias("score")))


# M21 -----------------------------------------------------------------------------------
@query("feature_importances")
def feature_importances(spark, sf_dir):
    d = labelled_docs(spark, sf_dir).where("is_test = 0")
    models = {
        "rf": MD.rf_classifier(50, 6).fit(d),
        "et": MD.extra_trees(d, n_trees=50, max_depth=8),
        "ada": MD.real_adaboost(d, rounds=10),
        "gb": MD.gbt_classifier(max_iter=10, max_depth=5).fit(d),
    }
    return MD.importance_table(spark, DOC_FEATURES, models)


# M22 -----------------------------------------------------------------------------------
@query("coefficient_table")
def coefficient_table(spark, sf_dir):
    d = _scaled_docs(spark, sf_dir).where("is_test = 0")
    m, = LN.logistic_l1_fits(d, [1.0], features="scaled")
    return MD.coefficient_table(spark, DOC_FEATURES, m)


# M26 -----------------------------------------------------------------------------------
@query("bad_case_report")
def bad_case_report(spark, sf_dir):
    d = _scaled_docs(spark, sf_dir)
    m, = LN.logistic_l1_fits(d.where("is_test = 0"), [1.0], features="scaled")
    wrong = m.transform(d.where("is_test = 1")).where(F.col("prediction") != F.col("label")) \
             .select(F.col("doc_id").alias("bad_id"), F.col("prediction"))
    src = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return src.join(wrong, src.doc_id == wrong.bad_id, "inner").drop("bad_id")


# M27 -----------------------------------------------------------------------------------
@query("batch_score")
def batch_score(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    m = MD.decision_tree(5).fit(d)
    every = MD.assemble(doc_features(spark, sf_dir), DOC_FEATURES)
    return m.transform(every).select("doc_id", "prediction")


# S7 ------------------------------------------------------------------------------------
@query("model_save_load")
def model_save_load(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    pipe = MD.Pipeline(stages=[MD.decision_tree(4)]).fit(d.where("is_test = 0"))
    path = scratch_path(spark, "model")
    loaded = MD.save_load(pipe, path)
    drop_path(spark, path)  # a loaded model is in memory
    test = d.where("is_test = 1")
    a = pipe.transform(test).select("doc_id", F.col("prediction").alias("before"))
    b = loaded.transform(test).select("doc_id", F.col("prediction").alias("after"))
    return a.join(b, "doc_id")


# E6 ------------------------------------------------------------------------------------
def _gapped_design(spark, sf_dir):
    return MD.training_table(MD.assemble(event_frame(spark, sf_dir), EVENT_FEATURES, handle_invalid="keep"))


def _known(e, names=None):
    """Rows to fit on: the value is there, and so are all features."""
    return MD.complete_rows(e.where(F.col("gv").isNotNull()), names or EVENT_FEATURES)


@query("impute_forest")
def impute_forest(spark, sf_dir):
    e = _gapped_design(spark, sf_dir)
    m = MD.rf_regressor(TRAFFIC_TREES, 10, label="gv").fit(_known(e))
    filled = m.transform(e.where(F.col("gv").isNull())).select(
        "event_id", F.col("prediction").alias("gv_filled"))
    known = e.where(F.col("gv").isNotNull()).select("event_id", F.col("gv").alias("gv_filled"))
    return known.unionByName(filled)


# E7 ------------------------------------------------------------------------------------
@query("impute_ridge")
def impute_ridge(spark, sf_dir):
    from tidemark.operators import features as FE
    e = event_frame(spark, sf_dir)
    lanes = FE.fit_levels(e, "event_type")
    e = FE.one_hot(e, "event_type", lanes, prefix="lane")
    names = ["hour", "dayofweek", "k"] + [f"lane_{lv}" for lv in lanes]
    e = MD.training_table(MD.assemble(e, names, handle_invalid="keep"))
    known = e.where(F.col("gv").isNotNull())
    fit_rows = _known(e, names)
    m = MD.ridge(fit_rows.count(), 1.0, label="gv").fit(fit_rows)
    pred = m.transform(e.where(F.col("gv").isNull())).select(
        "event_id", F.abs("prediction").alias("gv_filled"))  # negatives flipped
    return known.select("event_id", F.col("gv").alias("gv_filled")).unionByName(pred)


# E8 ------------------------------------------------------------------------------------
@query("impute_blend")
def impute_blend(spark, sf_dir):
    """Boosted trees and least squares, both cross-validated, and their mean for every gap. The
    linear model's ten folds come from moments; the trees take three folds made of those."""
    e = SP.stratified_kfold(_gapped_design(spark, sf_dir), "event_id", "event_type", 10)
    known = e.where(F.col("gv").isNotNull())
    fit_rows = MD.training_table(_known(e).withColumns({
        "fold3": F.pmod("fold", F.lit(3)), "row": F.concat(vector_to_array("features"), F.array("gv"))}))
    p = len(EVENT_FEATURES)
    linear = LN.ridge_grid_cv(fit_rows, "row", p + 1, [(0.0, range(p))], "fold", 10)
    gbt = MD.gbt_regressor(max_iter=20, max_depth=3, step=0.1, feature_subset="3", label="gv")
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [3]).build()
    mg, _ = MD.grid_search_cv(fit_rows, gbt, [grid], MD.RegressionEvaluator(labelCol="gv", metricName="mse"), "fold3", 3)
    miss = e.where(F.col("gv").isNull())
    # one model after the other over the same rows: no join
    a = mg.transform(miss).select("event_id", vector_to_array("features").alias("x"), F.col("prediction").alias("p_gbt"))
    line = F.lit(linear.intercept)
    for i, c in enumerate(linear.coef):
        line = line + F.lit(float(c)) * F.get("x", F.lit(i))
    b = a.withColumn("p_lin", F.nanvl(line, F.lit(None).cast("double")))
    blend = b.select("event_id", S.row_mean("p_gbt", "p_lin").alias("gv_filled"))
    return known.select("event_id", F.col("gv").alias("gv_filled")).unionByName(blend)


# K7 ------------------------------------------------------------------------------------
_CUTS = SP.poisson_cuts(0.8)
_times = " + ".join(f"CASE WHEN h >= '{c}' THEN 1 ELSE 0 END" for c in _CUTS)


@query("bootstrap_sample", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, substr(md5('7:' || CAST(o_orderkey AS VARCHAR)), 1, 4) AS h
           FROM orders)
SELECT o_orderkey, o_totalprice FROM o, range({len(_CUTS)}) r(i) WHERE r.i < {_times}""")
def bootstrap_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return SP.bootstrap_sample(o, "o_orderkey", 0.8, seed=7)


# M14 -----------------------------------------------------------------------------------
AR_LAGS, AR_PERIOD, AR_HORIZON, AR_OUTPUT_WINDOW = 20, 200, 250, 10


def _ar_design(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    # One long series per lane, as in the analysed forecast (one device x lane series).
    return TR.ar_design(ev, ["event_type"], ["ts", "event_id"], "value", AR_LAGS, AR_PERIOD)


@query("ar_fit")
def ar_fit(spark, sf_dir):
    m, names = TR.ar_fit(_ar_design(spark, sf_dir), "value", AR_LAGS)
    rows = [(n, float(c)) for n, c in zip(names, m.coefficients.toArray())]
    rows.append(("(intercept)", float(m.intercept)))
    return spark.createDataFrame(rows, "feature string, coef double")


@query("ar_forecast")
def ar_forecast(spark, sf_dir):
    design = _ar_design(spark, sf_dir)
    m, _ = TR.ar_fit(design, "value", AR_LAGS)
    return TR.ar_forecast(design, m, ["event_type"], "value", AR_LAGS, AR_PERIOD, AR_HORIZON)


# M16 -----------------------------------------------------------------------------------
STATION_FEATURES = ["pct", "dist", "occ", "speed", "hour", "dayofweek", "lane", "device"]


@query("predict_direction")
def predict_direction(spark, sf_dir):
    r = station_readings(spark, sf_dir, with_id=True)
    prepared = TR.prepare_readings(r, ["device", "lane"], "t", "seq", ["speed"])
    data = MD.assemble(prepared, STATION_FEATURES, handle_invalid="keep").withColumnRenamed("traffic", "label")
    data = MD.training_table(SP.train_test_split(data, "seq", 0.25))
    train = MD.complete_rows(data.where("is_test = 0"), STATION_FEATURES)
    model = MD.rf_regressor(TRAFFIC_TREES, 10).fit(train)
    out = TR.score_directions(model, data, "device", "lane", "t")
    path = C.write_csv(out, scratch_path(spark, "jtresult"))
    return C.read_csv(spark, path, "Jtstation string, direction string, "
                                   "predictedValue double, time timestamp_ntz")


# M15/M16 as the station workflow: load per device, fit per device, per-lane report -----
@query("lane_model_metrics")
def lane_model_metrics(spark, sf_dir):
    # A mixed station file (all devices), written with its own header names; the reader
    # replaces them by the station schema.
    path = C.write_csv(station_readings(spark, sf_dir), scratch_path(spark, "stations-mixed"))
    by_device = scratch_path(spark, "stations-by-device")
    _, readings = TR.load_data(spark, path, by_device)
    metrics = TR.lane_metrics(readings, num_trees=TRAFFIC_TREES).checkpoint(eager=True)
    for written in (path, by_device):
        drop_path(spark, written)
    return metrics



@query("ar_direct_fit")
def ar_direct_fit(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    coef, intercepts, names = TR.ar_direct_fit(ev, ["event_type"], ["ts", "event_id"], "value",
                                               AR_LAGS, AR_OUTPUT_WINDOW, AR_PERIOD)
    rows = [(h + 1, n, float(c)) for h in range(AR_OUTPUT_WINDOW)
            for n, c in zip(names + ["(intercept)"], [*coef[:, h], intercepts[h]])]
    return spark.createDataFrame(rows, "horizon int, feature string, coef double")
