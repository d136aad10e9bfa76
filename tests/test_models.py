"""Property checks for the model layer: beats the majority baseline on separable data,
same seed -> same output, recursion matches a direct loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as EV
from tidemark.operators import models as MD
from tidemark.plans import traffic as TR


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1]) > 0.3).astype(float)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    return MD.assemble(df, ["a", "b", "c"]).cache()


def acc(df):
    return EV.accuracy(df, "label", "prediction").first()["accuracy"]


def majority(df):
    p = df.agg(F.avg("label")).first()[0]
    return max(p, 1 - p)


@pytest.mark.parametrize("make", [
    lambda n: MD.rf_classifier(10, 4),
    lambda n: MD.decision_tree(4),
    lambda n: MD.logistic_l1(n, 1.0),
    lambda n: MD.gbt_classifier(max_iter=10, max_depth=3),
    lambda n: MD.linear_svc(n, 1.0),
])
def test_learners_beat_baseline(separable, make):
    m = make(separable.count()).fit(separable)
    assert acc(m.transform(separable)) > majority(separable) + 0.1


@pytest.mark.parametrize("make", [lambda: MD.rf_regressor(20, 6), lambda: MD.gbt_regressor(30, 3, 0.1),
                                  lambda: MD.ridge(400, 1.0)])
def test_regressors_beat_the_mean(separable, make):
    d = separable.withColumn("label", 3 * F.col("a") - F.col("b"))
    r2 = EV.regression_metrics(make().fit(d).transform(d), "label", "prediction").first().r2
    assert r2 > 0.7


def test_adaboost_and_extra_trees(separable):
    ada = MD.adaboost(separable, rounds=8)
    assert acc(ada.transform(separable)) > majority(separable) + 0.1
    assert len(ada.featureImportances) == 3
    et = MD.extra_trees(separable, n_trees=4, max_depth=5, seed=1)
    a1 = et.transform(separable)
    assert acc(a1) > majority(separable) + 0.1
    et2 = MD.extra_trees(separable, n_trees=4, max_depth=5, seed=1)
    same = a1.select("id", "prediction").join(
        et2.transform(separable).select("id", F.col("prediction").alias("p2")), "id")
    assert same.where("prediction != p2").count() == 0


def test_bagging_unanimous_is_stricter(separable):
    n = separable.count()
    u = MD.bagging(separable, lambda: MD.logistic_l1(n, 1.0), "id", separable, n_models=3,
                   vote="unanimous").agg(F.sum("prediction")).first()[0]
    m = MD.bagging(separable, lambda: MD.logistic_l1(n, 1.0), "id", separable, n_models=3,
                   vote="majority").agg(F.sum("prediction")).first()[0]
    assert u <= m


def test_oof_rows_are_predicted_once(separable):
    from tidemark.operators import split as SP
    d = SP.stratified_kfold(separable, "id", "label", 4)
    oof, tst = MD.oof_predictions(d, d.limit(10), lambda: MD.decision_tree(3), "id", "fold", 4)
    assert oof.count() == d.count() and oof.select("id").distinct().count() == d.count()
    assert tst.count() == 10


def test_ar_forecast_matches_loop(spark):
    n, lags, period = 60, 3, 7
    vals = [float(np.sin(i / 3.0) * 10 + i % 5) for i in range(n)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "k string, t long, v double")
    design = TR.ar_design(df, ["k"], ["t"], "v", lags, period)
    m, _ = TR.ar_fit(design, "v", lags)
    fc = [r.forecast for r in TR.ar_forecast(design, m, ["k"], "v", lags, period, 5)
          .orderBy("step").collect()]
    coef, b0 = m.coefficients.toArray(), m.intercept
    hist = list(vals[-lags:])
    exp = []
    for step in range(1, 6):
        pos = n - 1 + step
        ang = 2 * np.pi * pos / period
        y = b0 + sum(coef[i - 1] * hist[-i] for i in range(1, lags + 1)) \
            + coef[lags] * np.sin(ang) + coef[lags + 1] * np.cos(ang)
        exp.append(y)
        hist = hist[1:] + [y]
    assert np.allclose(fc, exp)


def test_classification_report_values(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    rep = {r["class"]: r for r in EV.classification_report(df, "y", "p").collect()}
    assert rep["1"].precision == 1.0 and rep["1"].recall == 0.5 and rep["1"].support == 2
    assert np.isclose(rep["0"].precision, 2 / 3)
    assert rep["macro avg"].support == 4


def test_save_load_gives_same_predictions(spark, separable):
    from tidemark.session import scratch_path
    pipe = MD.Pipeline(stages=[MD.rf_classifier(5, 3)]).fit(separable)
    loaded = MD.save_load(pipe, scratch_path(spark, "model-test"))
    a = pipe.transform(separable).select("id", F.col("prediction").alias("a"))
    b = loaded.transform(separable).select("id", F.col("prediction").alias("b"))
    assert a.join(b, "id").where("a != b").count() == 0


def test_same_seed_same_forest(separable):
    p1 = MD.rf_classifier(5, 3, seed=7).fit(separable).transform(separable)
    p2 = MD.rf_classifier(5, 3, seed=7).fit(separable).transform(separable)
    j = p1.select("id", F.col("prediction").alias("x")).join(
        p2.select("id", F.col("prediction").alias("y")), "id")
    assert j.where("x != y").count() == 0


def test_fits_without_each_fold_run_at_once(spark):
    """One after the other, the fits of a stack waited for thousands of short jobs."""
    from threading import Barrier
    together = Barrier(3, timeout=60)

    class Rows:
        def fit(self, d):
            together.wait()
            return sorted(r.id for r in d.select("id").collect())

    df = spark.range(9).withColumn("fold", (F.col("id") % 3).cast("int"))
    assert MD.fold_models(df, Rows, "fold", 3) == [[i for i in range(9) if i % 3 != f] for f in range(3)]


def test_spread_rows_reach_every_core(spark):
    """Adaptive execution merges such a table into one part, and one core fitted it."""
    df = spark.range(60_000).repartition(1)
    out = MD.spread_table(df)
    cores = spark.sparkContext.defaultParallelism
    assert out.rdd.getNumPartitions() == min(cores, 6)
    assert out.agg(F.count("*"), F.sum("id")).first()[:] == (60_000, 60_000 * 59_999 // 2)
    assert MD.spread_table(spark.range(50).repartition(1)).rdd.getNumPartitions() == 1
    assert MD.spread_table(spark.range(0).repartition(1)).count() == 0
    wide = spark.range(0, 100_000, 1, 3 * cores)
    assert MD.spread_table(wide).rdd.getNumPartitions() == 3 * cores


def test_meta_model_has_the_analysed_rounds(monkeypatch):
    """The second level ran 50 rounds of 3000."""
    from tidemark.plans.catalog import models as M

    asked = []
    monkeypatch.setattr(MD, "newton_boosting", lambda *_, rounds, **more: asked.append(rounds))
    M._meta_estimator().fit(None)
    assert asked == [3000]


def test_bases_have_the_analysed_sizes(monkeypatch):
    """They ran 10 rounds or 50 trees of 500."""
    from tidemark.plans.catalog import models as M

    asked = {}
    for name in ("extra_trees", "forest_classifier", "real_adaboost", "boosted_classifier"):
        monkeypatch.setattr(MD, name, lambda *_, _n=name, **sizes: asked.__setitem__(_n, sizes.get("rounds") or sizes.get("n_trees")))
    bases = M._bases(100)
    for name in ("et", "rf", "ada", "gb"):
        bases[name]().fit(None)
    assert asked == {n: 500 for n in ("extra_trees", "forest_classifier", "real_adaboost", "boosted_classifier")}
