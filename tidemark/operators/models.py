"""Distributed model training, selection and scoring on DataFrames (Spark ML).

Every estimator trains with Spark ML's distributed algorithms (tree learners aggregate
split statistics per partition; linear models run treeAggregate gradient passes), so the
training table is never gathered on the driver. What runs on the driver is only small
model state (coefficients, tree structure, per-round scalars).

Estimators Spark ML lacks are compositions of Spark ML fits and DataFrame aggregations:

* AdaBoost (discrete SAMME): weighted depth-1 trees; each round's error is one
  aggregation, the new weights a column expression; lineage is cut by ``checkpoint``.
* Extremely randomised trees and Newton boosting: see :mod:`tidemark.operators.trees`.
* Out-of-fold predictions / stacking / bagging: loops of ordinary fits over fold or
  bootstrap columns, results joined on the row id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   MulticlassClassificationEvaluator, RegressionEvaluator)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from tidemark.operators import linear as LN
from tidemark.operators import split as SP
from tidemark.operators.trees import (extra_trees, gradient_boosting, newton_boosting,  # noqa: F401 - learners
                                       random_forest, real_adaboost)
from tidemark.session import ensure_checkpoint_dir, fit_parts


# --- assembling ----------------------------------------------------------------------------
def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Feature columns (by name) -> one vector column; no row is dropped.

    A null feature is an error by default; ``"keep"`` gives NaN there, which tree models can
    score. Rows to fit on are chosen by the caller with :func:`complete_rows`.
    """
    if handle_invalid == "skip":
        raise ValueError("rows are dropped by complete_rows, not while assembling")
    return VectorAssembler(inputCols=list(inputs), outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


def complete_rows(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Rows without a null in ``inputs``: those that a model can be fitted on."""
    return df.dropna(subset=list(inputs))


def scaled(df: DataFrame, inp: str = "features", out: str = "scaled") -> tuple[DataFrame, object]:
    """Standardised features (mean 0, unit sample std) -- for margin-based learners."""
    m = StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True).fit(df)
    return m.transform(df), m


# --- single estimators ---------------------------------------------------------------------
def rf_classifier(num_trees=500, max_depth=5, impurity="entropy", bootstrap=True,
                  feature_subset="auto", min_instances=1, seed=0, label="label",
                  features="features"):
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, impurity=impurity,
                                  bootstrap=bootstrap, featureSubsetStrategy=feature_subset,
                                  minInstancesPerNode=min_instances, seed=seed,
                                  labelCol=label, featuresCol=features)


def rf_regressor(num_trees=30, max_depth=10, seed=0, label="label", features="features"):
    # Spark caps tree depth at 30; the analysed forests grew unbounded trees.
    return RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                 labelCol=label, featuresCol=features)


def decision_tree(max_depth=5, seed=0, label="label", features="features"):
    return DecisionTreeClassifier(maxDepth=max_depth, seed=seed, labelCol=label,
                                  featuresCol=features)


def logistic_l1(n_rows: int, c: float = 1.0, label="label", features="features",
                max_iter: int = 100):
    """L1 logistic regression with inverse strength ``C``.

    The analysed objective is ``C * sum(loss) + |w|_1``; Spark minimises
    ``mean(loss) + regParam * |w|_1``, so ``regParam = 1 / (C * n)``.
    """
    return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * max(n_rows, 1)),
                              standardization=False, maxIter=max_iter, labelCol=label,
                              featuresCol=features)


def ridge(n_rows: int, alpha: float = 1.0, label="label", features="features"):
    """Ridge with penalty ``alpha * |w|^2`` on the summed loss -> ``regParam = alpha / n``."""
    return LinearRegression(elasticNetParam=0.0, regParam=alpha / max(n_rows, 1),
                            standardization=False, labelCol=label, featuresCol=features)


def gbt_regressor(max_iter=2000, max_depth=3, step=0.01, feature_subset="auto", seed=0,
                  label="label", features="features"):
    return GBTRegressor(maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                        featureSubsetStrategy=feature_subset, seed=seed, labelCol=label,
                        featuresCol=features)


def gbt_classifier(max_iter=500, max_depth=5, step=0.1, subsample=1.0, min_info_gain=0.0,
                   feature_subset="auto", seed=0, label="label", features="features"):
    return GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                         subsamplingRate=subsample, minInfoGain=min_info_gain,
                         featureSubsetStrategy=feature_subset, seed=seed, labelCol=label,
                         featuresCol=features)


def boosted_classifier(df: DataFrame, rounds: int = 500, max_depth: int = 5, step: float = 0.1):
    """A fitted :func:`gbt_classifier`; over few rows all rounds are one job."""
    return gradient_boosting(df, rounds, max_depth, step) or gbt_classifier(rounds, max_depth, step).fit(df)


def forest_classifier(df: DataFrame, n_trees: int = 500, max_depth: int = 5, min_instances: int = 1):
    """A fitted :func:`rf_classifier` (Gini, square root of the features); over few rows one job."""
    return random_forest(df, n_trees, max_depth, min_instances) or rf_classifier(
        n_trees, max_depth, "gini", feature_subset="sqrt", min_instances=min_instances).fit(df)


def linear_svc(n_rows: int, c: float = 0.025, label="label", features="features",
               max_iter: int = 100):
    """Linear SVM with inverse strength ``C`` (``regParam = 1 / (C * n)``); feed scaled
    features -- on raw ones the optimiser may stall."""
    return LinearSVC(regParam=1.0 / (c * max(n_rows, 1)), maxIter=max_iter, labelCol=label,
                     featuresCol=features)


def svc_multiclass(n_rows: int, c: float = 1.0, label="label", features="features",
                   max_iter: int = 100, parallelism: int = 4):
    """Multi-class linear SVM as one-vs-rest (the analysed one used one-vs-one); the
    per-class fits run ``parallelism`` at a time."""
    return OneVsRest(classifier=linear_svc(n_rows, c, label, features, max_iter),
                     labelCol=label, featuresCol=features, parallelism=parallelism)


# --- AdaBoost (discrete SAMME) -------------------------------------------------------------
class AdaBoostModel:
    """Weighted depth-1 trees, kept as (feature, threshold, left, right, weight) numbers and
    scored in one expression, whatever their count."""

    def __init__(self, stumps, classes, features, importances):
        self.stumps, self.classes, self.features = stumps, classes, features
        self.featureImportances = importances

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Weighted vote: class with the largest sum of round weights; ties go to the smaller."""
        x = vector_to_array(F.col(self.features))
        if not self.stumps:
            return df.withColumn(out, F.lit(float(self.classes[0]) if self.classes else None))
        rounds = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"), F.lit(lo).alias("lo"),
                                    F.lit(hi).alias("hi"), F.lit(a).alias("a"))
                           for f, t, lo, hi, a in self.stumps])
        said = F.transform(rounds, lambda r: F.struct(
            F.when(F.get(F.col("_x"), r["f"]) <= r["t"], r["lo"]).otherwise(r["hi"]).alias("c"), r["a"].alias("a")))
        score = lambda c: F.aggregate("_said", F.lit(0.0), lambda acc, r: acc + F.when(
            r["c"] == F.lit(float(c)), r["a"]).otherwise(0.0))
        best = F.array_max(F.array(*[F.struct(score(c).alias("s"), F.lit(-float(c)).alias("neg"))
                                     for c in self.classes]))
        return df.withColumn("_x", x).withColumn("_said", said).withColumn(out, -best["neg"]).drop("_x", "_said")


def _stump(model) -> tuple[int, float, float, float]:
    """(feature, threshold, prediction at or below, prediction above) of a depth-1 tree."""
    root = model._java_obj.rootNode()
    if root.subtreeDepth() == 0:
        return 0, float("inf"), float(root.prediction()), float(root.prediction())
    split = root.split()
    return (split.featureIndex(), float(split.threshold()), float(root.leftChild().prediction()),
            float(root.rightChild().prediction()))


def adaboost(df: DataFrame, rounds: int = 500, learning_rate: float = 0.75,
             label: str = "label", features: str = "features",
             checkpoint_every: int = 10) -> AdaBoostModel:
    """Discrete SAMME boosting of depth-1 trees (Zhu et al., 2009).

    Per round: fit a stump with ``weightCol``, one aggregation gives the weighted error, a
    column expression reweights the rows; the new total weight follows from the error. The
    reweighted rows are kept in memory for the next round, and every ``checkpoint_every``
    rounds a reliable checkpoint cuts the lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    stats = df.agg(F.count("*"), F.array_sort(F.collect_set(label))).first()
    n, classes = stats[0], list(stats[1])
    k = len(classes)
    data = df.select(label, features).withColumn("_w", F.lit(1.0 / max(n, 1))).persist()
    stumps, importances, total = [], 0.0, 0.0
    for i in range(rounds if k > 1 else 0):
        m = DecisionTreeClassifier(maxDepth=1, labelCol=label, featuresCol=features,
                                   weightCol="_w", predictionCol="_pred",
                                   rawPredictionCol="_raw", probabilityCol="_prob").fit(data)
        f, t, lo, hi = _stump(m)
        said = F.when(vector_to_array(F.col(features))[f] <= t, F.lit(lo)).otherwise(F.lit(hi))
        miss = (said != F.col(label)).cast("double")
        err = float(data.agg(F.sum(F.col("_w") * miss)).first()[0] or 0.0)
        if err >= 1.0 - 1.0 / k:
            break  # no better than chance: stop, as SAMME does
        sure = err <= 1e-12
        err = max(err, 1e-12)
        alpha = learning_rate * (math.log((1.0 - err) / err) + math.log(k - 1))
        stumps.append((f, t, lo, hi, alpha))
        importances = importances + m.featureImportances.toArray() * alpha
        total += alpha
        if sure:
            break
        weight = F.col("_w") * F.exp(F.lit(alpha) * miss) / F.lit(1.0 - err + err * math.exp(alpha))
        after = data.withColumn("_w", weight)
        after = after.checkpoint(eager=True) if (i + 1) % checkpoint_every == 0 else after
        after = after.persist()
        after.count()
        data.unpersist()
        data = after
    data.unpersist()
    return AdaBoostModel(stumps, classes, features, importances / (total or 1.0) if stumps else [])


# --- out-of-fold predictions, bagging, stacking --------------------------------------------
def positive_probability(model_df: DataFrame, prob_col: str = "probability") -> F.Column:
    return vector_to_array(F.col(prob_col))[1]


def fold_models(df: DataFrame, make_estimator, fold_col: str = "fold", k: int = 5) -> list:
    """The models fitted without each fold in turn. The fits wait for many short jobs, so all
    run beside each other, as in Spark's ``CrossValidator(parallelism=3)``: more at a time
    fill the driver's memory."""
    def fit(f):
        return make_estimator().fit(df.where(F.col(fold_col) != f))

    with ThreadPool(min(k, 3)) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(fit), range(k))


def oof_predictions(df: DataFrame, test: DataFrame | None, make_estimator, id_col: str,
                    fold_col: str = "fold", k: int = 5, out: str = "oof",
                    score=None) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold predictions: every training row is predicted by the model that did not
    see its fold; test rows get the mean over the k fold models.

    ``make_estimator()`` returns an unfitted estimator; ``score(model, frame)`` returns the
    frame with a ``_score`` column (default: the predicted label).
    """
    score = score or (lambda m, d: m.transform(d).withColumn("_score", F.col("prediction")))
    oof_parts, scores = [], []
    scored = test.drop(*MODEL_OUTPUTS) if test is not None else None
    for f, m in enumerate(fold_models(df, make_estimator, fold_col, k)):
        held = df.where(F.col(fold_col) == f)
        oof_parts.append(score(m, held).select(id_col, F.col("_score").alias(out)))
        if scored is not None:  # one more column for each model: no shuffle
            scored = score(m, scored).select(*scored.columns, F.col("_score").alias(f"_s{f}"))
            scores.append(F.col(f"_s{f}"))
    oof = reduce(DataFrame.unionByName, oof_parts)
    tst = None
    if scored is not None:
        tst = scored.select(id_col, (sum(scores[1:], scores[0]) / F.lit(float(k))).alias(out))
    return oof, tst


#: Columns that Spark ML models add.
MODEL_OUTPUTS = ("prediction", "rawPrediction", "probability")


def bagging(df: DataFrame, make_estimator, id_col: str, score_df: DataFrame, n_models: int = 20,
            fraction: float = 0.8, vote: str = "unanimous", seed: int = 0) -> DataFrame:
    """Fit ``n_models`` on bootstrap samples, average their 0/1 predictions per row.

    ``vote="unanimous"`` truncates the mean to int (1 only if every model says 1, as the
    analysed code did); ``"majority"`` rounds it. The models score the rows one after the
    other, a column each, so scoring needs no shuffle.
    """
    scored, votes = score_df.drop(*MODEL_OUTPUTS), []
    for i in range(n_models):
        m = make_estimator().fit(SP.bootstrap_sample(df, id_col, fraction, seed + i))
        scored = m.transform(scored).select(*scored.columns, F.col("prediction").alias(f"_v{i}"))
        votes.append(F.col(f"_v{i}"))
    ones = sum(votes[1:], votes[0])
    avg = scored.select(id_col, (ones / F.lit(float(n_models))).alias("mean_vote"))
    pred = ((F.col("mean_vote") >= 1.0) if vote == "unanimous" else (F.col("mean_vote") >= 0.5)).cast("int")
    return avg.withColumn("prediction", pred)


def bagging_logistic(df: DataFrame, id_col: str, score_df: DataFrame, c: float = 1.0, n_models: int = 20,
                     fraction: float = 0.8, vote: str = "unanimous", seed: int = 0, features: str = "features"
                     ) -> DataFrame:
    """:func:`bagging` of L1 logistic regressions of strength ``c``, all fitted in shared passes:
    a sample is a weight for each row. Same samples, same votes."""
    counts = F.array(*[SP.bootstrap_count(id_col, fraction, seed + i) for i in range(n_models)])
    data = training_table(df.select(features, "label", counts.alias("_w")))
    models = LN.logistic_l1_fits(data, [c] * n_models, "_w", features=features)
    x = vector_to_array(F.col(features))
    ones = sum(((m.margin(x) > 0).cast("int") for m in models[1:]), (models[0].margin(x) > 0).cast("int"))
    avg = score_df.select(id_col, (ones / F.lit(float(n_models))).alias("mean_vote"))
    return avg.withColumn("prediction", (F.col("mean_vote") >= (1.0 if vote == "unanimous" else 0.5)).cast("int"))


# --- selection -----------------------------------------------------------------------------
def grid_search_cv(df: DataFrame, estimator, grids: Sequence[list], evaluator,
                   fold_col: str = "fold", k: int = 5, parallelism: int = 4):
    """Cross-validated grid search over the union of several grids, with explicit folds
    (``fold_col`` holds 0..k-1)."""
    maps = [pm for g in grids for pm in g]
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator,
                        foldCol=fold_col, numFolds=k, parallelism=parallelism)
    return cv.fit(df), maps


def grid_search_holdout(df: DataFrame, estimator, grid: list, evaluator,
                        train_ratio: float = 0.75, seed: int = 0, parallelism: int = 4):
    tvs = TrainValidationSplit(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator,
                               trainRatio=train_ratio, seed=seed, parallelism=parallelism)
    return tvs.fit(df)


def param_table(spark: SparkSession, maps: list, metrics: Sequence[float],
                metric_name: str = "metric") -> DataFrame:
    """(params, metric) table of a grid search (small: one row per parameter map)."""
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)),
             float(m)) for pm, m in zip(maps, metrics)]
    return spark.createDataFrame(rows, f"params string, {metric_name} double")


def cross_val_scores(df: DataFrame, make_estimator, evaluator, fold_col: str = "fold",
                     k: int = 5) -> list[tuple[int, float]]:
    scores = []
    for f in range(k):
        m = make_estimator().fit(df.where(F.col(fold_col) != f))
        scores.append((f, float(evaluator.evaluate(m.transform(df.where(F.col(fold_col) == f))))))
    return scores


# --- model state as tables -----------------------------------------------------------------
def importance_table(spark: SparkSession, names: Sequence[str], models: dict) -> DataFrame:
    """(features, <one column per model>, mean) -- small: one row per feature."""
    cols = list(models)
    rows = []
    vecs = {k: [float(x) for x in (m.featureImportances.toArray()
                                   if hasattr(m.featureImportances, "toArray")
                                   else m.featureImportances)] for k, m in models.items()}
    for i, n in enumerate(names):
        vals = [vecs[c][i] for c in cols]
        rows.append((n, *vals, sum(vals) / len(vals)))
    schema = "features string, " + ", ".join(f"{c} double" for c in cols) + ", mean double"
    return spark.createDataFrame(rows, schema)


def coefficient_table(spark: SparkSession, names: Sequence[str], model) -> DataFrame:
    coef = model.coef if isinstance(model, LN.LogisticModel) else model.coefficients.toArray()
    rows = [(n, float(c)) for n, c in zip(names, coef)]
    rows.append(("(intercept)", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coef double")


def training_table(df: DataFrame) -> DataFrame:
    """Pin an assembled training table before iterative fitting.

    Model selection and ensembles fit many times over the same rows; a reliable
    checkpoint (shared storage) stops every iteration from re-running the feature
    extraction, and survives executor loss, which a cache does not guarantee.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_table(df: DataFrame) -> DataFrame:
    """:func:`training_table` in at least :func:`fit_parts` parts, so that every core has rows."""
    pinned = training_table(df)
    parts = fit_parts(df.sparkSession, pinned.count())
    return pinned if pinned.rdd.getNumPartitions() >= parts else training_table(pinned.repartition(parts))


def save_load(model, path: str):
    """Persist a fitted pipeline/model in shared storage and load it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path) if isinstance(model, PipelineModel) else type(model).load(path)


EVALUATORS = {
    "accuracy": lambda label="label": MulticlassClassificationEvaluator(
        labelCol=label, metricName="accuracy"),
    "auc": lambda label="label": BinaryClassificationEvaluator(labelCol=label),
    "r2": lambda label="label": RegressionEvaluator(labelCol=label, metricName="r2"),
    "rmse": lambda label="label": RegressionEvaluator(labelCol=label, metricName="rmse"),
}

__all__ = ["Pipeline", "ParamGridBuilder"]
