"""Evaluation as aggregations: every metric is one grouped pass over (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def regression_metrics(df: DataFrame, label: str, pred: str,
                       groups: Sequence[str] = ()) -> DataFrame:
    """MSE, MAE and R^2 (``1 - SSE / SST``, SST around the label mean), per group.

    R^2 of a group whose labels are all equal (one row, say) is undefined: null.
    """
    e = F.col(label) - F.col(pred)
    agg = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), F.var_pop(label).alias("_vp"))
    r2 = F.lit(1.0) - F.col("_sse") / F.nullif(F.col("_vp") * F.col("n"), F.lit(0.0))
    return agg.select(*groups, "n", "mse", "mae", r2.alias("r2"))


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision / recall / f1 / support per class, plus ``macro avg`` and ``weighted avg``.

    Classes are the union of labels and predictions; an undefined ratio (no predicted or
    no true rows) counts as 0, as in the common report. Everything derives from the
    confusion counts (a tiny table), so the big input is read once.
    """
    cc = confusion_counts(df, label, pred)
    # Each confusion cell adds to its true class (support, hits) and to its predicted class.
    cell = F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n"))
                  .otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"))))
    per = (cc.select(cell.alias("c")).select("c.*").groupBy("cls")
             .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                  F.sum("tp").alias("tp")))
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select(F.col("cls").cast("string").alias("class"), precision.alias("precision"),
                     recall.alias("recall"), F.col("support").cast("long").alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    per = per.withColumn("f1", f1)
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), tot.cast("long").alias("support"),
                    F.avg("f1").alias("f1"))
    weighted = per.agg(
        F.lit("weighted avg").alias("class"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        tot.cast("long").alias("support"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))
    return per.unionByName(macro).unionByName(weighted)


def group_ols(df: DataFrame, y: str, x: str, groups: Sequence[str] = ()) -> DataFrame:
    """One-feature least squares per group in closed form (slope, intercept, R^2, n).

    ``regr_*`` are partial aggregates, so thousands of per-series models fit in one pass
    instead of one estimator fit per series.
    """
    return df.groupBy(*groups).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def ridge_state(df: DataFrame, features: Sequence[str], label: str) -> dict:
    """Counts, means and centred cross products of complete rows, from one aggregation.

    The state has one number per pair of features, whatever the rows.
    """
    rows = df.dropna(subset=[*features, label])
    cols = [F.col(c).cast("double") for c in [*features, label]]
    first = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    n, means = first[0], [float(m or 0.0) for m in first[1:]]
    centred = [c - F.lit(m) for c, m in zip(cols, means)]
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.agg(*[F.sum(centred[i] * centred[j]) for i, j in pairs]).first()
    cross = [[0.0] * p for _ in range(p)]
    for (i, j), v in zip(pairs, sums):
        cross[i][j] = cross[j][i] = float(v or 0.0)
    return {"n": n, "means": means, "cross": cross}


def ridge_solve(state: dict, alpha: float) -> tuple[list[float], float, list[list[float]]]:
    """(coefficients, intercept, inverse of X'X + alpha I) for centred features."""
    import numpy as np

    cross = np.array(state["cross"])
    inverse = np.linalg.pinv(cross[:-1, :-1] + alpha * np.eye(len(cross) - 1))
    coef = inverse @ cross[:-1, -1]
    return coef.tolist(), state["means"][-1] - float(coef @ np.array(state["means"][:-1])), inverse.tolist()


def ridge_predict(features: Sequence[str], coef: Sequence[float], intercept: float) -> F.Column:
    out = F.lit(intercept)
    for name, c in zip(features, coef):
        out = out + F.col(name).cast("double") * F.lit(c)
    return out


def ridge_leave_one_out(df: DataFrame, features: Sequence[str], label: str,
                        alphas: Sequence[float] = (0.1, 1.0, 10.0)) -> DataFrame:
    """Leave-one-out mean squared error of ridge regression for each penalty, exactly.

    Leaving a row out changes its residual by the factor ``1 / (1 - h)``, where ``h`` is the
    row's leverage: two aggregations and one pass give what n fits would. ``(alpha, loo_mse, n)``.
    """
    state = ridge_state(df, features, label)
    rows = df.dropna(subset=[*features, label])
    centred = [F.col(c).cast("double") - F.lit(m) for c, m in zip(features, state["means"])]
    errors = []
    for alpha in alphas:
        coef, intercept, inverse = ridge_solve(state, alpha)
        h = F.lit(1.0 / max(state["n"], 1))
        for i, a in enumerate(centred):
            for j, b in enumerate(centred):
                h = h + a * F.lit(inverse[i][j]) * b
        left = (F.col(label).cast("double") - ridge_predict(features, coef, intercept)) / (F.lit(1.0) - h)
        errors.append(F.avg(left * left))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*errors).alias("_e"))
    return out.select(F.explode(F.arrays_zip(
        F.array(*[F.lit(float(a)) for a in alphas]).alias("alpha"), F.col("_e").alias("loo_mse"))).alias("r"), "n") \
        .select("r.alpha", "r.loo_mse", "n")


def group_linear_metrics(df: DataFrame, y: str, x: str, groups: Sequence[str], is_test: str) -> DataFrame:
    """One-feature least squares per group, fitted on its training rows, with metrics on its
    test rows: every group in one aggregation and one join.

    A group whose feature doesn't vary predicts its mean; one without training rows has null
    errors. Groups of test rows alone or training rows alone are kept.
    """
    fit = df.where(F.col(is_test) == 0).groupBy(F.struct(*groups).alias("_g")).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("_m"))
    scored = df.withColumn("_g", F.struct(*groups)).join(fit, "_g", "left").withColumn(
        "_p", F.coalesce(F.col("_a") + F.col("_b") * F.col(x), F.col("_m")))
    return regression_metrics(scored.where(F.col(is_test) == 1), y, "_p", groups)
