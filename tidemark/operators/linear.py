"""Linear models from sums over rows: many fits share each pass.

A task adds up what all fits need (a Gram matrix, or gradients and Hessians for every set of
weights), Spark adds the tasks' sums by entry, and the driver solves systems of the size of the
feature list. So bootstrap samples, folds, penalties, targets and groups cost no passes of their
own, and what reaches the driver doesn't grow with the rows.

* :func:`gram` and :func:`solve`: least squares or ridge for several targets at once.
* :func:`ridge_grid_cv`: a cross-validated grid of penalties and feature lists from moments per fold.
* :func:`group_least_squares`: a model for every group, solved where the groups' sums lie.
* :func:`logistic_l1_fits`: L1 logistic regressions for many weights and strengths, each to a
  stated violation of its optimality conditions.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rows(column, width: int) -> np.ndarray:
    """Arrays of ``width`` doubles as a matrix, rows with a null or NaN left out."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return flat[~np.isnan(flat).any(axis=1)]


def _entries(name: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(values.size), pa.int32()), pa.array(values.reshape(-1))],
                                      names=["entry", name])


def _summed(df: DataFrame, work, size: int) -> np.ndarray:
    """The sums of the tasks' ``size`` numbers."""
    got = df.mapInArrow(work, "entry int, v double").groupBy("entry").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("entry").to_numpy()] = got.column("v").to_numpy()
    return out


# --- least squares ------------------------------------------------------------------------------
def gram(df: DataFrame, rows: str, width: int) -> dict:
    """Count, means and centred cross products of the arrays of ``width`` numbers in column
    ``rows``, from two passes; rows with a null or NaN take no part."""
    data = df.select(rows)

    def first(batches):
        total = np.zeros(width + 1)
        for b in batches:
            x = _rows(b.column(0), width)
            total += np.append(x.sum(axis=0), len(x))
        yield _entries("v", total)

    sums = _summed(data, first, width + 1)
    n, means = int(round(sums[-1])), sums[:-1] / max(sums[-1], 1)

    def second(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = _rows(b.column(0), width) - means
            total += x.T @ x
        yield _entries("v", total)

    return {"n": n, "means": means, "cross": _summed(data, second, width * width).reshape(width, width)}


def solve(state: dict, n_targets: int = 1, alpha: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of the last ``n_targets`` columns on those before them, by one
    factorisation: coefficients as (features, targets). ``alpha`` is a ridge penalty. Features
    that don't vary, or that others determine, get the solution of least norm."""
    p = len(state["means"]) - n_targets
    xx, xy = state["cross"][:p, :p] + alpha * np.eye(p), state["cross"][:p, p:]
    coef = np.linalg.pinv(xx, hermitian=True) @ xy
    return coef, state["means"][p:] - state["means"][:p] @ coef


# --- a cross-validated grid ---------------------------------------------------------------------
#: Scores are compared to this many places, so that equal ones are equal in any order of adding.
PLACES = 9


def fold_moments(df: DataFrame, rows: str, width: int, fold: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, moments): for every fold 0 .. k - 1 the sums of ``z z'`` over its rows, where z is
    the array of ``width`` numbers in column ``rows`` less the centre, and a one.

    Two passes: the centre is the mean of all rows, so that no sum is of large numbers that
    nearly cancel. Rows with a null or NaN, or of no fold, take no part.
    """
    data = df.where(F.col(fold).between(0, k - 1)).select(rows, F.col(fold).cast("int").alias("_fold"))

    def parts(batch):
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        whole = ~np.isnan(x).any(axis=1)
        return x[whole], batch.column(1).to_numpy(zero_copy_only=False)[whole]

    def first(batches):
        total = np.zeros(width + 1)
        for b in batches:
            x, _ = parts(b)
            total += np.append(x.sum(axis=0), len(x))
        yield _entries("v", total)

    sums = _summed(data, first, width + 1)
    centre = sums[:-1] / max(sums[-1], 1)

    def second(batches):
        total = np.zeros((k, width + 1, width + 1))
        for b in batches:
            x, f = parts(b)
            z = np.column_stack([x - centre, np.ones(len(x))])
            for i in np.unique(f):
                total[i] += z[f == i].T @ z[f == i]
        yield _entries("v", total)

    return centre, _summed(data, second, k * (width + 1) ** 2).reshape(k, width + 1, width + 1)


def _plane(moments: np.ndarray, alpha: float, use: Sequence[int]) -> np.ndarray:
    """The weights w for which ``w' z`` is the residual of the ridge on the features ``use``."""
    n, use = moments[-1, -1], list(use)
    mean = moments[-1, :-1] / max(n, 1)
    cross = moments[:-1, :-1] - n * np.outer(mean, mean)
    coef = np.linalg.pinv(cross[np.ix_(use, use)] + alpha * np.eye(len(use)), hermitian=True) @ cross[use, -1]
    w = np.zeros(len(moments))
    w[use], w[-2], w[-1] = -coef, 1.0, mean[use] @ coef - mean[-1]
    return w


class RidgeGrid:
    """What a grid search found: ``scores`` as (maps, folds) mean squared errors (NaN for a fold
    without rows), ``means`` over the folds, ``best`` the first map that no other is below, and
    its ``coef`` and ``intercept`` refitted on all rows (0 for a feature that the map leaves out)."""

    def __init__(self, maps, scores, centre, moments):
        self.maps, self.scores = list(maps), scores
        known = ~np.isnan(scores[0])
        self.means = scores[:, known].mean(axis=1) if known.any() else np.full(len(scores), np.nan)
        self.best = int(np.argmin(np.round(self.means, PLACES)))
        w = _plane(moments.sum(axis=0), *self.maps[self.best])
        self.coef = -w[:-2]
        self.intercept = float(centre[-1] - w[-1] - centre[:-1] @ self.coef)


def ridge_grid_cv(df: DataFrame, rows: str, width: int, maps: Sequence[tuple[float, Sequence[int]]],
                  fold: str = "fold", k: int = 5) -> RidgeGrid:
    """Cross-validates every map (penalty, features by position) of a ridge of the last of
    ``width`` numbers on those before it, with ``fold`` holding 0 .. k - 1.

    The rows are read twice, whatever the grid: a fold's training moments are those of all rows
    less its own, and its squared errors come from its own moments. Nothing is refitted on data.
    """
    if not maps:
        raise ValueError("a grid needs at least one map")
    centre, moments = fold_moments(df, rows, width, fold, k)
    total, n = moments.sum(axis=0), moments[:, -1, -1]
    scores = np.full((len(maps), k), np.nan)
    for f in np.flatnonzero(n > 0):
        for i, m in enumerate(maps):
            w = _plane(total - moments[f], *m)
            scores[i, f] = max(w @ moments[f] @ w, 0.0) / n[f]
    return RidgeGrid(maps, scores, centre, moments)


# --- a model per group --------------------------------------------------------------------------
def group_least_squares(df: DataFrame, y: str, features: Sequence[str], groups: Sequence[str],
                        alpha: float = 0.0) -> DataFrame:
    """``(groups..., coef, intercept, n)``: least squares (ridge for ``alpha`` > 0) of ``y`` on
    ``features`` for every group, from one partial aggregation.

    A group is a row of sums, so a hot group costs a row a task and groups are solved in
    parallel. Sums are taken around the group's own means, which one more partial aggregation
    gives. Rows with a null take no part; a group without complete rows is not there; features
    that don't vary in a group, or that others determine, get the solution of least norm.
    """
    p, names = len(features), [*features, y]
    keyed = df.select(F.struct(*groups).alias("_g"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(names)])
    whole = keyed.filter(" and ".join(f"_c{i} is not null" for i in range(p + 1)))
    means = whole.groupBy("_g").agg(F.count("*").alias("n"), *[F.avg(f"_c{i}").alias(f"_m{i}") for i in range(p + 1)])
    # the pass over the rows adds up around a centre that all groups share; the group's means move it
    centre = whole.agg(*[F.avg(f"_c{i}") for i in range(p + 1)]).first()
    at = [F.col(f"_c{i}") - F.lit(float(c or 0.0)) for i, c in enumerate(centre)]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = whole.groupBy("_g").agg(*[F.sum(at[i] * at[j]).alias(f"_s{i}_{j}") for i, j in pairs])
    off = [F.col(f"_m{i}") - F.lit(float(c or 0.0)) for i, c in enumerate(centre)]
    cross = F.array(*[F.col(f"_s{i}_{j}") - F.col("n") * off[i] * off[j] for i, j in pairs])
    stats = means.join(sums, "_g").select("_g", "n", F.array(*[f"_m{i}" for i in range(p + 1)]).alias("m"), cross.alias("c"))
    upper = np.triu_indices(p + 1)

    def run(batches):
        for b in batches:
            m = b.column(2).flatten().to_numpy().reshape(-1, p + 1)
            full = np.zeros((len(m), p + 1, p + 1))
            full[:, upper[0], upper[1]] = b.column(3).flatten().to_numpy().reshape(len(m), -1)
            full[:, upper[1], upper[0]] = full[:, upper[0], upper[1]]
            xx = full[:, :p, :p] + alpha * np.eye(p)
            # scaled to unit variances, so that what counts as no variation doesn't hang on units
            size = np.sqrt(np.maximum(np.einsum("gii->gi", xx), 0))
            size[size <= 1e-9 * (1 + np.abs(m[:, :p]) * np.sqrt(b.column(1).to_numpy())[:, None])] = np.inf
            scaled = np.linalg.pinv(xx / size[:, :, None] / size[:, None, :], rcond=1e-10, hermitian=True)
            coef = np.einsum("gij,gj->gi", scaled, full[:, :p, p] / size) / size
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(coef), pa.list_(pa.float64())),
                 pa.array(m[:, p] - np.einsum("gi,gi->g", coef, m[:, :p])), b.column(1)],
                names=["_g", "coef", "intercept", "n"])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType
    schema = StructType([stats.schema["_g"]]).add("coef", ArrayType(DoubleType())).add("intercept", DoubleType()) \
        .add("n", LongType())
    return stats.mapInArrow(run, schema).select("_g.*", "coef", "intercept", "n")


def predict(features: Sequence[str], coef: str = "coef", intercept: str = "intercept") -> Column:
    """The prediction of a row that has its group's ``coef`` and ``intercept`` beside it."""
    out = F.col(intercept)
    for i, c in enumerate(features):
        out = out + F.get(F.col(coef), F.lit(i)) * F.col(c).cast("double")
    return out


# --- L1 logistic regression ---------------------------------------------------------------------
class LogisticModel:
    """Coefficients of one fit; ``violation`` is how far its optimality conditions are missed."""

    def __init__(self, coef: np.ndarray, intercept: float, violation: float, objective: float, iterations: int,
                 features: str):
        self.coef, self.intercept, self.violation = coef, float(intercept), float(violation)
        self.objective, self.iterations, self.features = float(objective), iterations, features

    def margin(self, x: Column) -> Column:
        out = F.lit(self.intercept)
        for i, c in enumerate(self.coef.tolist()):
            out = out + F.lit(c) * F.get(x, F.lit(i)) if c else out
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (1 where the margin is above 0) and the vector ``probability``."""
        z = self.margin(vector_to_array(F.col(self.features)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
        return df.withColumn("_z", z).withColumns(
            {"prediction": (F.col("_z") > 0).cast("double"), "probability": array_to_vector(F.array(1 - p, p))}).drop("_z")


def _logistic_sums(points: np.ndarray, weighted: bool):
    """Per fit: loss, gradient and upper triangle of the Hessian at its point, in a row."""
    m, q = points.shape
    upper = np.triu_indices(q)

    def run(batches):
        total = np.zeros((m, 1 + q + len(upper[0])))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, q - 1)
            x = np.column_stack((x, np.ones(len(x))))
            y = b.column(1).to_numpy(zero_copy_only=False)
            w = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(x), m) if weighted else np.ones((len(x), m))
            z = x @ points.T
            p = 0.5 * (1 + np.tanh(0.5 * z))
            total[:, 0] += (w * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0)
            total[:, 1:1 + q] += (w * (p - y[:, None])).T @ x
            curve = w * p * (1 - p)
            for i in range(m):
                total[i, 1 + q:] += ((x * curve[:, i:i + 1]).T @ x)[upper]
        yield _entries("v", total)
    return run


def _penalised_step(point: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """The step that minimises the quadratic model plus the L1 norm (the last entry, the
    intercept, is not penalised), by coordinate descent."""
    q, step = len(point), np.zeros(len(point))
    slope = grad.copy()  # of the quadratic at the step
    for _ in range(2000):
        most = 0.0
        for j in range(q):
            h = hess[j, j] + 1e-10
            at = point[j] + step[j]
            free = at - slope[j] / h
            new = free if j == q - 1 else np.sign(free) * max(abs(free) - 1 / h, 0.0)
            move = new - at
            if move:
                step[j] += move
                slope += hess[:, j] * move
                most = max(most, abs(move) * np.sqrt(h))
        if most < 1e-13:
            break
    return step


def violation(point: np.ndarray, grad: np.ndarray) -> float:
    """Largest breach of the optimality conditions: a coefficient of zero needs a gradient within
    1, any other one of exactly minus its sign; the intercept one of zero."""
    b, g = point[:-1], grad[:-1]
    breach = np.where(b == 0, np.maximum(np.abs(g) - 1, 0), np.abs(g + np.sign(b)))
    return float(max(breach.max(initial=0), abs(grad[-1])))


def logistic_l1_fits(df: DataFrame, c: Sequence[float], weights: str | None = None, label: str = "label",
                     features: str = "features", tol: float = 1e-6, max_iter: int = 100) -> list[LogisticModel]:
    """L1 logistic regressions that minimise ``c * sum(weight * loss) + |coef|_1``, one for each
    strength in ``c``; all of them share one job an iteration.

    ``weights`` names an array column with a weight for each fit (how often a bootstrap sample
    holds the row, or 0 for a fold that is held out); without it every row counts once. Each
    iteration is a Newton step on the penalised problem, halved while the objective would rise.
    A fit ends when its optimality conditions hold to ``tol``. Labels are 0 and 1.
    """
    data = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
                     *([F.col(weights).cast("array<double>")] if weights else []))
    width = data.agg(F.max(F.size("x"))).first()[0] or 0
    m, q = len(c), width + 1
    strength = np.asarray(c, float)
    upper = np.triu_indices(q)
    point, trial = np.zeros((m, q)), np.zeros((m, q))
    step, share, best = np.zeros((m, q)), np.ones(m), np.full(m, np.inf)
    miss, rounds, going = np.full(m, np.inf), np.zeros(m, int), np.ones(m, bool)
    for _ in range(max_iter):
        if not going.any():
            break
        got = _summed(data, _logistic_sums(trial, weights is not None), m * (1 + q + len(upper[0])))
        got = got.reshape(m, -1) * strength[:, None]
        for i in np.flatnonzero(going):
            rounds[i] += 1
            value = got[i, 0] + np.abs(trial[i, :-1]).sum()
            if value > best[i] + 1e-12 * abs(best[i]) and share[i] > 1e-6:
                share[i] /= 2
            else:
                grad, hess = got[i, 1:1 + q], np.zeros((q, q))
                hess[upper] = got[i, 1 + q:]
                hess = hess + hess.T - np.diag(np.diag(hess))
                point[i], best[i], share[i] = trial[i], value, 1.0
                miss[i] = violation(point[i], grad)
                if miss[i] <= tol:
                    going[i] = False
                    continue
                step[i] = _penalised_step(point[i], grad, hess)
            trial[i] = point[i] + share[i] * step[i]
    return [LogisticModel(point[i, :-1].copy(), point[i, -1], miss[i], best[i], int(rounds[i]), features) for i in range(m)]


# --- linear support vectors, one against one ----------------------------------------------------
class PairwiseModel:
    """A separating plane for every pair of classes; a row's class is the one with most votes.

    ``slack`` is the largest share of a pair's objective that a further step would take away.
    """

    def __init__(self, classes, pairs, planes: np.ndarray, c: float, slack: float, features: str):
        self.classes, self.pairs, self.planes, self.c = classes, pairs, planes, c
        self.slack, self.features = slack, features

    def votes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.classes)), np.int64)
        side = x @ self.planes[:, :-1].T + self.planes[:, -1] > 0
        for i, (a, b) in enumerate(self.pairs):
            out[:, a] += side[:, i]
            out[:, b] += ~side[:, i]
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the class with most votes; ties go to the smaller, a row on a plane to the second
        of its pair."""
        import pandas as pd

        names = np.array([float(c) for c in self.classes])
        if not len(names):
            return df.withColumn(out, F.lit(None).cast("double"))

        def score(x):
            if not len(x):
                return pd.Series(np.empty(0))
            return pd.Series(names[self.votes(np.stack(x.to_numpy())).argmax(axis=1)])

        score.__annotations__ = {"x": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(score, "double")(vector_to_array(F.col(self.features))))


def _plane_sums(planes: np.ndarray, pairs):
    """Per (strength, pair): squared hinge loss, its gradient and its Hessian."""
    strengths, m, q = planes.shape
    upper = np.triu_indices(q)

    def run(batches):
        total = np.zeros((strengths, m, 1 + q + len(upper[0])))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, q - 1)
            x, y = np.column_stack((x, np.ones(len(x)))), b.column(1).to_numpy(zero_copy_only=False)
            for i, (first, second) in enumerate(pairs):
                use = (y == first) | (y == second)
                xs, sign = x[use], np.where(y[use] == first, 1.0, -1.0)
                for s in range(strengths):
                    short = 1 - sign * (xs @ planes[s, i])  # what a row lacks of margin 1
                    near = short > 0
                    t = total[s, i]
                    t[0] += (short[near] ** 2).sum() / 2
                    t[1:1 + q] -= (short * sign)[near] @ xs[near]
                    t[1 + q:] += (xs[near].T @ xs[near])[upper]
        for s in range(strengths):
            for i in range(m):
                yield pa.RecordBatch.from_arrays([pa.array([s * m + i], pa.int32()), pa.array([total[s, i].tobytes()])],
                                                 names=["fit", "sums"])
    return run


def _added(batches):
    """The sums of each fit, added up in the task that its tasks' sums were sent to."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for fit, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums = np.frombuffer(sums)
            total[fit] = total[fit] + sums if fit in total else sums
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()],
                                                                                  pa.binary())], names=["fit", "sums"])


def svm_fits(df: DataFrame, c: Sequence[float], label: str = "label", features: str = "features",
             tol: float = 1e-10, max_iter: int = 100) -> list[PairwiseModel]:
    """Linear support vector machines, one against one, one model for each strength in ``c``.

    Every pair of classes and every strength is a fit of ``|w|^2 / 2 + c / 2 * sum(hinge^2)`` with
    a free intercept, on the rows of its two classes; all of them share one job an iteration, whose
    sums are added up fit by fit on the executors. Newton steps are halved while the objective
    would rise; a fit ends when a step would take away less than ``tol`` of it. Labels may be any
    numbers; k classes give k (k - 1) / 2 fits a strength, one class or none give none.
    """
    classes = [r[0] for r in df.select(F.col(label).cast("double")).distinct().orderBy(label).collect()]
    code = F.array_position(F.array(*[F.lit(float(v)) for v in classes] or [F.lit(0.0)]), F.col(label).cast("double")) - 1
    data = df.select(vector_to_array(F.col(features)).alias("x"), code.cast("int").alias("y"))
    pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
    p = data.agg(F.max(F.size("x"))).first()[0] or 0
    q, m = p + 1, len(pairs)
    upper, free = np.triu_indices(q), np.diag([1.0] * p + [1e-9])
    point, trial = np.zeros((len(c), m, q)), np.zeros((len(c), m, q))
    step, share, best = np.zeros_like(point), np.ones((len(c), m)), np.full((len(c), m), np.inf)
    slack, going = np.zeros((len(c), m)), np.ones((len(c), m), bool)
    for _ in range(max_iter if m else 0):
        if not going.any():
            break
        got = data.mapInArrow(_plane_sums(trial, pairs), "fit int, sums binary").repartition("fit").mapInArrow(
            _added, "fit int, sums binary").toArrow()
        sums = dict(zip(got.column("fit").to_pylist(), got.column("sums").to_pylist()))
        for s, i in zip(*np.nonzero(going)):
            t = c[s] * np.frombuffer(sums[int(s) * m + int(i)])
            value = trial[s, i, :-1] @ trial[s, i, :-1] / 2 + t[0]
            if value > best[s, i] * (1 + 1e-12) and share[s, i] > 1e-6:
                share[s, i] /= 2
                trial[s, i] = point[s, i] + share[s, i] * step[s, i]
                continue
            point[s, i], best[s, i], share[s, i] = trial[s, i], value, 1.0
            grad = t[1:1 + q] + np.append(point[s, i, :-1], 0.0)
            hess = np.zeros((q, q))
            hess[upper] = t[1 + q:]
            step[s, i] = -np.linalg.solve(hess + hess.T - np.diag(np.diag(hess)) + free, grad)
            slack[s, i] = -(grad @ step[s, i]) / max(value, 1e-300)
            going[s, i] = slack[s, i] > tol
            trial[s, i] = point[s, i] + step[s, i]
    return [PairwiseModel(classes, pairs, point[s], float(v), float(slack[s].max(initial=0.0)), features)
            for s, v in enumerate(c)]
