"""Linear models from shared sums, against separate fits and closed forms."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import linear as LN
from tidemark.operators import models as MD
from tidemark.operators import split as SP
from tidemark.plans import traffic as TR


@pytest.fixture(scope="module")
def noisy(spark):
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=(500, 3)), r.normal(size=500) * 0.01, np.ones(500)])
    y = (x[:, 0] - 0.7 * x[:, 1] + r.normal(size=500) > 0.2).astype(float)
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, label double")
    return x, y, MD.assemble(df, ["a", "b", "c", "d", "e"]).repartition(3).cache()


def gradient(x, y, m, w=1.0, c=1.0):
    p = 1 / (1 + np.exp(-(x @ m.coef + m.intercept)))
    return c * np.append(x, np.ones((len(x), 1)), axis=1).T @ (w * (p - y))


@pytest.mark.parametrize("c", [1e-3, 0.05, 1.0, 50.0])
def test_l1_optimum_meets_its_conditions(noisy, c):
    x, y, df = noisy
    m, = LN.logistic_l1_fits(df, [c])
    g = gradient(x, y, m, c=c)
    for b, d in zip(m.coef, g):
        assert abs(d) <= 1 + 1e-5 if b == 0 else abs(d + np.sign(b)) <= 1e-5
    assert abs(g[-1]) <= 1e-5 and m.violation <= 1e-6
    if c == 1e-3:
        assert not m.coef.any()  # the penalty keeps every coefficient at zero


def test_shared_fits_equal_separate_ones(noisy):
    """Strengths and weights together give what each gives alone, and what its sample gives."""
    x, y, df = noisy
    counts = F.array(*[SP.bootstrap_count("id", 0.8, 3 + i) for i in range(4)])
    cs = [0.1, 1.0, 1.0, 10.0]
    together = LN.logistic_l1_fits(df.withColumn("w", counts), cs, "w")
    for i, (c, m) in enumerate(zip(cs, together)):
        alone, = LN.logistic_l1_fits(SP.bootstrap_sample(df, "id", 0.8, 3 + i), [c])
        assert np.allclose(m.coef, alone.coef, atol=1e-6) and np.isclose(m.intercept, alone.intercept, atol=1e-6)


def test_l1_agrees_with_the_other_learner(noisy):
    _, _, df = noisy
    m, = LN.logistic_l1_fits(df, [1.0])
    other = MD.logistic_l1(500, 1.0, max_iter=500).fit(df)
    assert np.allclose(m.coef[:4], other.coefficients.toArray()[:4], atol=2e-3)
    a = m.transform(df).select("id", F.col("prediction").alias("p")).join(other.transform(df), "id")
    assert a.where("p <> prediction").count() <= 2


def test_bagging_in_shared_passes_votes_as_one_by_one(noisy):
    _, _, df = noisy
    got = MD.bagging_logistic(df, "id", df, n_models=3, seed=1)
    want = MD.bagging(df, lambda: MD.logistic_l1(400, 1.0, max_iter=500), "id", df, n_models=3, seed=1)
    both = got.join(want.select("id", F.col("mean_vote").alias("v")), "id")
    assert both.count() == 500 and both.where("abs(mean_vote - v) > 0.01").count() <= 5


def test_gram_of_several_targets(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3)) + 1e6
    t = np.column_stack([x @ [1, 2, 3] + 5, r.normal(size=200)])
    rows = [([float(v) for v in a],) for a in np.column_stack([x, t])] + [([None] + [1.0] * 4,), ([float("nan")] + [1.0] * 4,)]
    state = LN.gram(spark.createDataFrame(rows, "row array<double>").repartition(3), "row", 5)
    coef, at = LN.solve(state, 2)
    want, *_ = np.linalg.lstsq(np.column_stack([x - x.mean(0), np.ones(200)]), t, rcond=None)
    assert state["n"] == 200 and np.allclose(coef, want[:3], atol=1e-6)
    assert np.allclose(x @ coef + at, np.column_stack([x - x.mean(0), np.ones(200)]) @ want, atol=1e-4)


def test_direct_steps_equal_least_squares_on_whole_windows(spark):
    r = np.random.default_rng(2)
    series = {k: r.normal(size=n).cumsum() for k, n in (("a", 90), ("b", 60), ("c", 5))}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)],
                               "k string, t long, v double").repartition(4)
    coef, at, names = TR.ar_direct_fit(df, ["k"], ["t"], "v", lags=4, horizon=3, period=7)
    x, y = [], []
    for s in series.values():
        for i in range(4, len(s) - 3):
            ang = 2 * np.pi * i / 7
            x.append([*s[i - 4:i][::-1], np.sin(ang), np.cos(ang), 1.0])
            y.append(s[i + 1:i + 4])
    want, *_ = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)
    assert len(names) == 6 and np.allclose(np.vstack([coef, at]), want)


def test_group_models_equal_separate_least_squares(spark):
    r = np.random.default_rng(3)
    rows = []
    for g, n in (("p", 400), ("q", 30), ("one", 1), (None, 12), ("flat", 20)):
        for _ in range(n):
            a, b = r.normal(size=2) * [1, 1000] + [1e5, 0]
            a = 3.0 if g == "flat" else a
            rows.append((g, float(a), float(b), float(2 * a - b / 7 + r.normal())))
    rows += [("p", None, 1.0, 1.0), ("gone", 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double").repartition(4)
    got = {m.g: m for m in LN.group_least_squares(df, "y", ["a", "b"], ["g"]).collect()}
    assert set(got) == {"p", "q", "one", None, "flat"}
    for g, m in got.items():
        d = np.array([x[1:] for x in rows if x[0] == g and None not in x[1:]])
        assert m.n == len(d)
        mean = d.mean(axis=0)
        c, *_ = np.linalg.lstsq((d - mean)[:, :2] / [1, 1000], (d - mean)[:, 2], rcond=None)
        assert np.allclose((d[:, :2] - mean[:2]) @ np.array(m.coef), (d - mean)[:, :2] / [1, 1000] @ c, atol=1e-5)
        assert np.isclose(m.intercept, mean[2] - np.dot(m.coef, mean[:2]), rtol=1e-9)


@pytest.fixture(scope="module")
def four_classes(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(4, 5)) * 1.5
    y = r.integers(0, 4, 240)
    x = centres[y] + r.normal(size=(240, 5))
    df = spark.createDataFrame([(i, [float(v) for v in a], 2.0 * float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x array<double>, label double").repartition(3)
    return x, y, df.withColumn("features", array_to_vector("x")).cache()


def test_pairwise_planes_are_optimal(four_classes):
    """Each pair's objective has no slope and nowhere around is it smaller."""
    x, y, df = four_classes
    cs = [0.001, 0.1, 10.0]
    for c, m in zip(cs, LN.svm_fits(df, cs)):
        assert len(m.pairs) == 6 and m.slack <= 1e-9 and m.classes == [0.0, 2.0, 4.0, 6.0]
        for (a, b), plane in zip(m.pairs, m.planes):
            use = (y == a) | (y == b)
            xs, sign = x[use], np.where(y[use] == a, 1.0, -1.0)
            short = 1 - sign * (xs @ plane[:-1] + plane[-1])
            got = plane[:-1] @ plane[:-1] / 2 + c / 2 * (np.maximum(short, 0) ** 2).sum()
            slope = np.append(plane[:-1], 0) - c * (np.maximum(short, 0) * sign) @ np.column_stack([xs, np.ones(len(xs))])
            assert np.abs(slope).max() <= 1e-4 * c * len(xs)
            r = np.random.default_rng(0)
            for size in (1e-3, 1e-2, 0.1, 1.0):  # nowhere around is it better
                for _ in range(50):
                    other = plane + size * r.normal(size=6) * (1e-3 + np.abs(plane).max())
                    miss = 1 - sign * (xs @ other[:-1] + other[-1])
                    assert other[:-1] @ other[:-1] / 2 + c / 2 * (np.maximum(miss, 0) ** 2).sum() >= got * (1 - 1e-9)


def test_pairwise_votes(four_classes):
    x, y, df = four_classes
    m, = LN.svm_fits(df, [1.0])
    got = {r.id: r.prediction for r in m.transform(df).collect()}
    votes = np.zeros((len(x), 4), int)
    for (a, b), plane in zip(m.pairs, m.planes):
        side = x @ plane[:-1] + plane[-1] > 0
        votes[side, a] += 1
        votes[~side, b] += 1
    assert [got[i] for i in range(len(x))] == (2.0 * votes.argmax(axis=1)).tolist()
    assert np.mean([got[i] == 2 * y[i] for i in range(len(x))]) > 0.75


def test_pairwise_strengths_together_equal_alone(four_classes):
    _, _, df = four_classes
    both = LN.svm_fits(df, [0.1, 1.0])
    alone, = LN.svm_fits(df, [1.0])
    assert np.allclose(both[1].planes, alone.planes, atol=1e-4)


def test_pairwise_with_one_class_or_none(four_classes):
    _, _, df = four_classes
    one, = LN.svm_fits(df.where("label = 2"), [1.0])
    assert {r.prediction for r in one.transform(df).collect()} == {2.0}
    none, = LN.svm_fits(df.where("id < 0"), [1.0])
    assert none.transform(df).where("prediction is null").count() == 240


def plain_grid(x, y, fold, maps, k):
    out = np.full((len(maps), k), np.nan)
    for f in range(k):
        tx, ty, hx, hy = x[fold != f], y[fold != f], x[fold == f], y[fold == f]
        for i, (alpha, use) in enumerate(maps):
            if len(hy):
                c = tx[:, use] - tx[:, use].mean(axis=0)
                b = np.linalg.solve(c.T @ c + alpha * np.eye(len(use)), c.T @ (ty - ty.mean()))
                out[i, f] = np.mean((hy - ty.mean() - (hx[:, use] - tx[:, use].mean(axis=0)) @ b) ** 2)
    return out


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_a_grid_from_fold_moments_equals_refits(spark, shift):
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 3)) * [1, 5, 0.2] + shift
    y = x @ [2.0, -0.3, 1.0] + r.normal(size=400) + shift
    fold = r.integers(0, 4, 400)
    maps = [(a, u) for a in (0.5, 20.0, 900.0) for u in ([0], [0, 1], [2, 0, 1])]
    rows = [([*map(float, a), float(b)], int(f)) for a, b, f in zip(x, y, fold)]
    odd = [([None, 1.0, 1.0, 1.0], 0), ([float("nan")] * 4, 1), ([9.0] * 4, None), ([9.0] * 4, 7), ([9.0] * 4, -1)]
    df = spark.createDataFrame(rows + odd, "row array<double>, fold int").repartition(5)
    got = LN.ridge_grid_cv(df, "row", 4, maps, k=5)  # the fold 4 has no rows
    want = plain_grid(x, y, fold, maps, 5)
    np.testing.assert_allclose(got.scores, want, rtol=1e-7)
    assert got.best == int(np.argmin(np.nanmean(want, axis=1)))
    alpha, use = maps[got.best]
    c = x[:, use] - x[:, use].mean(axis=0)
    b = np.linalg.solve(c.T @ c + alpha * np.eye(len(use)), c.T @ (y - y.mean()))
    np.testing.assert_allclose(got.coef[use], b, rtol=1e-6)
    np.testing.assert_allclose(got.intercept, y.mean() - x[:, use].mean(axis=0) @ b, rtol=1e-6, atol=1e-6)


def test_equal_maps_give_the_first_and_an_empty_table_no_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([2.0, 4.5], 1), ([3.0, 6.0], 0), ([5.0, 9.0], 1)],
                               "row array<double>, fold int")
    assert LN.ridge_grid_cv(df, "row", 2, [(9.0, [0]), (0.1, [0]), (0.1, [0])], k=2).best == 1
    none = LN.ridge_grid_cv(df.where("fold > 5"), "row", 2, [(1.0, [0])], k=2)
    assert np.isnan(none.scores).all() and not none.coef.any() and none.intercept == 0
    with pytest.raises(ValueError):
        LN.ridge_grid_cv(df, "row", 2, [])
