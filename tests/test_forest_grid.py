"""Grids of forests grown in shared passes, against plain Python that grows every tree alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest_grid as FG
from tidemark.operators import split as SP

K = 3
MAPS = [FG.ForestMap(2, 1), FG.ForestMap(5, 1), FG.ForestMap(3, 2), FG.ForestMap(4, 2, False), FG.ForestMap(7, 2, False),
        FG.ForestMap(4, 4, False)]


def table(spark, x, y, fold, parts=3):
    rows = [(i, [float(v) for v in r], float(c), int(f)) for i, (r, c, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "id long, features array<double>, label double, fold int").repartition(parts).cache()


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(8)
    x = np.column_stack([r.integers(0, 20, 150), r.integers(0, 4, 150), np.ones(150), r.normal(size=150).round(1)])
    y = (x[:, 0] + 3 * x[:, 1] + 4 * x[:, 3] + r.normal(size=150) > 14).astype(int)
    fold = np.arange(150) % K
    df = table(spark, x, y, fold)
    copies = df.select("id", *[SP.bootstrap_count("id", 1.0, 2 + i).alias(f"b{i}") for i in range(5)]).toPandas()
    return x, y, fold, df, copies.sort_values("id").drop(columns="id").to_numpy()


def plain_tree(x, y, w, t, m, depth, least, place=0):
    """A nested tree on rows with weights: a leaf's mean, or (feature, cut, low, high)."""
    mean = (w * y).sum() / w.sum()
    if depth == 0:
        return mean
    found = {}
    for f in range(x.shape[1]):
        values, best = CUTS[f], None
        for c in values:
            low = x[:, f] <= c
            n, s, n2, s2 = w[low].sum(), (w * y)[low].sum(), w[~low].sum(), (w * y)[~low].sum()
            if n < least or n2 < least:
                continue
            gain = round(s * s / n + s2 * s2 / n2 - (s + s2) ** 2 / (n + n2), 9)
            if best is None or gain > best[0]:
                best = (gain, c)
        if best:
            found[f] = best
    u = FG._draws(2, np.array([t]), np.array([place]), x.shape[1])[0]
    tried = sorted(found, key=lambda f: u[f])[:m]
    if not tried:
        return mean
    f = min(tried, key=lambda f: (-found[f][0], f))
    gain, c = found[f]
    if gain <= 0:
        return mean
    low = x[:, f] <= c
    sides = [plain_tree(x[r], y[r], w[r], t, m, depth - 1, least, 2 * place + i)
             for i, r in ((1, low & (w > 0)), (2, ~low & (w > 0)))]
    return (f, c, *sides)


def guess(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


CUTS = []


def plain_metrics(x, y, fold, copies, maps, depth, least, metric):
    CUTS[:] = [(np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2 for f in range(x.shape[1])]
    out = []
    for m in maps:
        scores = []
        for k in range(K):
            train, held = fold != k, fold == k
            votes = np.zeros(held.sum())
            for t in range(m.n_trees):
                w = copies[train, t] if m.bootstrap else np.ones(train.sum())
                use = w > 0
                tree = plain_tree(x[train][use], y[train][use], w[use], t, m.max_features, depth, least)
                votes += [guess(tree, r) for r in x[held]]
            p = votes / m.n_trees
            scores.append(((p - y[held]) ** 2).mean() if metric == "mse" else ((p > 0.5) == (y[held] > 0.5)).mean())
        out.append(np.mean(scores))
    return out


@pytest.mark.parametrize("metric, depth, least", [("mse", 4, 1), ("accuracy", 3, 4), ("mse", 0, 1)])
def test_metrics_equal_trees_grown_alone(small, metric, depth, least):
    x, y, fold, df, copies = small
    got = FG.forest_grid_cv(df, MAPS, "fold", K, "id", metric, max_depth=depth, min_instances=least, seed=2, max_cuts=99)
    want = plain_metrics(x, y, fold, copies, MAPS, depth, least, metric)
    assert np.allclose(got.metrics, want, atol=1e-9)
    better = [-v if metric == "mse" else v for v in got.metrics]
    assert got.best == better.index(max(better))


def test_a_map_scores_the_same_alone(small):
    df = small[3]
    grid = FG.forest_grid_cv(df, MAPS, "fold", K, "id", max_depth=3, seed=2, max_cuts=99)
    for i in (0, 3):
        alone = FG.forest_grid_cv(df, [MAPS[i]], "fold", K, "id", max_depth=3, seed=2, max_cuts=99)
        assert np.isclose(alone.metrics[0], grid.metrics[i], atol=1e-12)


def test_equal_sets_of_rows_are_kept_once(small):
    df = small[3]
    g = FG.forest_grid_cv(df, [FG.ForestMap(40, 2, False)], "fold", K, "id", max_depth=3, seed=2, max_cuts=99)
    assert len(g.nodes.n) < len(g.node) / 3
    # all features drawn: every tree of a fold is the same one
    one = FG.forest_grid_cv(df, [FG.ForestMap(40, 4, False)], "fold", K, "id", max_depth=3, seed=2, max_cuts=99)
    assert len(one.nodes.n) <= K * 15


def test_many_small_portions_and_jobs_give_the_same(small, monkeypatch):
    df = small[3]
    whole = FG.forest_grid_cv(df, MAPS, "fold", K, "id", max_depth=3, seed=2, max_cuts=99)
    monkeypatch.setattr(FG, "_PAIRS", 50)
    monkeypatch.setattr(FG, "_SUMS", 600)
    parts = FG.forest_grid_cv(df, MAPS, "fold", K, "id", max_depth=3, seed=2, max_cuts=99)
    assert np.allclose(whole.metrics, parts.metrics, atol=1e-12)


def test_no_rows_one_fold_constant_features_and_vectors(spark, small):
    from pyspark.ml.functions import array_to_vector
    df = small[3]
    none = FG.forest_grid_cv(df.limit(0), MAPS, "fold", K, "id")
    assert none.best is None and all(v != v for v in none.metrics)
    assert none.table(spark, "mse").where("mse is null and not is_best").count() == len(MAPS)
    single = FG.forest_grid_cv(df.where("fold = 1"), MAPS[:1], "fold", K, "id")  # nothing to grow on
    assert single.best is None
    flat = table(spark, np.ones((9, 2)), [0, 0, 1] * 3, [0, 1, 2] * 3)
    got = FG.forest_grid_cv(flat.withColumn("label", F.lit(2.0)), [FG.ForestMap(2, 1, False)], "fold", K, "id")
    assert got.metrics == [0.0] and got.best == 0
    vectors = df.withColumn("features", array_to_vector("features"))
    a, b = (FG.forest_grid_cv(d, MAPS[3:4], "fold", K, "id", max_depth=2, seed=2, max_cuts=99).metrics for d in (df, vectors))
    assert np.allclose(a, b)


@pytest.mark.parametrize("best", [MAPS[2], MAPS[3]])
def test_the_best_forest_on_all_rows(small, best):
    x, y, _, df, copies = small
    CUTS[:] = [(np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2 for f in range(x.shape[1])]
    got = FG.forest(df, best, "id", max_depth=3, seed=2, max_cuts=99).transform(df).orderBy("id").toPandas().prediction
    want = np.zeros(len(x))
    for t in range(best.n_trees):
        w = copies[:, t] if best.bootstrap else np.ones(len(x))
        tree = plain_tree(x[w > 0], y[w > 0], w[w > 0], t, best.max_features, 3, 1)
        want += [guess(tree, r) for r in x]
    assert np.allclose(got, want / best.n_trees, atol=1e-12)


def test_a_forest_of_no_rows(small):
    df = small[3]
    assert FG.forest(df.limit(0), MAPS[0], "id").transform(df).where("prediction is null").count() == 150


def test_parts_follow_the_cores(spark):
    """Every part hands on the sums of all open nodes: with 64 parts for 4 cores, 16 times as many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = FG._spread(spark.range(20_000))
        assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == 20_000
        assert FG._spread(spark.range(700)).rdd.getNumPartitions() == 2 and FG._spread(spark.range(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
