"""Trees grown level by level, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees as TS


def table(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label double").repartition(parts).cache()


@pytest.fixture(scope="module")
def small(spark):
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=120), r.integers(0, 4, 120), np.ones(120), r.normal(size=120).round(1)])
    y = (x[:, 0] + 0.4 * x[:, 1] > 0.6).astype(int) + (x[:, 3] > 1)
    return x, y, table(spark, x, y)


def reach(trees, x):
    """node -> rows that pass through it, row by row."""
    rows = {}
    for i, r in enumerate(x):
        for t in range(trees.n_trees):
            node = t
            rows.setdefault(node, []).append(i)
            while trees.feature[node] >= 0:
                node = int(trees.left[node]) + int(r[trees.feature[node]] > trees.cut[node])
                rows.setdefault(node, []).append(i)
    return rows


def gini(y):
    n = np.bincount(y, minlength=3)
    return len(y) - (n * n).sum() / max(len(y), 1)


def test_chosen_splits_are_the_best_of_those_drawn(small):
    x, y, df = small
    m = TS.extra_trees(df, n_trees=12, max_depth=5, min_instances=2, seed=4)
    rows = reach(m.trees, x)
    for node, mine in rows.items():
        yy, xx = y[mine], x[mine]
        assert m.counts[node].tolist() == np.bincount(yy, minlength=3).tolist()
        if m.trees.feature[node] < 0:
            continue
        fs, cuts = m.drawn[node]
        best = None
        for f, c in zip(fs, cuts):
            if f < 0:
                continue
            assert xx[:, f].min() <= c < xx[:, f].max()  # drawn in this node's own range
            low = xx[:, f] <= c
            if min(low.sum(), (~low).sum()) < 2:
                continue
            gain = round(gini(yy) - gini(yy[low]) - gini(yy[~low]), 9)
            if best is None or gain > best[0]:
                best = (gain, f, c)
        assert (m.trees.feature[node], m.trees.cut[node]) == best[1:]
    # features that vary are as many as asked for, where there are so many
    assert all(len([f for f in fs if f >= 0]) == min(2, (np.ptp(x[rows[n]], axis=0) > 0).sum())
               for n, (fs, _) in m.drawn.items())


def test_cuts_belong_to_their_nodes(small):
    _, _, df = small
    m = TS.extra_trees(df, n_trees=40, max_depth=4, seed=1)
    cuts = [c for fs, cs in m.drawn.values() for f, c in zip(fs, cs) if f >= 0]
    assert len(set(cuts)) == len(cuts) > 100


def test_probabilities_and_importances(small):
    x, y, df = small
    m = TS.extra_trees(df, n_trees=30, max_depth=6, seed=2)
    got = {r.id: r for r in m.transform(df).collect()}
    share = m.counts / m.counts.sum(axis=1, keepdims=True)
    for i, r in enumerate(x):
        p = np.mean([share[m.trees.walk(r[None, :], np.array([t]))[0, 0]] for t in range(30)], axis=0)
        assert np.isclose(got[i].probability_1, p[1]) and got[i].prediction == p.argmax()
    assert np.isclose(m.featureImportances.sum(), 1) and m.featureImportances[2] == 0
    assert np.mean([got[i].prediction == y[i] for i in got]) > 0.85


def test_result_does_not_depend_on_partitions(spark, small):
    x, y, df = small
    a, b = (TS.extra_trees(d, n_trees=6, max_depth=5, seed=9) for d in (df, df.repartition(7)))
    assert a.drawn == b.drawn and (a.counts == b.counts).all()


def test_one_class_and_no_rows(spark, small):
    _, _, df = small
    one = TS.extra_trees(df.where("label = 1").withColumn("label", F.lit(1.0)), n_trees=3)
    assert {r.prediction for r in one.transform(df).collect()} == {1.0}
    assert TS.extra_trees(df.where("id < 0"), n_trees=3).transform(df).count() == df.count()


def cuts_of(x):
    return [(u[:-1] + u[1:]) / 2 for u in (np.unique(x[:, f]) for f in range(x.shape[1]))]


def test_candidate_cuts(spark, small):
    x, _, df = small
    for got, want in zip(TS.candidate_cuts(df), cuts_of(x)):
        assert np.allclose(got, want)
    few = TS.candidate_cuts(df, max_cuts=7)
    assert len(few[0]) == 7 and np.allclose(few[1], cuts_of(x)[1])


def plain_real_adaboost(x, y, rounds, rate, k):
    w, stumps = np.full(len(x), 1 / len(x)), []
    for _ in range(rounds):
        w = w / w.sum()
        best = None
        for f, cuts in enumerate(cuts_of(x)):
            for c in cuts:
                low = x[:, f] <= c
                gain = 0.0
                for side, sign in ((np.ones(len(x), bool), 1), (low, -1), (~low, -1)):
                    cw = np.bincount(y[side], w[side], k)
                    gain += sign * (cw.sum() - (cw ** 2).sum() / cw.sum())
                if best is None or round(gain, 12) > best[0]:
                    best = (round(gain, 12), f, c)
        _, f, c = best
        low = x[:, f] <= c
        logs = np.zeros((len(x), k))
        for side in (low, ~low):
            cw = np.bincount(y[side], w[side], k)
            logs[side] = np.log(np.clip(cw / cw.sum(), np.finfo(float).eps, None))
        stumps.append((f, c, (k - 1) * (logs - logs.mean(axis=1, keepdims=True))))
        code = np.where(np.arange(k)[None, :] == y[:, None], 1.0, -1 / (k - 1))
        w = w * np.exp(-rate * (k - 1) / k * (code * logs).sum(axis=1))
    return stumps


@pytest.mark.parametrize("k", [2, 3])
def test_real_adaboost_equals_a_plain_version(spark, small, k):
    x, y, _ = small
    y = np.minimum(y, k - 1)
    m = TS.real_adaboost(table(spark, x, 10.0 * y), rounds=12, learning_rate=0.75, keep_every=5)
    want = plain_real_adaboost(x, y, 12, 0.75, k)
    assert [s[0] for s in m.stumps] == [s[0] for s in want] and np.allclose([s[1] for s in m.stumps], [s[1] for s in want])
    votes = sum(s[2] for s in want)
    got = {r.id: r.prediction for r in m.transform(table(spark, x, 10.0 * y)).collect()}
    assert [got[i] for i in range(len(x))] == (10.0 * votes.argmax(axis=1)).tolist()
    assert np.isclose(m.featureImportances.sum(), 1)


def test_real_adaboost_ends(spark, small):
    x, y, df = small
    assert TS.real_adaboost(df.where("id < 0")).transform(df).where("prediction is null").count() == len(x)
    one = TS.real_adaboost(df.where("label = 2"), rounds=3)
    assert {r.prediction for r in one.transform(df).collect()} == {2.0}
    sure = TS.real_adaboost(table(spark, x, (x[:, 1] > 1).astype(float)), rounds=9)
    assert len(sure.stumps) == 1
    flat = TS.real_adaboost(table(spark, np.ones((20, 2)), [0, 1] * 10), rounds=9)
    assert flat.stumps == []


def plain_newton(x, y, rows, columns, depth, eta, lam, gamma, child, fraction, seed, rounds):
    margin, leaves = np.zeros(len(x)), []

    def grow(mine, g, h, cols, level):
        G, H = g[mine].sum(), h[mine].sum()
        node = {"w": -eta * G / (H + lam)}
        best = None
        for f in cols if level < depth else []:
            for c in cuts_of(x)[f]:
                low = mine[x[mine, f] <= c]
                gl, hl = g[low].sum(), h[low].sum()
                if len(low) in (0, len(mine)) or hl < child or H - hl < child:
                    continue
                gain = gl ** 2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G ** 2 / (H + lam)
                if gain > 1e-6 and (best is None or round(gain, 10) > best[0]):
                    best = (round(gain, 10), f, c)
        if best:
            gain, f, c = best
            node.update(f=f, c=c, kids=[grow(mine[s], g, h, cols, level + 1) for s in (x[mine, f] <= c, x[mine, f] > c)])
            if gain < gamma and not any("kids" in k for k in node["kids"]):
                del node["kids"]
        return node

    def leaf(node, r):
        while "kids" in node:
            node = node["kids"][int(r[node["f"]] > node["c"])]
        return node["w"]

    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        use = np.flatnonzero(TS.sampled(rows, seed, t, fraction))
        tree = grow(use, p - y, p * (1 - p), columns[t], 0)
        margin = margin + np.array([leaf(tree, r) for r in x])
    return margin


@pytest.mark.parametrize("options", [
    dict(max_depth=2), dict(max_depth=3, gamma=0.9, min_child_weight=2.0, subsample=0.8, colsample=0.8, keep_every=3)])
def test_newton_boosting_equals_a_plain_booster(spark, small, options):
    x, y, _ = small
    y = (y > 0).astype(float)
    df = table(spark, x, y)
    m = TS.newton_boosting(df, "id", rounds=7, seed=5, **options)
    got = {r.id: r for r in m.transform(df).withColumn("r", F.xxhash64("id")).collect()}
    rows = np.array([got[i].r for i in range(len(x))])
    want = plain_newton(x, y, rows, m.columns, options["max_depth"], 0.3, 1.0, options.get("gamma", 0.0),
                        options.get("min_child_weight", 1.0), options.get("subsample", 1.0), 5, 7)
    assert np.allclose([got[i].margin for i in range(len(x))], want)
    assert all(got[i].prediction == (want[i] > 0) for i in range(len(x)))
    if "colsample" in options:
        assert all(len(c) == 3 for c in m.columns) and len({tuple(c) for c in m.columns}) > 1
        share = np.mean([TS.sampled(rows, 5, t, 0.8) for t in range(200)])
        assert 0.78 < share < 0.82


def test_newton_boosting_without_rows(spark, small):
    _, _, df = small
    m = TS.newton_boosting(df.where("id < 0"), "id", rounds=3)
    assert {r.margin for r in m.transform(df).collect()} == {0.0}


def bits(spark, rows=300, parts=3):
    r = np.random.default_rng(8)
    y = r.integers(0, 2, rows)
    x = np.column_stack([np.where(r.random(rows) < share, y, 1 - y) for share in (0.7, 0.8, 0.6)])
    return x, y, table(spark, x, y, parts)


def test_newton_boosting_counts_cells_once(spark, monkeypatch):
    """A round over 0/1 features was a job for each level of its tree."""
    x, _, df = bits(spark)
    options = dict(rounds=25, max_depth=3, eta=0.1, gamma=0.1, min_child_weight=2.0, subsample=0.8, colsample=0.8)
    by_cell = TS.newton_boosting(df, "id", **options)
    monkeypatch.setattr(TS, "_NUMBERS", 0)
    by_rows = TS.newton_boosting(df, "id", **options)
    assert by_cell.columns == by_rows.columns and np.allclose(by_cell.margins(x), by_rows.margins(x))
    assert len(set(by_cell.margins(x).round(9))) > 4
    monkeypatch.undo()
    monkeypatch.setattr(TS, "_node_sums", None)
    assert np.allclose(TS.newton_boosting(df, "id", **options).margins(x), by_rows.margins(x))


@pytest.mark.parametrize("least", [1000, 40])
def test_real_adaboost_in_one_job_equals_a_job_for_each_round(spark, monkeypatch, least):
    r = np.random.default_rng(9)
    x = r.integers(0, 5, (300, 3))
    df = table(spark, x, (x[:, 0] + x[:, 1] + 3 * r.normal(size=300) > 4).astype(float))
    monkeypatch.setattr(TS, "_LEAST_ROWS", least)
    at_once = TS.real_adaboost(df, rounds=11, keep_every=4).stumps
    monkeypatch.setattr(TS, "_TASK_ROWS", 0)
    by_round = TS.real_adaboost(df, rounds=11, keep_every=4).stumps
    assert [s[:2] for s in at_once] == [s[:2] for s in by_round] and len(at_once) == 11
    assert all(np.allclose(a[2:], b[2:]) for a, b in zip(at_once, by_round))


@pytest.mark.parametrize("least", [1000, 100])
def test_gradient_boosting_equals_spark_ml(spark, monkeypatch, least):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tidemark.operators import models as MD

    r = np.random.default_rng(6)
    x = np.column_stack([r.integers(0, 30, 400), r.integers(0, 25, 400), r.integers(0, 2, 400), np.ones(400)])
    y = (x[:, 0] + 0.5 * x[:, 1] + 4 * r.normal(size=400) > 20).astype(float)
    df = table(spark, x, y).withColumn("features", array_to_vector("features"))
    monkeypatch.setattr(TS, "_LEAST_ROWS", least)
    m = MD.boosted_classifier(df, rounds=6, max_depth=3)
    assert isinstance(m, TS.NewtonModel)
    want = MD.gbt_classifier(6, 3).fit(df).transform(df).select("id", vector_to_array("rawPrediction")[1].alias("raw"), "prediction")
    got = m.transform(df).select("id", "margin", F.col("prediction").alias("mine")).join(want, "id").collect()
    assert len(got) == 400 and np.allclose([g.margin for g in got], [g.raw for g in got])
    assert all(g.mine == g.prediction for g in got)


def test_gradient_boosting_of_many_rows_or_other_labels(spark, small, monkeypatch):
    _, _, df = small
    with pytest.raises(ValueError):
        TS.gradient_boosting(df, rounds=2)  # three classes
    assert TS.gradient_boosting(df.where("id < 0"), rounds=2) is None
    one = TS.gradient_boosting(df.where("label = 1"), rounds=2)
    assert {r.prediction for r in one.transform(df).collect()} == {1.0}
    monkeypatch.setattr(TS, "_TASK_ROWS", 0)
    assert TS.gradient_boosting(df.where("label < 2"), rounds=2) is None


@pytest.mark.parametrize("least", [1000, 100])
def test_random_forest_splits_are_the_best_of_all(spark, monkeypatch, least):
    r = np.random.default_rng(6)
    x = np.column_stack([r.integers(0, 30, 300), r.integers(0, 25, 300), r.integers(0, 2, 300), np.ones(300)])
    y = (x[:, 0] + 0.5 * x[:, 1] + 4 * r.normal(size=300) > 20).astype(int)
    df = table(spark, x, y)
    monkeypatch.setattr(TS, "_LEAST_ROWS", least)
    drawn = TS.random_forest(df, 60, max_depth=4, min_instances=2, seed=3)
    assert set(drawn.trees.feature[:60]) >= {0, 1}
    got = {g.id: g for g in drawn.transform(df).collect()}
    assert np.mean([got[i].prediction == y[i] for i in range(300)]) > 0.85
    assert all(abs(g.margin) <= 0.5 and g.prediction == (g.margin > 0) for g in got.values())
    assert max(map(len, ways(drawn.trees))) == 4

    class Once:
        def poisson(self, mean, shape):
            return np.ones(shape, int)

    cuts = TS._Cuts(cuts_of(x))
    work = TS._forest_levels(cuts, 1, 4, 2, 4, 0)
    monkeypatch.setattr(TS, "BarrierTaskContext", type("C", (), {"get": staticmethod(lambda: type("D", (), {"partitionId": lambda s: 0})())}))
    monkeypatch.setattr(TS.np.random, "default_rng", lambda s, make=np.random.default_rng: Once() if isinstance(s, list) else make(s))
    trees, share = work(x, y.astype(float), lambda a, how=np.sum: np.asarray(a, float))
    rows = reach(trees, x)
    for node, mine in rows.items():
        assert np.isclose(share[node], y[mine].mean())
        if trees.feature[node] >= 0:
            best = max((round(gini(y[mine]) - gini(y[mine][low]) - gini(y[mine][~low]), 7), -f, -c)
                       for f, cs in enumerate(cuts_of(x)) for c in cs for low in [x[mine, f] <= c]
                       if min(low.sum(), (~low).sum()) >= 2)
            assert (trees.feature[node], trees.cut[node]) == (-best[1], -best[2])


def ways(trees):
    """The nodes above each node."""
    above = {t: [] for t in range(trees.n_trees)}
    for node in range(len(trees.feature)):
        if trees.feature[node] >= 0:
            for child in (trees.left[node], trees.left[node] + 1):
                above[int(child)] = above[node] + [node]
    return above.values()
