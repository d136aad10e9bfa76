"""Exact trees against a plain search over all cuts."""

import numpy as np
import pytest

from tidemark.operators import exact_tree as XT


def plain(x, y, node=0, depth=3, out=None):
    out = {} if out is None else out
    pure = lambda v: (v.sum() ** 2 + (len(v) - v.sum()) ** 2) / max(len(v), 1)
    best = None
    for f in range(x.shape[1] if depth else 0):
        values = np.unique(x[:, f][~np.isnan(x[:, f])])
        for lo, hi in zip(values, values[1:]):
            low = x[:, f] < hi
            known = ~np.isnan(x[:, f])
            gain = round(pure(y[low & known]) + pure(y[~low & known]) - pure(y[known]), XT.PLACES)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, lo + (hi - lo) / 2)
    out[node] = (len(y), int(y.sum()), *(best or (None, None, None)))
    if best:
        low = x[:, best[1]] <= best[2]
        plain(x[low], y[low], 2 * node + 1, depth - 1, out)
        plain(x[~low], y[~low], 2 * node + 2, depth - 1, out)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_a_plain_search(spark, seed):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=300).round(2), r.integers(0, 3, 300), np.ones(300)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 1) ^ (r.random(300) < 0.1)).astype(int)
    if seed:
        x[r.random(300) < 0.1, 0] = np.nan
    rows = [(*[None if np.isnan(v) else float(v) for v in a], int(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(5)
    tree = XT.exact_tree(df, ["a", "b", "c"], max_depth=3)
    assert tree.nodes == plain(x, y)
    got = tree.transform(df).select("label", "probability_1", "prediction").collect()
    assert all((q.probability_1 > 0.5) == q.prediction for q in got)
    assert np.isclose(sum(q.probability_1 for q in got), y.sum())


def test_pure_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, label int")
    assert XT.exact_tree(df, ["a"]).nodes == {0: (2, 2, None, None, None)}
    none = XT.exact_tree(df.where("a > 5"), ["a"])
    assert none.nodes == {} and none.transform(df).where("probability_1 is null").count() == 2
