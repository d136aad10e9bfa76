import numpy as np
import pandas as pd

from tidemark.operators import table as TB


def test_group_quantiles_exact(spark):
    rng = np.random.default_rng(0)
    g = rng.choice(["hot", "hot", "hot", "x", "y"], size=301)
    v = rng.normal(size=301).round(4)
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)] + [("x", None)],
                               "g string, v double")
    got = TB.group_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"], partitions=7).toPandas()
    for _, r in got.iterrows():
        vals = v[g == r.g]
        assert np.isclose(r.q25, np.percentile(vals, 25))
        assert np.isclose(r.q50, np.median(vals))
        assert np.isclose(r.q75, np.percentile(vals, 75))


def test_group_mode_smallest_of_ties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "x"), ("b", "z"),
                                ("b", None), ("b", None)], "g string, v string")
    got = {r.g: r.mode for r in TB.group_mode(df, "v", ["g"]).collect()}
    assert got == {"a": "x", "b": "z"}


def test_crosstab_zero_fill_and_transpose(spark):
    df = spark.createDataFrame([("p1", "F"), ("p1", "O"), ("p2", "F")], "prio string, s string")
    ct = {r.prio: (r.F, r.O, r.P) for r in TB.crosstab(df, "prio", "s", ["F", "O", "P"]).collect()}
    assert ct == {"p1": (1, 1, 0), "p2": (1, 0, 0)}
    tr = TB.transpose(TB.crosstab(df, "prio", "s", ["F", "O"]), "prio", ["F", "O"], ["p1", "p2"])
    got = {r.field: (r.p1, r.p2) for r in tr.collect()}
    assert got == {"F": (1, 1), "O": (1, 0)}


def test_rowwise_mode_and_any_null(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, 1.0), (2, 3.0, 1.0, None), (3, None, None, None)],
                               "id int, a double, b double, c double")
    got = {r.id: r.row_mode for r in TB.rowwise_mode(df, ["id"], ["a", "b", "c"]).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: None}
    assert sorted(r.id for r in TB.rows_with_any_null(df).collect()) == [2, 3]


def test_describe_and_correlation(spark):
    pdf = pd.DataFrame({"a": np.arange(10.0), "b": np.arange(10.0) ** 2})
    df = spark.createDataFrame(pdf)
    d = {r.column: r for r in TB.describe_numeric(df).collect()}
    desc = pdf.describe()
    for c in ["a", "b"]:
        for s, name in [("mean", "mean"), ("std", "std"), ("25%", "q25"), ("50%", "q50"),
                        ("75%", "q75"), ("min", "min"), ("max", "max")]:
            assert np.isclose(desc.loc[s, c], d[c][name])
    cm = {(r.col_a, r.col_b): r.corr for r in TB.correlation_matrix(df, ["a", "b"]).collect()}
    assert np.isclose(cm[("a", "b")], pdf.a.corr(pdf.b))


def test_kde_matches_direct_formula(spark):
    x = np.array([1.0, 2.0, 2.5, 4.0, 7.0])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = {r.x: r.density for r in TB.kde_grid(df, "v", [0.0, 2.0, 5.0]).collect()}
    h = x.std(ddof=1) * len(x) ** -0.2
    for g, dens in got.items():
        exp = np.mean(np.exp(-0.5 * ((g - x) / h) ** 2)) / (h * np.sqrt(2 * np.pi))
        assert np.isclose(dens, exp)


def test_schema_report_and_shared_flag(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "b")], "k long, s string")
    rep = {r.column: (r.type, r.non_null) for r in TB.schema_report(df).collect()}
    assert rep == {"k": ("bigint", 3), "s": ("string", 2)}
    fl = sorted((r.s, r.shared) for r in TB.shared_key_flag(df, "k").collect() if r.s)
    assert fl == [("a", 1), ("b", 1)]


def test_quantiles_with_a_dominant_value(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full(200, 7.0), rng.integers(0, 20, size=400).astype(float)])
    g = np.where(rng.random(600) < 0.8, "hot", "cold")
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)], "g string, v double")
    got = {r.g: r for r in TB.group_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"],
                                              partitions=5).collect()}
    for key in ["hot", "cold"]:
        vals = v[g == key]
        for p, nm in [(0.1, "q10"), (0.5, "q50"), (0.9, "q90")]:
            assert np.isclose(got[key][nm], np.percentile(vals, p * 100))
