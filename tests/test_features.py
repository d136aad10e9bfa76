from tidemark.operators import features as FE


def test_label_dictionary_is_sorted_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "s string")
    d = {r.s: r.code for r in FE.fit_label_dictionary(df, "s").collect()}
    assert d == {"a": 0, "b": 1, "c": 2}
    enc = [r.s for r in FE.label_encode(df, FE.fit_label_dictionary(df, "s"), "s").collect()]
    assert sorted(x for x in enc if x is not None) == [0.0, 0.0, 1.0, 2.0]


def test_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    st = FE.fit_standard_scaler(df, ["a", "b"])
    assert st["a"] == (2.0, 1.0) and st["b"] == (5.0, 1.0)
    got = [(r.a_scaled, r.b_scaled) for r in FE.standardize(df, st).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_one_hot_null_all_zero_and_formula(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, None, 3.0)],
                               "id int, c string, v double")
    oh = {r.id: (r.c_x, r.c_y) for r in FE.one_hot(df, "c", ["x", "y"]).collect()}
    assert oh == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    fd = FE.formula_design(df, ["c"], ["v"], {"c": ["x", "y"]}, keep=["id"])
    assert fd.columns == ["id", "Intercept", "C(c)[T.y]", "v"]
    assert fd.count() == 2


def test_group_stat_imputation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)],
                               "g string, v double")
    med = FE.fit_group_stat(df, "v", ["g"], "median")
    got = sorted((r.g, r.v) for r in FE.impute_group_stat(df, "v", med, ["g"]).collect()
                 if r.g == "a")
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0)]
