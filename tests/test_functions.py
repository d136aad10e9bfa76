from pyspark.sql import functions as F

from tidemark.functions import scalar as S


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_first_substring_order_and_dona(spark):
    rows = [("Smith, Mrs. John",), ("Garcia, Dona. Ana",), ("Nobody",)]
    got = one(spark, S.first_substring("n", S.TITLE_SEARCH_ORDER), "n string", rows)
    assert got == ["Mrs", "Don", None]
    got_wb = one(spark, S.first_substring("n", ["Don"], word_boundary=True), "n string", rows)
    assert got_wb == [None, None, None]


def test_fold_title_default_and_strict(spark):
    rows = [("Dr", "male"), ("Dr", "female"), (None, "male"), ("Countess", "female"), ("Xyz", "male")]
    got = one(spark, S.fold_title("t", "s"), "t string, s string", rows)
    assert got == ["Mr", "Mrs", "Master", "Mrs", "Xyz"]
    strict = one(spark, S.fold_title("t", "s", strict_reference=True), "t string, s string", rows)
    assert strict[:3] == ["Mrs", "Mrs", None]


def test_bins_are_right_closed(spark):
    rows = [(10.0,), (10.5,), (30.0,), (60.0,), (60.01,), (None,)]
    got = one(spark, S.bin_right_closed("x"), "x double", rows)
    assert got == ["child", "adult", "adult", "senior", "aged", None]


def test_threshold_presence_zero_null(spark):
    rows = [(7.99,), (8.0,), (None,), (0.0,)]
    assert one(spark, S.threshold_flag("x"), "x double", rows) == ["Low", "High", None, "Low"]
    assert one(spark, S.presence_flag("x"), "x double", rows) == ["Yes", "Yes", "No", "Yes"]
    assert one(spark, S.zero_to_null("x"), "x double", rows) == [7.99, 8.0, None, None]


def test_dict_map_strip_units_paths(spark):
    assert one(spark, S.dict_map("s", S.GENDER_CODES), "s string",
               [("female",), ("male",), ("x",)]) == [0, 1, None]
    assert one(spark, S.strip_units("s"), "s string", [("12.5米",), ("35%",), ("abc",)]) == \
        [12.5, 35.0, None]
    assert one(spark, S.file_stem("p"), "p string", [("/a/b/171170317010013_device.csv",)]) == \
        ["171170317010013"]


def test_calendar_and_parse(spark):
    rows = [("2024-01-01 13:45:10",), ("bad",)]
    ts = S.parse_timestamp("s")
    got = spark.createDataFrame(rows, "s string").select(
        S.weekday_monday0(ts).alias("d"), S.hour_of_day(ts).alias("h"),
        S.time_of_day(ts).alias("t")).collect()
    assert (got[0].d, got[0].h, got[0].t) == (0, 13, "13:45:10")
    assert got[1].d is None


def test_row_mean_skips_nulls(spark):
    got = one(spark, S.row_mean("a", "b"), "a double, b double", [(1.0, 3.0), (None, 4.0), (None, None)])
    assert got == [2.0, 4.0, None]
    assert one(spark, S.format_key("a", "b"), "a long, b string", [(1, "x")]) == ["1_x"]
    assert one(spark, F.lit(1), "a long", [(1,)]) == [1]
