import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import split as SP


@settings(max_examples=4, deadline=None)
@given(st.integers(min_value=1, max_value=200), st.integers(min_value=2, max_value=9))
def test_contiguous_folds_partition_rows(spark, n, k):
    if n < k:
        return
    df = spark.range(n).withColumnRenamed("id", "i")
    got = sorted((r.i, r.fold) for r in SP.kfold_assign(df, ["i"], k).collect())
    folds = [f for _, f in got]
    assert folds == sorted(folds)  # contiguous in order
    sizes = [folds.count(f) for f in range(k)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert sizes == sorted(sizes, reverse=True)  # the longer folds come first


def test_exact_test_size_and_reproducible(spark):
    df = spark.range(1001).withColumnRenamed("id", "i")
    a = SP.train_test_split(df, "i", 0.3)
    assert a.where("is_test = 1").count() == math.ceil(1001 * 0.3)
    b = SP.train_test_split(df, "i", 0.3)
    assert sorted(r.i for r in a.where("is_test = 1").collect()) == \
        sorted(r.i for r in b.where("is_test = 1").collect())
    c = SP.train_test_split(df, "i", 0.3, salt="other")
    assert sorted(r.i for r in a.where("is_test = 1").collect()) != \
        sorted(r.i for r in c.where("is_test = 1").collect())


def test_stratified_split_and_kfold(spark):
    df = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = SP.stratified_split(df, "i", "y", 0.2)
    per = {r.y: r.n for r in s.where("is_test = 1").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert per == {1: 20, 0: 40}
    f = SP.stratified_kfold(df, "i", "y", 3)
    cnt = {(r.y, r.fold): r.n for r in f.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert all(v in (33, 34, 67, 66) for v in cnt.values()) and len(cnt) == 6
    t = SP.three_way_split(df, "i")
    sizes = {r.split: r.n for r in t.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 180, "validation": 60, "test": 60}
