"""Compositions: cleaning fit/transform, station workflow, path-derived ids."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import cleaning as CL
from tidemark.plans import registry
from tidemark.plans import traffic as TR
from tidemark.plans.catalog.scans import DEVICE_BUCKETS
from tidemark.session import scratch_path
from tidemark.sources import csv as C

PASSENGERS = "PassengerId long, Pclass int, Name string, Sex string, Age double, SibSp int, " \
             "Parch int, Ticket string, Fare double, Embarked string"


def test_cleaning_uses_training_state(spark):
    train = spark.createDataFrame([
        (1, 1, "Smith, Mr. John", "male", 40.0, 1, 0, "A1", 50.0, "S"),
        (2, 1, "Smith, Mrs. Ann", "female", None, 1, 0, "A1", 0.0, "C"),
        (3, 3, "Brown, Miss. Eve", "female", 8.0, 0, 2, "B7", 7.0, None),
        (4, 3, "Dona, Master. Tom", "male", None, 0, 2, "B8", 9.0, "Q"),
    ], PASSENGERS)
    test = spark.createDataFrame([
        (5, 3, "Green, Dr. Kim", "female", None, 0, 0, "Z9", 0.0, None),
    ], PASSENGERS)
    state = CL.fit(train)
    row = CL.transform(test, state).first()
    # Unseen ticket -> no code; fare 0 -> class-3 median of training fares (7, 9) -> 8.
    assert row.Fare == 8.0
    # Dr + female -> Mrs; the Mrs mean age of training is null (only a null age) -> no AgeFill.
    assert row.Title is not None
    assert row.Embarked is not None  # filled with S, which training knows
    out = CL.transform(train, state).orderBy("PassengerId").collect()
    assert out[1].Fare == 50.0  # zero fare in class 1 -> class-1 median of (50)
    assert [r.Name_length for r in out] == [len(n) for n in
                                            ["Smith, Mr. John", "Smith, Mrs. Ann",
                                             "Brown, Miss. Eve", "Dona, Master. Tom"]]


def test_station_workflow(spark):
    rows = []
    for dev in (101, 202):
        for lane in (11, 12, 31, 32):
            for t in range(20):
                speed = None if t % 7 == 3 else float(60 + t)
                rows.append((dev, lane, 40 + t % 5, 100 + t, t % 10, float(lane + t), speed,
                             f"2024-01-0{1 + t % 3} 0{t % 10}:00:00"))
    df = spark.createDataFrame(rows, "d long, l int, p int, a int, o int, tr double, "
                                     "sp double, tm string")
    path = C.write_csv(df, scratch_path(spark, "stations-test"))
    devices, readings = TR.load_data(spark, path, scratch_path(spark, "stations-test-split"))
    assert sorted(r.Devices for r in devices.collect()) == [101, 202]
    model, metrics = TR.build_one_device(readings, 101, num_trees=5)
    assert sorted(r.Lane for r in metrics.collect()) == [11, 12, 31, 32]
    fleet = TR.build_model(readings, num_trees=5)
    out = TR.model_predict(fleet, readings)
    assert set(out.columns) == {"Jtstation", "direction", "predictedValue", "time"}
    assert {r.direction for r in out.select("direction").distinct().collect()} == {"1", "3"}


def test_file_name_key(spark):
    df = spark.range(6).select(F.col("id").alias("v"), (F.col("id") % 2).alias("dev"))
    path = C.write_partitioned(df, scratch_path(spark, "by-dev"), ["dev"], fmt="csv")
    raw = C.read_csv(spark, path, "v long", recursiveFileLookup=True)
    got = sorted((r.v, r.dev) for r in raw.select(
        "v", C.source_file_key(r"dev=([0-9]+)/").cast("long").alias("dev")).collect())
    assert got == [(i, i % 2) for i in range(6)]


def _folders(path):
    return sorted(f for f in os.listdir(path.removeprefix("file:")) if "=" in f)


def test_a_split_has_few_folders_however_many_devices(spark):
    """A folder per device made a file, a listing and a rename for every few rows."""
    readings = spark.range(600).select(
        (F.col("id") % 300).alias("d"), F.lit(11).alias("l"), F.lit(1).alias("p"), F.lit(2).alias("a"), F.lit(3).alias("o"),
        F.col("id").cast("double").alias("tr"), F.lit(5.0).alias("sp"), F.lit("2024-01-01 00:00:00").alias("tm"))
    for shift, kind in ((0, "int"), (1 << 40, "bigint")):
        path = C.write_csv(readings.withColumn("d", F.col("d") + shift), scratch_path(spark, "many-mixed"))
        split = scratch_path(spark, "many-split")
        devices, back = TR.load_data(spark, path, split)
        assert len(_folders(split)) <= TR.DEVICE_FOLDERS and dict(back.dtypes)["Devices"] == kind
        assert back.columns == [c for c in C.STATION_SCHEMA.names if c != "Devices"] + ["Devices"]
        assert sorted(r.Devices for r in devices.collect()) == [shift + i for i in range(300)]
        assert sorted((r.Traffic, r.Devices) for r in back.collect()) == [(float(i), shift + i % 300) for i in range(600)]
        one = TR.read_split(spark, split, shift + 7)
        assert sorted(r.Traffic for r in one.collect()) == [7.0, 307.0]
        assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids, most", [([5, 6, 9], 3), ([None, 3], 2), ([-70, -1, 0, 2, 700, None], 6),
                                       (list(range(1000)), 9), ([-2 ** 63, 2 ** 63 - 1, 2 ** 60 + 1], 3)])
def test_ids_come_back_from_ranges_in_the_path(spark, ids, most):
    df = spark.createDataFrame([(i, d, float(i)) for i, d in enumerate(ids)], "event_id long, user_id long, value double")
    path, width = C.write_device_ranges(df, scratch_path(spark, "ranges"), "user_id", 8)
    assert len(_folders(path)) <= most
    raw = C.read_csv(spark, path, "event_id long, value double, place long", recursiveFileLookup=True)
    first = F.nullif(C.source_file_key(r"user_id_range=(-?[0-9]+)/"), F.lit("")).cast("long") * width
    assert sorted((r[0], r[1]) for r in raw.select("event_id", first + F.col("place")).collect()) == list(enumerate(ids))


def test_device_from_path_reads_few_files(spark, tmp_path):
    ids = [None, *range(400), 10 ** 12]
    rows = [(i, d, float(i)) for i, d in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["device_from_path"](spark, str(tmp_path))
    assert len(out.inputFiles()) <= 2 * DEVICE_BUCKETS + 2
    assert sorted(tuple(r) for r in out.collect()) == rows


def test_submission_predicts_every_test_row(spark):
    from tidemark.operators import models as MD
    train_rows = [(i, i % 2, 1 + i % 3, f"N{i}, {'Mr.' if i % 2 else 'Mrs.'} X", "male" if i % 2 else "female",
                   float(20 + i % 40) if i % 5 else None, i % 3, i % 2, f"T{i % 7}",
                   float(5 + i % 50), None, "S" if i % 3 else "C") for i in range(60)]
    test_rows = [(100 + i, 1 + i % 3, f"M{i}, Miss. Y", "female", None, 0, 0, f"Q{i}", 0.0, None,
                  None) for i in range(7)]
    train = spark.createDataFrame(train_rows, C.PASSENGER_TRAIN_SCHEMA)
    test = spark.createDataFrame(test_rows, C.PASSENGER_TEST_SCHEMA)
    sub = CL.submission(train, test, MD.decision_tree(3))
    got = sorted(r.PassengerId for r in sub.collect())
    assert got == list(range(100, 107))
    assert set(sub.columns) == {"PassengerId", "Survived"}


def test_a_device_is_read_from_its_folder_alone(spark):
    rows = [(i, None if i % 11 == 0 else i % 13, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, dev long, v double")
    path = C.write_device_files(df, scratch_path(spark, "by-bucket"), "dev", 4)
    for dev in (0, 5, 12, 99):
        got = C.read_device(spark, path, "dev", dev, "id long, dev long, v double", 4)
        assert sorted(tuple(r) for r in got.collect()) == [r for r in rows if r[1] == dev]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket" not in got.columns
    back = C.read_csv(spark, path, "id long, dev long, v double", recursiveFileLookup=True)
    assert sorted(r.id for r in back.collect()) == list(range(300))  # null devices are written too
