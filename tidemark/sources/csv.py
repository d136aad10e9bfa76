"""CSV and partitioned-table scans and sinks.

* Schemas are always given (``inferSchema`` would read the data twice and can change
  types between files); a header is skipped and the schema's names apply by position,
  which is also how a file's header is *replaced* by new names.
* Sinks write with the DataFrame writer: one file per task, never funnelled through one
  task. A per-device split of a mixed file is a ``partitionBy`` write in one job; reading
  one device back is a partition filter, pruned at the scan (``PartitionFilters``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

# Station readings: field names and Spark types of the per-device files.
STATION_SCHEMA = T.StructType([
    T.StructField("Devices", T.LongType()),
    T.StructField("Lane", T.IntegerType()),
    T.StructField("PercentageCar", T.IntegerType()),
    T.StructField("AverageDistance", T.IntegerType()),
    T.StructField("TimeOccupy", T.IntegerType()),
    T.StructField("Traffic", T.DoubleType()),
    T.StructField("Speed", T.DoubleType()),
    T.StructField("Time", T.TimestampNTZType()),
])


# Passenger tables: the training file has ``Survived`` after the id, the test file not.
PASSENGER_FIELDS = [
    T.StructField("PassengerId", T.LongType()),
    T.StructField("Pclass", T.IntegerType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Sex", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("SibSp", T.IntegerType()),
    T.StructField("Parch", T.IntegerType()),
    T.StructField("Ticket", T.StringType()),
    T.StructField("Fare", T.DoubleType()),
    T.StructField("Cabin", T.StringType()),
    T.StructField("Embarked", T.StringType()),
]
PASSENGER_TEST_SCHEMA = T.StructType(PASSENGER_FIELDS)
PASSENGER_TRAIN_SCHEMA = T.StructType(
    PASSENGER_FIELDS[:1] + [T.StructField("Survived", T.IntegerType())] + PASSENGER_FIELDS[1:])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             header: bool = True, **options) -> DataFrame:
    """Header CSV scan with a fixed schema (header names are ignored, position rules)."""
    r = (spark.read.schema(schema).option("header", header).option("enforceSchema", True)
         .option("timestampNTZFormat", TS_FORMAT).option("mode", "PERMISSIVE"))
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def read_csv_renamed(spark: SparkSession, path: str, names: Sequence[str],
                     types: Sequence[T.DataType]) -> DataFrame:
    """CSV scan that replaces the file's header by ``names`` (same count, by position)."""
    if len(names) != len(types):
        raise ValueError("names and types must have the same length")
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return read_csv(spark, path, schema)


def write_csv(df: DataFrame, path: str, header: bool = True, quote_all: bool = False,
              mode: str = "overwrite") -> str:
    """CSV sink with a header and no index column; ``quote_all`` quotes every field."""
    (df.write.mode(mode).option("header", header).option("quoteAll", quote_all)
       .option("timestampNTZFormat", TS_FORMAT).csv(path))
    return path


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet",
                      mode: str = "overwrite") -> str:
    """One directory per value of ``by`` (e.g. one per device), written in one job.

    Rows are clustered by the partition columns first so that each task writes few
    files instead of one file per (task, value). The ``rebalance`` hint (rather than a
    plain ``repartition``) lets AQE split a value holding a large share of the rows into
    several advisory-sized tasks, so a hot device is written in parallel.
    """
    by = list(by)
    (df.hint("rebalance", *by).write.mode(mode).partitionBy(*by)
       .format(fmt).option("header", True).save(path))
    return path


def write_device_files(df: DataFrame, path: str, device: str, buckets: int, fmt: str = "csv") -> str:
    """Rows by device in ``buckets`` folders ``bucket=<n>``: a folder per device would be a file
    for every few rows. A device's rows lie in one folder, in as many files as their size calls
    for, and its id is a column of the file."""
    bucket = F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int")
    return write_partitioned(df.withColumn("bucket", bucket), path, ["bucket"], fmt)


def write_device_ranges(df: DataFrame, path: str, device: str, folders: int, fmt: str = "csv") -> tuple[str, int]:
    """Rows by device in about ``folders`` folders ``<device>_range=<n>`` at most; returns (path, width).

    A folder holds the ids from ``n * width`` on, ``width`` of them; a row has its id's distance
    from there as ``place`` and the id itself stands nowhere but in both. With no more ids between
    the smallest and the largest than folders, the width is 1 and each device has a folder. Ids
    below zero count downwards, so that nothing overflows.
    """
    low, high = df.agg(F.min(device), F.max(device)).first()
    width = 1 if low is None else -(-(high - low + 1) // folders)
    split = df.withColumns({"place": (F.col(device) % F.lit(width)).cast("long"),
                            f"{device}_range": F.expr(f"`{device}` div {width}")})
    return write_partitioned(split.drop(device), path, [f"{device}_range"], fmt), width


def read_device(spark: SparkSession, path: str, device: str, value, schema: T.StructType | str, buckets: int,
                fmt: str = "csv") -> DataFrame:
    """One device's rows out of :func:`write_device_files`: the scan opens its folder alone."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    kind = schema[device].dataType
    bucket = F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(buckets)).cast("int")
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    rows = read_partitioned(spark, path, whole, fmt).where(F.col("bucket") == bucket)
    return rows.where(F.col(device) == F.lit(value).cast(kind)).drop("bucket")


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     fmt: str = "parquet") -> DataFrame:
    r = spark.read.format(fmt).option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_one_partition(spark: SparkSession, path: str, column: str, value,
                       fmt: str = "parquet") -> DataFrame:
    """Rows of one partition value; the filter prunes directories at the scan."""
    return read_partitioned(spark, path, fmt=fmt).where(F.col(column) == F.lit(value))


def source_file_key(pattern: str = r"([^/_.]+)[^/]*$") -> F.Column:
    """Identifier taken from the name of the file a row came from (e.g. the device id of
    ``<device>_device.csv``)."""
    return F.regexp_extract(F.input_file_name(), pattern, 1)
