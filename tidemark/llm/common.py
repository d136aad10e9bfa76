"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts the same way.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Used to cut lineage: a later stage re-reads files that every executor sees, whatever
    executors were lost in between.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(key: str, make):
    """``make()`` once per Python worker process (vocabularies, encoders)."""
    store = sys.__dict__.setdefault("_tidemark_per_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of ``text`` as an array column (JVM-side)."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+", -1), "")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, init) -> Column:
    """Running results of ``op`` over an array of ints: element i holds those up to and with i.

    An array that grows by appending is copied at each step, so the values are taken in runs of
    about the square root of their number: n ** 1.5 copies of a number, not n ** 2.
    """
    start = F.struct(F.lit(init).alias("last"), F.expr("cast(array() as array<int>)").alias("all"))

    def add(acc, x):
        return let(op(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all")))

    def over(v):
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")),
                           lambda i: F.aggregate(F.slice(v, i * width + 1, width), start, add, lambda a: a["all"]))
        return let(runs, joined)

    def joined(runs):
        last = F.aggregate(F.transform(runs, lambda r: F.element_at(r, -1)), start, add, lambda a: a["all"])
        before = F.concat(F.array(F.lit(init)), last)
        return F.flatten(F.zip_with(runs, F.slice(before, 1, F.size(runs)),
                                    lambda r, b: F.transform(r, lambda x: op(b, x))))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.expr("cast(array() as array<int>)")))


#: Characters in a piece of a text that is cut at many places.
PIECE = 1024


def in_pieces(text: Column) -> Column:
    """``text`` as an array of pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in pieces: no step counts
    from the text's beginning."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    a, b = (start % PIECE).cast("int"), (end % PIECE).cast("int")
    first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
    apart = F.concat(F.substring(first, a + 1, F.lit(PIECE)),
                     F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b))
    return F.when(end <= start, "").when(i == j, F.substring(first, a + 1, b - a)).otherwise(apart)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
