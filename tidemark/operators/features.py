"""Feature building and statistic-based imputation (fit on one table, apply to another).

A *fit* returns small state: literal statistics (one row, fetched to the driver like any
ML estimator does) or a dictionary DataFrame (one row per distinct value). *Transform* is
a lazy column expression or a join against that state, so applying the same fit to a test
table reuses the training statistics (the analysed code refitted encoders and scalers on
the test table; here that is a deliberate choice of the caller, not a side effect).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import series as SR
from tidemark.operators import table as TB


# E1 ------------------------------------------------------------------------------------
def fit_levels(df: DataFrame, col: str, max_levels: int = 10_000) -> list:
    """Sorted distinct non-null values of a low-cardinality column.

    The list becomes literal column names, so its size is checked: a column with more
    than ``max_levels`` values is refused; :func:`one_hot_vector` takes any number.
    """
    vals = (df.where(F.col(col).isNotNull()).select(col).distinct()
              .orderBy(col).limit(max_levels + 1).collect())
    if len(vals) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    return [r[0] for r in vals]


def one_hot(df: DataFrame, col: str, levels: Sequence, prefix: str | None = None,
            drop_source: bool = False) -> DataFrame:
    """One int column per level (``prefix_level``); null or unseen -> all zero.

    Levels come from the training table so train and test get the same columns.
    """
    prefix = prefix or col
    new = {f"{prefix}_{lv}": (F.col(col) == F.lit(lv)).cast("int") for lv in levels}
    new = {k: F.coalesce(v, F.lit(0)) for k, v in new.items()}
    res = df.withColumns(new)
    return res.drop(col) if drop_source else res


# E2 ------------------------------------------------------------------------------------
def fit_label_dictionary(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """(value, code): index of each distinct value in sorted order, 0-based.

    Distinct values are numbered with the skew-safe global position, so a column with
    as many distinct values as rows (a ticket number) is numbered in parallel.
    """
    distinct = df.where(F.col(col).isNotNull()).select(col).distinct()
    return SR.with_position(distinct, [], [col], out=code)


def fit_label_dictionaries(df: DataFrame, cols: Sequence[str], code: str = "code") -> dict[str, DataFrame]:
    """``fit_label_dictionary`` of several columns from one numbering, written once.

    The distinct (column, value) pairs are numbered per column by one skew-safe pass; numbers
    sort as numbers, everything else as text.
    """
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    items = F.array(*[F.struct(
        F.lit(c).alias("column"),
        (F.col(c).cast("double") if numeric(c) else F.lit(None).cast("double")).alias("number"),
        (F.lit(None).cast("string") if numeric(c) else F.col(c).cast("string")).alias("text"))
        for c in cols])
    pairs = (df.select(F.explode(items).alias("i")).select("i.*")
               .where(F.col("number").isNotNull() | F.col("text").isNotNull()).distinct())
    coded = SR.with_position(pairs, ["column"], ["number", "text"], out=code).checkpoint(eager=True)
    return {c: coded.where(F.col("column") == c).select(
        F.col("number" if numeric(c) else "text").cast(kinds[c]).alias(c), code) for c in cols}


def one_hot_vector(df: DataFrame, dictionary: DataFrame, col: str, out: str, code: str = "code") -> DataFrame:
    """One-hot codes as a sparse vector, for columns with any number of values.

    The dictionary stays a table (joined, not listed); a null or unseen value takes the place
    after the last.
    """
    size = dictionary.agg(F.coalesce(F.max(code), F.lit(-1)) + 1).first()[0]
    coded = label_encode(df, dictionary, col, "_code", code).fillna({"_code": float(size)})
    slots = df.sparkSession.range(size + 1).select(F.col("id").cast("double").alias("_code"))
    return (OneHotEncoder(inputCol="_code", outputCol=out, dropLast=False).fit(slots)
            .transform(coded).drop("_code"))


def label_encode(df: DataFrame, dictionary: DataFrame, col: str, out: str | None = None,
                 code: str = "code", as_double: bool = True) -> DataFrame:
    """Replace (or add as ``out``) ``col`` by its dictionary code; unseen -> null.

    A join: AQE broadcasts the dictionary when it is measured small, and it is a
    sort-merge join otherwise (never a collected Python dict).
    """
    out = out or col
    d = dictionary.select(F.col(col).alias("_dk"), F.col(code).alias("_dc"))
    res = df.join(d, df[col] == d["_dk"], "left").drop("_dk")
    val = F.col("_dc").cast("double") if as_double else F.col("_dc")
    return res.withColumn(out, val).drop("_dc")


# E3 ------------------------------------------------------------------------------------
def fit_standard_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and *population* std per column (one aggregate row).

    Spark ML's ``StandardScaler`` divides by the sample std; the analysed scaler used the
    population std and left zero-variance columns unscaled (divide by 1).
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    stats = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        stats[c] = (m, s if (s is not None and s > 0) else 1.0)
    return stats


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                suffix: str = "_scaled") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in stats.items()})


# E4 ------------------------------------------------------------------------------------
def formula_design(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                   levels: Mapping[str, Sequence], keep: Sequence[str] = (),
                   intercept: bool = True) -> DataFrame:
    """Design matrix ``y ~ C(a) + x``: intercept, treatment-coded categories (first level
    dropped), numeric columns as double; rows with a null in any term are dropped."""
    used = list(categorical) + list(numeric)
    d = df.dropna(subset=used)
    cols = [F.col(k) for k in keep]
    if intercept:
        cols.append(F.lit(1.0).alias("Intercept"))
    for c in categorical:
        for lv in list(levels[c])[1:]:
            cols.append((F.col(c) == F.lit(lv)).cast("double").alias(f"C({c})[T.{lv}]"))
    cols += [F.col(c).cast("double").alias(c) for c in numeric]
    return d.select(*cols)


#: Kept under this name for callers that fit features.
small_side = TB.small_side


# E9 ------------------------------------------------------------------------------------
def fit_group_stat(df: DataFrame, value: str, groups: Sequence[str], stat: str = "median",
                   out: str = "_stat") -> DataFrame:
    """Per-group mean or exact median of the non-null values."""
    if stat == "median":
        return TB.group_median(df, value, groups, out=out)
    if stat == "mean":
        return df.groupBy(*groups).agg(F.avg(value).alias(out))
    raise ValueError(stat)


def impute_group_stat(df: DataFrame, value: str, stats: DataFrame, groups: Sequence[str],
                      out: str | None = None, stat_col: str = "_stat") -> DataFrame:
    """Fill nulls of ``value`` with the statistic of the row's group.

    Rows often have few groups, and a shuffle on these would put each in one task: statistics
    that are counted to be small are broadcast, others are joined by shuffle.
    """
    out = out or value
    stats = small_side(stats)
    s = stats.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col(stat_col).alias("_sv"))
    cond = [df[g].eqNullSafe(s[f"_g_{g}"]) for g in groups]
    res = df.join(s, cond, "left").drop(*[f"_g_{g}" for g in groups])
    return res.withColumn(out, F.coalesce(F.col(value), F.col("_sv"))).drop("_sv")


def col_or(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
