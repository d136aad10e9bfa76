"""Reproducible splits, folds and samples.

Rows are ordered by ``md5(salt || id)`` -- a seeded pseudo-random order that depends only
on the row's id, so it is stable across runs, cluster sizes and partitionings, and has a
plain-SQL twin. Exact sizes (``ceil(n * f)`` test rows, fold sizes differing by at most
one) come from the skew-safe global/per-class positions; nothing is collected and no
window runs over the whole table in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import series as SR


def hash_order(id_col: str, salt: str = "") -> Column:
    """Seeded pseudo-random sort key of a row, derived from its id."""
    key = F.col(id_col).cast("string")
    if salt:
        key = F.concat(F.lit(salt), key)
    return F.md5(key)


def ranked(df: DataFrame, id_col: str, salt: str = "", groups: Sequence[str] = ()):
    """``df`` with each row's position in seeded order and its group's size.

    Only (group, id) is sorted and written; the rows themselves are joined by id. Repeated ids
    are numbered once: they get the same flag, and sizes count distinct ids.
    """
    ids = df.select(*groups, id_col).distinct().withColumn("_h", hash_order(id_col, salt))
    r = SR.with_position(ids, list(groups), ["_h", id_col], out="_pos", total="_n").drop("_h")
    keys = [*groups, id_col]
    r = r.select(F.struct(*keys).alias("_rk"), "_pos", "_n")
    return df.withColumn("_rk", F.struct(*keys)).join(r, "_rk").drop("_rk")


# K1 ------------------------------------------------------------------------------------
def train_test_split(df: DataFrame, id_col: str, test_fraction: float = 0.25,
                     salt: str = "", out: str = "is_test") -> DataFrame:
    """Flag exactly ``ceil(n * test_fraction)`` rows as test (int 1/0)."""
    r = ranked(df, id_col, salt)
    flag = (F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_fraction))).cast("int")
    return r.withColumn(out, flag).drop("_pos", "_n")


# K2 ------------------------------------------------------------------------------------
def three_way_split(df: DataFrame, id_col: str, fractions=(0.6, 0.2, 0.2), salt: str = "",
                    names=("train", "validation", "test"), out: str = "split") -> DataFrame:
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    r = ranked(df, id_col, salt)
    b1 = F.ceil(F.col("_n") * F.lit(fractions[0]))
    b2 = F.ceil(F.col("_n") * F.lit(fractions[0] + fractions[1]))
    lab = (F.when(F.col("_pos") < b1, F.lit(names[0]))
            .when(F.col("_pos") < b2, F.lit(names[1])).otherwise(F.lit(names[2])))
    return r.withColumn(out, lab).drop("_pos", "_n")


# K3 ------------------------------------------------------------------------------------
def contiguous_fold(pos: Column, n: Column, k: int) -> Column:
    """Fold of a 0-based position for k contiguous folds; the first ``n % k`` folds hold
    one row more (the unshuffled k-fold layout)."""
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(
        r + F.floor((pos - big) / q)).cast("int")


def kfold_assign(df: DataFrame, order: Sequence[str], k: int, out: str = "fold") -> DataFrame:
    """Unshuffled k-fold: contiguous blocks in ``order``."""
    r = SR.with_position(df, [], list(order), out="_pos", total="_n")
    return r.withColumn(out, contiguous_fold(F.col("_pos"), F.col("_n"), k)).drop("_pos", "_n")


# K4 ------------------------------------------------------------------------------------
def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2,
                     salt: str = "", out: str = "is_test") -> DataFrame:
    """Per class, ``ceil(n_class * f)`` rows in seeded order go to test."""
    r = ranked(df, id_col, salt, [label])
    flag = (F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_fraction))).cast("int")
    return r.withColumn(out, flag).drop("_pos", "_n")


def stratified_shuffle_splits(df: DataFrame, id_col: str, label: str, n_splits: int = 10,
                              test_fraction: float = 0.2, out: str = "is_test") -> DataFrame:
    """``n_splits`` independent stratified splits as one long table (split, id, label,
    is_test), usable as explicit folds.

    One pass: every row is repeated once per split (a bounded factor), split ``s`` orders
    rows by ``md5('split<s>:' || id)``, and (split, class) is the series key of a single
    skew-safe numbering -- instead of one job per split.
    """
    rep = df.select(id_col, label, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
                    .alias("split"))
    rep = rep.withColumn("_h", F.md5(F.concat(F.lit("split"), F.col("split").cast("string"),
                                              F.lit(":"), F.col(id_col).cast("string"))))
    r = SR.with_position(rep, ["split", label], ["_h", id_col], out="_pos", total="_n")
    flag = (F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_fraction))).cast("int")
    return r.withColumn(out, flag).select("split", id_col, label, out)


# K5 ------------------------------------------------------------------------------------
def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int, salt: str = "",
                     out: str = "fold") -> DataFrame:
    """Per class, rows in seeded order are dealt to folds round-robin."""
    r = ranked(df, id_col, salt, [label])
    return r.withColumn(out, F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos", "_n")


# K7 ------------------------------------------------------------------------------------
def bootstrap_sample(df: DataFrame, id_col: str, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """Sample with replacement of about ``fraction * n`` rows.

    Every row is repeated as often as a Poisson(``fraction``) count says that is read off a
    hash of (seed, id), so the sample depends on neither partitioning nor retries. Counts
    have a resolution of 1/65536.
    """
    return df.withColumn("_n", F.explode(F.array_repeat(F.lit(0), bootstrap_count(id_col, fraction, seed)))).drop("_n")


def bootstrap_count(id_col: str, fraction: float = 0.8, seed: int = 0) -> Column:
    """How often :func:`bootstrap_sample` holds a row: a weight that stands for the sample."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 4)
    times = F.lit(0)
    for cut in poisson_cuts(fraction):
        times = times + (digits >= cut).cast("int")
    return times


def poisson_cuts(rate: float, resolution: int = 65536) -> list[str]:
    """Hash prefixes from which a Poisson count is at least 1, 2, ... (four hex digits)."""
    cuts, upto, term, k = [], 0.0, math.exp(-rate), 0
    while True:
        upto += term
        cut = round(upto * resolution)
        if cut >= resolution:
            return cuts
        cuts.append(format(cut, "04x"))
        k += 1
        term *= rate / k



def hash_sample(id_col: str, fraction: float, salt: str = "") -> Column:
    """Predicate keeping about ``fraction`` of the rows, decided by the row id alone.

    The first four hex digits of ``md5(salt || id)`` are compared with
    ``fraction * 65536`` written the same way: reproducible across runs and partitionings
    (unlike ``DataFrame.sample``), with resolution 1/65536.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    if fraction >= 1.0:
        return F.lit(True)
    threshold = format(int(round(fraction * 65536)), "04x")
    return F.substring(hash_order(id_col, salt), 1, 4) < F.lit(threshold)
