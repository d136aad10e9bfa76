"""Classification trees over every different value of a feature, as DataFrame operations.

A level counts rows by (node, feature, value), which ties collapse before the shuffle, adds the
counts up in value order with the skew-safe running total, and takes the best cut of each node
by a partial maximum. No value is binned, no node's values meet in one task, and what reaches the
driver is one row per open node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import series as SR
from tidemark.session import ensure_checkpoint_dir

#: Gains and scores are compared to this many places, so that equal ones are equal in any order.
PLACES = 9


def _purity(n: Column, ones: Column) -> Column:
    """Sum of squared class counts over rows: n less the Gini impurity times n."""
    return (ones * ones + (n - ones) * (n - ones)) / n


def best_cuts(rows: DataFrame, node: str, label: str, features: Sequence[str]) -> DataFrame:
    """``(node, n, ones, gain, f, cut)``: the best cut of every node of a 0/1 label, or null.

    Candidates lie midway between neighbouring different values; the gain is the rows' Gini
    impurity taken away. Of equal gains the first feature's smallest cut is taken. Null values
    stand in no candidate's counts.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    y = F.col(label).cast("long")
    totals = rows.groupBy(node).agg(F.count("*").alias("n"), F.sum(y).alias("ones"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v"))
                                for i, c in enumerate(features)]))
    counted = rows.select(node, y.alias("y"), cells.alias("c")).where("c.v is not null").groupBy(
        node, F.col("c.f").alias("f"), F.col("c.v").alias("v")).agg(F.count("*").alias("w"), F.sum("y").alias("y"))
    upto = SR.with_running_total(counted, [node, "f"], ["v"], "w", "before", "all")
    upto = SR.with_running_total(upto, [node, "f"], ["v"], "y", "ones_before", "ones_all")
    # a cut lies below each value but the smallest: what is before the value goes left
    n, ones = F.col("before"), F.col("ones_before")
    gain = F.round(_purity(n, ones) + _purity(F.col("all") - n, F.col("ones_all") - ones)
                   - _purity(F.col("all"), F.col("ones_all")), PLACES)
    found = upto.where("before > 0").select(node, "f", "v", gain.alias("gain")).where("gain > 0")
    best = found.groupBy(node).agg(F.min_by(F.struct("f", "v", "gain"), F.struct(-F.col("gain"), "f", "v")).alias("b"))
    best = best.select(node, "b.*")
    below = counted.select(F.col(node).alias("_n"), F.col("f").alias("_f"), F.col("v").alias("_v"))
    under = best.join(below, (F.col(node) == F.col("_n")) & (F.col("f") == F.col("_f")) & (F.col("_v") < F.col("v"))) \
        .groupBy(node).agg(F.max("_v").alias("_v"))
    cut = F.col("_v") + (F.col("v") - F.col("_v")) / 2
    chosen = best.join(under, node).select(node, "gain", "f", F.when(cut < F.col("v"), cut).otherwise(F.col("_v")).alias("cut"))
    return totals.join(chosen, node, "left")


class ExactTree:
    """Nodes as {number: (n, ones, gain, feature, cut)}; the children of ``i`` are ``2 i + 1``
    and ``2 i + 2``."""

    def __init__(self, nodes: dict[int, tuple], features: Sequence[str]):
        self.nodes, self.features = nodes, list(features)

    def _walk(self, node: int, leaf) -> Column:
        n, ones, gain, f, cut = self.nodes[node]
        if f is None or 2 * node + 1 not in self.nodes:
            return leaf(node)
        low = F.col(self.features[f]).cast("double") <= F.lit(cut)
        return F.when(low, self._walk(2 * node + 1, leaf)).otherwise(self._walk(2 * node + 2, leaf))

    def node_of(self) -> Column:
        """The node that a row ends in; a null value goes right."""
        return self._walk(0, F.lit) if self.nodes else F.lit(0)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the share of ones in a row's leaf and the class (1 where it is above a half)."""
        share = self._walk(0, lambda i: F.lit(self.nodes[i][1] / self.nodes[i][0])) if self.nodes else F.lit(None)
        return df.withColumn("probability_1", share.cast("double")).withColumn(
            "prediction", (F.col("probability_1") > 0.5).cast("double"))


def exact_tree(df: DataFrame, features: Sequence[str], label: str = "label", max_depth: int = 2) -> ExactTree:
    """A tree over all cuts between different values, grown a level at a time.

    Every node with both classes and a cut that gains is split, down to ``max_depth``.
    """
    tree = ExactTree({}, features)
    for depth in range(max_depth + 1):
        rows = df.withColumn("_node", tree.node_of())
        new = range(2 ** depth - 1, 2 ** (depth + 1) - 1)
        open_ = rows.where(F.col("_node").isin(*new))
        if depth < max_depth:
            found = best_cuts(open_.select("_node", label, *features), "_node", label, features)
        else:
            found = open_.groupBy("_node").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("ones")) \
                .select("*", *[F.lit(None).alias(c) for c in ("gain", "f", "cut")])
        got = found.collect()  # one row per open node
        tree.nodes |= {r["_node"]: (r.n, r.ones, r.gain, r.f, r.cut) for r in got}
        for r in got:  # its children exist from now on, so that rows go there
            if r.f is not None:
                tree.nodes |= {2 * r["_node"] + 1: (0, 0, None, None, None), 2 * r["_node"] + 2: (0, 0, None, None, None)}
        if all(r.f is None for r in got):
            break
    return tree
