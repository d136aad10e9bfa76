"""Connected components of an edge list that may not fit on one machine.

Edges are first reduced to a spanning forest inside each partition (bounded by the
partition), then contracted with alternating large-star / small-star rounds: every round is
a partial minimum per vertex and an equi-join, so no neighbourhood is ever gathered in one
task. The minima are written before they are joined: a join that shares its exchange with
the aggregation below it can't be split, one of two plain exchanges can, and so a hub's rows
are dealt to several tasks. Each round is written to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved

EDGES = "a long, b long"


def _local_forest(batches):
    """Edges (root, vertex) of the components seen in this partition."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    pairs = [(find(x), x) for x in list(parent)]
    pairs = [(r, x) for r, x in pairs if r != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r for r, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())],
        names=["a", "b"])


def _large_star(e: DataFrame, name: str) -> DataFrame:
    nb = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    m = saved(nb.groupBy("u").agg(F.min("v").alias("lo")).select(
        F.col("u").alias("mu"), F.least("u", "lo").alias("m")), name)
    return (nb.filter("v > u").join(m, F.col("u") == F.col("mu"))
              .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct())


def _small_star(e: DataFrame, name: str) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    m = saved(down.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = (down.join(m.withColumnRenamed("u", "mu"), F.col("u") == F.col("mu"))
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b"))
    return moved.unionAll(m.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def _state(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` for every vertex that is not the smallest of its component.

    ``edges`` has long columns ``a`` and ``b`` in any direction, repeats allowed. The
    component is the smallest vertex id reachable. Vertices that are missing from the
    result are their own component.
    """
    e = saved(edges.select("a", "b").mapInArrow(_local_forest, EDGES), name)
    before = _state(e)
    while before[0]:
        e = saved(_small_star(_large_star(e, name), name), name)
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("b").alias("id"), F.col("a").alias("component"))
