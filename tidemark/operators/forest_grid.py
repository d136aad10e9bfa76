"""Cross-validated grids of forests, grown in shared passes.

A grid of forests repeats most of its work. A forest of 300 trees is the beginning of one of 800,
and trees on the same rows part only where their draws of features lead to different cuts. Here
all trees of all maps and folds grow together: a node is a set of rows (a fold left out, a sample,
the cuts on the way), kept once however many trees go through it, with the best cut of each
feature found once. A level is a few jobs, whatever the number of maps; another pass over the rows
scores every size of every forest. What reaches the driver is the size of the model.

The draw of features of a node follows from the seed, the tree's number and the node's place in
it, so a map's score does not depend on the maps that it is searched with.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import split as SP
from tidemark.operators.trees import Trees, _by_entry, _Cuts, _entries, _matrix, _rows, _table, candidate_cuts
from tidemark.session import ensure_checkpoint_dir, fit_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PAIRS = 1 << 18   # (row, node) pairs that a task looks at together
_SUMS = 1 << 21    # sums of a job


class ForestMap(NamedTuple):
    """One point of a grid."""

    n_trees: int
    max_features: int
    bootstrap: bool = True


class _Nodes:
    """Sets of rows. Those before ``len(roots)`` are the roots, as (fold left out, sample or -1).
    A node's options are the cuts that some tree takes there, each with two children side by side."""

    def __init__(self, roots: list[tuple[int, int]]):
        self.roots = np.array(roots).reshape(-1, 2)
        size = len(roots)
        self.n, self.s = np.zeros(size), np.zeros(size)
        self.parent = np.full(size, -1, np.int64)
        self.first, self.number = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.feature, self.cut, self.left = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, node, feature, cut, n_left, s_left) -> np.ndarray:
        """Options of nodes that have none, in ascending order of the nodes; returns the left children."""
        left = len(self.n) + 2 * np.arange(len(node))
        at, starts, number = np.unique(node, return_index=True, return_counts=True)
        self.first[at], self.number[at] = len(self.feature) + starts, number
        self.feature, self.cut = np.append(self.feature, feature), np.append(self.cut, cut)
        self.left = np.append(self.left, left)
        self.n = np.append(self.n, np.stack((n_left, self.n[node] - n_left), axis=1).reshape(-1))
        self.s = np.append(self.s, np.stack((s_left, self.s[node] - s_left), axis=1).reshape(-1))
        more = 2 * len(node)
        self.parent = np.append(self.parent, np.repeat(node, 2))
        self.first, self.number = np.append(self.first, np.zeros(more, np.int64)), np.append(self.number, np.zeros(more, np.int64))
        return left

    def above(self, node: np.ndarray) -> np.ndarray:
        """Marks the nodes and all on the way to them."""
        live = np.zeros(len(self.n), bool)
        while len(node):
            live[node] = True
            node = np.unique(self.parent[node])
            node = node[node >= 0]
        return live

    def reach(self, x: np.ndarray, weight: np.ndarray, live: np.ndarray, depth: int):
        """(row, node, weight) of the rows in live nodes of this depth."""
        row, node = np.nonzero(weight * live[:weight.shape[1]])
        w = weight[row, node]
        for _ in range(depth):
            number = self.number[node]
            whose = np.repeat(np.arange(len(node)), number)
            option = np.arange(len(whose)) - np.repeat(np.cumsum(number) - number, number) + self.first[node][whose]
            node = self.left[option] + (x[row[whose], self.feature[option]] > self.cut[option])
            use = live[node]
            row, node, w = row[whose][use], node[use], w[whose][use]
        return row, node, w


def _draws(seed: int, tree: np.ndarray, place: np.ndarray, p: int) -> np.ndarray:
    """Numbers in [0, 1) for the features of nodes, given the number of the tree and the node's
    place in it (the children of ``i`` are ``2 i + 1`` and ``2 i + 2``): (nodes, features)."""
    with np.errstate(over="ignore"):
        z = (np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + tree.astype(np.uint64)[:, None]) * np.uint64(0xD1342543DE82EF95)
        for part in (place.astype(np.uint64)[:, None], np.arange(p, dtype=np.uint64)[None, :]):
            z = z + (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / 2.0 ** 53


def _weights(roots: np.ndarray, fold: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """How often each row stands in each root."""
    outside = (fold[:, None] != roots[:, 0]).astype(float)
    drawn = roots[:, 1] >= 0
    if drawn.any():
        outside[:, drawn] *= copies[:, roots[drawn, 1]]
    return outside


def _sums(cuts: _Cuts, nodes: _Nodes, live: np.ndarray, slot: np.ndarray, slots: int, depth: int, n_trees: int):
    """Rows and labels of the slots' nodes by bin."""
    bins = int(cuts.start[-1])
    some = max(_PAIRS // max(min(n_trees, int(live.sum())), 1), 1)

    def run(batches):
        total = np.zeros((2, slots * bins))
        for b in batches:
            x, y, fold = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            if not len(x):
                continue
            copies, place = _matrix(b.column(3)), cuts.bins(x)
            for i in range(0, len(x), some):
                part = slice(i, i + some)
                row, node, w = nodes.reach(x[part], _weights(nodes.roots, fold[part], copies[part]), live, depth)
                at = (slot[node][:, None] * bins + place[part][row]).reshape(-1)
                w, wy = np.repeat(w, place.shape[1]), np.repeat(w * y[part][row], place.shape[1])
                total[0] += np.bincount(at, w, slots * bins)
                total[1] += np.bincount(at, wy, slots * bins)
        yield _entries(total)
    return run


def _best_cuts(sums: np.ndarray, cuts: _Cuts, min_instances: int):
    """Gain, cut, rows and labels at or below it for the best cut of every feature in every node,
    each as (nodes, features); the gain is -inf where nothing can be cut. Of equal gains the
    smallest cut is taken; gains are rounded, so that equal ones are equal however added up."""
    slots, p = sums.shape[1], len(cuts.cuts)
    gain, cut, n_left, s_left = np.full((slots, p), -np.inf), *np.zeros((3, slots, p))
    for f, values in enumerate(cuts.cuts):
        if not len(values):
            continue
        n, s = np.cumsum(sums[:, :, cuts.start[f]:cuts.start[f + 1]], axis=2)
        (n_all, s_all), n, s = (n[:, -1:], s[:, -1:]), n[:, :-1], s[:, :-1]
        fits = (n >= max(min_instances, 1)) & (n_all - n >= max(min_instances, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            g = s * s / n + (s_all - s) ** 2 / (n_all - n) - s_all * s_all / n_all
        g = np.where(fits, np.round(g, 9), -np.inf)
        best = g.argmax(axis=1)
        row = np.arange(slots)
        gain[:, f], cut[:, f], n_left[:, f], s_left[:, f] = g[row, best], values[best], n[row, best], s[row, best]
    return gain, cut, n_left, s_left


def _spread(rows: DataFrame) -> DataFrame:
    """The rows, written once in as many parts as the session works on: few bytes can be much
    work here, since a row meets every tree. Each part hands on the sums of all open nodes, so
    parts beyond the cores would be shuffled sums and no gain."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    return rows.repartition(fit_parts(spark, rows.count(), 500)).checkpoint(eager=True)


class ForestGrid:
    """A searched grid: ``metrics`` in the order of ``maps``, ``best`` the first best of them.

    ``trees`` holds all trees, those of fold ``f`` and family ``g`` from ``first[f, g]`` on;
    ``node`` gives the set of rows that each of their nodes stands for."""

    def __init__(self, maps, metrics, best, trees, node, nodes, first):
        self.maps, self.metrics, self.best = maps, metrics, best
        self.trees, self.node, self.nodes, self.first = trees, node, nodes, first

    def table(self, spark: SparkSession, metric: str) -> DataFrame:
        """(params, metric, is_best), one row per map."""
        rows = [(", ".join(f"{k}={v}" for k, v in sorted(m._asdict().items())), None if v != v else float(v), i == self.best)
                for i, (m, v) in enumerate(zip(self.maps, self.metrics))]
        return spark.createDataFrame(rows, f"params string, {metric} double, is_best boolean")


def _losses(trees: Trees, value: np.ndarray, first: np.ndarray, families: list, sizes: dict, places: dict, metric: str):
    """Sum of the losses (or hits) of every map and fold, and rows by fold."""
    k, n_maps = first.shape[0], max(max(v) for v in places.values()) + 1

    def run(batches):
        total, rows = np.zeros((n_maps, k)), np.zeros(k)
        for b in batches:
            x, y, fold = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in np.unique(fold):
                mine = np.flatnonzero(fold == f)
                rows[f] += len(mine)
                for g, family in enumerate(families):
                    most = max(sizes[family])
                    some = max(_PAIRS // most, 1)
                    for i in range(0, len(mine), some):
                        part = mine[i:i + some]
                        leaf = trees.walk(x[part], first[f, g] + np.arange(most))
                        upto = np.cumsum(value[leaf], axis=1)
                        for m, size in zip(places[family], sizes[family]):
                            guess = upto[:, size - 1] / size
                            if metric == "accuracy":
                                hit = np.where(np.isnan(guess), np.nan, (guess > 0.5) == (y[part] > 0.5))
                            else:
                                hit = (guess - y[part]) ** 2
                            total[m, f] += hit.sum()
        slot = np.arange(n_maps * k + k, dtype=np.int32)
        yield _table({"entry": slot, "v": np.append(total.reshape(-1), rows)})
    return run


def forest_grid_cv(df: DataFrame, maps: Sequence[ForestMap], fold: str, k: int, id_col: str, metric: str = "mse",
                   max_depth: int = 5, min_instances: int = 1, seed: int = 0, label: str = "label",
                   features: str = "features", max_cuts: int = 31) -> ForestGrid:
    """The cross-validated ``metric`` (``mse``, or ``accuracy`` of a 0/1 label) of every map.

    A tree of ``ForestMap(n_trees, max_features, bootstrap)`` sees the rows outside its fold, as
    often as its sample holds them (the same samples for all maps). In every node ``max_features``
    of the features that can be cut there are drawn, and the cut that takes most off the squared
    deviations is made (of equals the first feature's smallest), if it takes off anything and
    leaves ``min_instances`` rows on both sides. Cuts lie midway between different values, or at
    quantiles where there are more than ``max_cuts`` + 1. A forest gives the mean of its leaves; an
    accuracy counts it as 1 above a half. Folds are 0 to ``k`` - 1; a metric is the mean over the
    folds that hold rows, and null where a fold that holds rows leaves none to grow on. Labels and
    features aren't null.
    """
    maps = [ForestMap(*m) for m in maps]
    families = list(dict.fromkeys((m.bootstrap, m.max_features) for m in maps))
    places = {g: [i for i, m in enumerate(maps) if (m.bootstrap, m.max_features) == g] for g in families}
    sizes = {g: [maps[i].n_trees for i in places[g]] for g in families}
    samples = max([m.n_trees for m in maps if m.bootstrap], default=0)
    copies = [SP.bootstrap_count(id_col, 1.0, seed + i).cast("double") for i in range(samples)]
    rows = _rows(df, features, label, [F.col(fold).cast("int").alias("fold"),
                                       (F.array(*copies) if copies else F.array(F.lit(0.0))).alias("w")])
    cuts = _Cuts(candidate_cuts(df, features, max_cuts))
    rows = _spread(rows)
    p, bins = len(cuts.cuts), int(cuts.start[-1])
    roots = {(f, b): i for i, (f, b) in enumerate((f, b) for f in range(k) for b in [
        *([-1] if any(not g[0] for g in families) else []), *range(samples)])}
    nodes = _Nodes(list(roots))

    # the trees of every fold and family, each with its number in its forest
    first, of_root, number, draw = np.zeros((k, len(families)), np.int64), [], [], []
    for f in range(k):
        for g, family in enumerate(families):
            first[f, g], most = len(number), max(sizes[family])
            of_root += [roots[f, t if family[0] else -1] for t in range(most)]
            number += range(most)
            draw += [family[1]] * most
    number, draw = np.array(number), np.array(draw)
    trees, node = Trees(len(number)), np.array(of_root)
    tree, own, place = np.arange(len(number)), np.arange(len(number)), np.zeros(len(number), np.int64)
    if not p:
        return ForestGrid(maps, [float("nan")] * len(maps), None, trees, node, nodes, first)

    for depth in range(max(max_depth, 1)):
        here = np.unique(node[own]) if depth else np.arange(len(roots))
        found, each = [], max(_SUMS // (2 * bins), 1)
        for i in range(0, len(here), each):
            some = here[i:i + each]
            slot = np.full(len(nodes.n), -1, np.int64)
            slot[some] = np.arange(len(some))
            work = _sums(cuts, nodes, nodes.above(some), slot, len(some), depth, len(number))
            sums = _by_entry(rows, work, (2, len(some), bins))
            if not depth:
                nodes.n[some], nodes.s[some] = sums[:, :, :cuts.start[1]].sum(axis=2)
            found.append(_best_cuts(sums, cuts, min_instances))
        if not max_depth:
            break
        gain, cut, n_left, s_left = (np.concatenate(v) for v in zip(*found))
        at = np.searchsorted(here, node[own])
        can = np.isfinite(gain[at])
        order = (_draws(seed, number[tree], place, p) + np.where(can, 0.0, 2.0)).argsort(axis=1).argsort(axis=1)
        tried = np.where(can & (order < draw[tree][:, None]), gain[at], -np.inf)
        feature = tried.argmax(axis=1)
        ok = tried[np.arange(len(tried)), feature] > 0
        if not ok.any():
            break
        tree, own, place, at, feature = tree[ok], own[ok], place[ok], at[ok], feature[ok]
        option, which = np.unique(at * p + feature, return_inverse=True)
        o_at, o_feature = option // p, option % p
        left = nodes.add(here[o_at], o_feature, cut[o_at, o_feature], n_left[o_at, o_feature], s_left[o_at, o_feature])
        mine = trees.split(own, feature, cut[at, feature])
        node = np.append(node, np.stack((left[which], left[which] + 1), axis=1).reshape(-1))
        own = np.stack((mine, mine + 1), axis=1).reshape(-1)
        tree = np.repeat(tree, 2)
        place = np.stack((2 * place + 1, 2 * place + 2), axis=1).reshape(-1)
        use = nodes.n[node[own]] >= 2 * max(min_instances, 1)
        tree, own, place = tree[use], own[use], place[use]
        if not len(own):
            break

    with np.errstate(divide="ignore", invalid="ignore"):
        value = (nodes.s / nodes.n)[node]
    got = _by_entry(rows, _losses(trees, value, first, families, sizes, places, metric), (len(maps) * k + k,))
    losses, held = got[:len(maps) * k].reshape(len(maps), k), got[len(maps) * k:]
    metrics = (losses[:, held > 0] / held[held > 0]).mean(axis=1)
    better = -metrics if metric == "mse" else metrics
    known = np.flatnonzero(~np.isnan(better))
    best = int(known[better[known].argmax()]) if len(known) else None
    return ForestGrid(maps, metrics.tolist(), best, trees, node, nodes, first)


class ForestModel:
    """A forest that gives the mean of its leaves."""

    def __init__(self, trees: Trees, value: np.ndarray, features: str):
        self.trees, self.value, self.features = trees, value, features

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        import pandas as pd

        trees, value = self.trees, self.value

        def score(x):
            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            total = np.zeros(len(rows))
            for row, node in trees.portions(rows):
                total += np.bincount(row, value[node], len(rows))
            return pd.Series(total / trees.n_trees)

        score.__annotations__ = {"x": pd.Series, "return": pd.Series}
        x = F.col(self.features)
        if df.schema[self.features].dataType.simpleString() == "vector":
            x = vector_to_array(x)
        return df.withColumn(out, F.pandas_udf(score, "double")(x))


def forest(df: DataFrame, best: ForestMap, id_col: str, features: str = "features", **more) -> ForestModel:
    """The forest of one map on all rows, grown as :func:`forest_grid_cv` grows it (``more`` goes
    there). Without rows every prediction is null."""
    grid = forest_grid_cv(df.withColumn("_none", F.lit(-1)), [best], "_none", 1, id_col, features=features, **more)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (grid.nodes.s / grid.nodes.n)[grid.node]
    return ForestModel(grid.trees, value, features)
