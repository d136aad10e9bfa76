"""Trees grown level by level, all trees of a forest at once.

A level is a pass or two over the rows: every task walks its rows down the trees so far, adds
up what the open nodes need and hands on one row per open node, Spark adds these up by node, and
the driver chooses the splits. What reaches it is the size of the model, whatever the rows.
Nothing is kept between passes but the trees, so a lost executor costs its tasks of one pass.

* :func:`extra_trees`: extremely randomised trees. The first pass of a level gives the range of
  every feature in every open node, the second the class counts beside cuts drawn in there.
* :func:`newton_boosting`: trees on gradients and Hessians, with a penalty on leaf weights.

Boosting is thousands of short rounds. Over few rows :func:`real_adaboost`,
:func:`gradient_boosting` and :func:`random_forest` are one job each, whose tasks keep their rows
and tell each other their sums.
"""

from __future__ import annotations

import base64
import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ENTRIES = 1 << 19  # (row, tree) places that a task looks at together
_NUMBERS = 1 << 20  # numbers of rows that the driver keeps for the rounds of a boosting


class Trees:
    """Nodes of all trees in one table: node ``t`` is the root of tree ``t``; the children of a
    node stand side by side. A negative feature marks a leaf."""

    def __init__(self, n_trees: int, batch: int | None = None):
        self.n_trees, self.batch = n_trees, batch
        self.feature = np.full(n_trees, -1, np.int32)
        self.cut = np.zeros(n_trees)
        self.left = np.zeros(n_trees, np.int32)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Gives ``nodes`` two children each; returns the left ones."""
        left = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes] = feature, cut, left
        more = 2 * len(nodes)
        self.feature = np.append(self.feature, np.full(more, -1, np.int32))
        self.cut, self.left = np.append(self.cut, np.zeros(more)), np.append(self.left, np.zeros(more, np.int32))
        return left

    def walk(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Leaf of every row in the given trees, as (rows, trees)."""
        node = np.repeat(np.asarray(trees, np.int64), len(x)).reshape(len(trees), len(x))  # tree by tree: near in memory
        if not node.size:
            return node.T
        flat, row = x.reshape(-1), (np.arange(len(x)) * x.shape[1])[None, :]
        leaf, number = self.feature < 0, np.arange(len(self.feature))
        # a leaf leads to itself: no value is above its cut
        way = np.where(leaf, number, self.left.astype(np.int64)) << 20 | np.where(leaf, 0, self.feature)
        cut, here = np.where(leaf, np.inf, self.cut), np.asarray(trees, np.int64)
        while len(here := here[~leaf[here]]):
            here = np.unique(self.left[here])
            here = np.concatenate((here, here + 1))
            step = way.take(node)
            node = (step >> 20) + (flat.take(row + (step & 0xFFFFF)) > cut.take(node))
        return node.T

    def portions(self, x: np.ndarray):
        """(row numbers, nodes) of all rows in a few trees after the other, ``batch`` at most."""
        some = max(min(_ENTRIES // max(len(x), 1), self.batch or self.n_trees), 1)
        for t in range(0, self.n_trees, some):
            node = self.walk(x, np.arange(t, min(t + some, self.n_trees))).T
            yield np.tile(np.arange(len(x)), len(node)), node.reshape(-1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _rows(df: DataFrame, features: str, label: str, more: Sequence[str] = ()) -> DataFrame:
    x = F.col(features)
    if df.schema[features].dataType.simpleString() == "vector":
        x = vector_to_array(x)
    return df.select(x.alias("x"), F.col(label).cast("double").alias("y"), *more)


def _by_slot(rows: DataFrame, work, names: Sequence[str], how, slots: int) -> np.ndarray:
    """``work`` in every task, its rows put together by slot: (slots, names), NaN where none."""
    parts = rows.mapInArrow(work, "slot int, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("slot").agg(*[h(c).alias(c) for c, h in zip(names, how)]).toArrow()
    out = np.full((slots, len(names)), np.nan)
    out[got.column("slot").to_numpy()] = np.stack([got.column(c).to_numpy() for c in names], axis=1)
    return out


# --- extremely randomised trees -----------------------------------------------------------------
def _ranges(trees: Trees, slot: np.ndarray, slots: int, p: int):
    """Smallest and largest value of each feature in the open nodes."""
    def run(batches):
        lo, hi = np.full((slots, p), np.inf), np.full((slots, p), -np.inf)
        for b in batches:
            x = _matrix(b.column(0))
            columns = np.ascontiguousarray(x.T)
            for row, node in trees.portions(x):
                here = slot[node]
                use = here >= 0
                s, r = here[use], row[use]
                if not len(s):
                    continue
                # numbers of 16 bits are sorted by place, several times as fast
                order = np.argsort((s - s.min()).astype(np.uint16 if np.ptp(s) < 1 << 16 else np.int64), kind="stable")
                s, r = s[order], r[order]
                starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                s = s[starts]
                for f in range(p):
                    v = columns[f][r]
                    lo[s, f] = np.minimum(lo[s, f], np.minimum.reduceat(v, starts))
                    hi[s, f] = np.maximum(hi[s, f], np.maximum.reduceat(v, starts))
        seen = np.flatnonzero(np.isfinite(lo).any(axis=1))
        yield _table({"slot": seen.astype(np.int32), **{f"lo{i}": lo[seen, i] for i in range(p)},
                      **{f"hi{i}": hi[seen, i] for i in range(p)}})
    return run


def _left_counts(trees: Trees, slot: np.ndarray, feature: np.ndarray, cut: np.ndarray, k: int):
    """Rows by class at or below each drawn cut of the open nodes."""
    slots, m = feature.shape

    def run(batches):
        count = np.zeros((slots, m, k))
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy().astype(np.int64)
            flat = x.reshape(-1)
            for row, node in trees.portions(x):
                here = slot[node]
                use = here >= 0
                s, r = here[use], row[use]
                place, at = s * k + y[r], r * x.shape[1]
                for j in range(m):
                    f = feature[s, j]
                    low = (f >= 0) & (flat[at + np.maximum(f, 0)] <= cut[s, j])
                    count[:, j] += np.bincount(place[low], minlength=slots * k).reshape(slots, k)
        seen = np.flatnonzero(count.any(axis=(1, 2)))
        flat = count[seen].reshape(len(seen), m * k)
        yield _table({"slot": seen.astype(np.int32), **{f"c{i}": flat[:, i] for i in range(m * k)}})
    return run


def _gini(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity of class counts (last axis)."""
    n = counts.sum(axis=-1)
    return n - (counts * counts).sum(axis=-1) / np.maximum(n, 1)


class ExtraTreesModel:
    """Extremely randomised trees; the class probabilities of all trees are averaged."""

    def __init__(self, trees: Trees, counts: np.ndarray, features: str, importances: np.ndarray, draws: list):
        self.trees, self.counts, self.features = trees, counts, features
        self.featureImportances, self._draws = importances, draws

    @property
    def drawn(self) -> dict:
        """For every node that was split, the features and cuts it chose from."""
        return {int(node): (f.tolist(), c.tolist()) for part in self._draws for node, f, c in zip(*part)}

    def transform(self, df: DataFrame, out: str = "prediction", prob: str = "probability_1") -> DataFrame:
        """Adds the class with the largest mean probability (ties go to the smaller) and the
        probability of class 1."""
        import pandas as pd

        trees = self.trees
        share = self.counts / np.maximum(self.counts.sum(axis=1, keepdims=True), 1)

        def score(x):
            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            total = np.zeros((len(rows), share.shape[1]))
            for row, node in trees.portions(rows):
                np.add.at(total, row, share[node])
            return pd.Series(list(total / trees.n_trees))

        score.__annotations__ = {"x": pd.Series, "return": pd.Series}
        score = F.pandas_udf(score, "array<double>")
        x = F.col(self.features)
        if df.schema[self.features].dataType.simpleString() == "vector":
            x = vector_to_array(x)
        best = F.array_max(F.transform("_p", lambda v, i: F.struct(v.alias("p"), (-i).alias("neg"))))
        return df.withColumn("_p", score(x)).withColumns(
            {prob: F.get("_p", F.lit(1)), out: (-best["neg"]).cast("double")}).drop("_p")


def extra_trees(df: DataFrame, n_trees: int = 500, max_depth: int = 8, min_instances: int = 1,
                max_features: int | None = None, seed: int = 0, label: str = "label",
                features: str = "features", batch: int | None = None) -> ExtraTreesModel:
    """Trees on all rows, split at cuts drawn for each node.

    In every node the features that vary there are drawn one after the other, ``max_features``
    of them (the square root of their number unless given), each is cut at a place drawn evenly
    between its smallest and largest value in the node, and the cut with the best Gini gain is
    taken (of equals the one drawn first). A node is a leaf if it is pure, ``max_depth`` deep, or
    if every drawn cut leaves fewer than ``min_instances`` rows on a side. All trees grow
    together: a level is two jobs, whatever their number; a task looks at ``batch`` of them at a
    time, or at as many as its memory allows (same trees). Labels are 0, 1, 2, ...; features
    aren't null. Without rows every probability is null.
    """
    rows, rng = _rows(df, features, label), np.random.default_rng(seed)
    base = rows.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).collect()
    k, p = int(max((r.y for r in base), default=0)) + 1, max((r.p for r in base), default=1)
    m = min(max_features or max(int(math.sqrt(p)), 1), p)
    trees, counts = Trees(n_trees, batch), np.zeros((n_trees, k))
    for r in base:
        counts[:, int(r.y)] = r.n
    opened, draws = np.arange(n_trees), []
    of_tree, gain_of = np.arange(n_trees), np.zeros((n_trees, p))
    for depth in range(max_depth):
        n = counts[opened].sum(axis=1)
        opened = opened[(counts[opened].max(axis=1) < n) & (n >= 2 * min_instances)]
        s = len(opened)
        if not s:
            break
        slot = np.full(len(trees.feature), -1, np.int32)
        slot[opened] = np.arange(s)
        names = [f"lo{i}" for i in range(p)] + [f"hi{i}" for i in range(p)]
        ends = _by_slot(rows, _ranges(trees, slot, s, p), names, [F.min] * p + [F.max] * p, s)
        lo, hi = ends[:, :p], ends[:, p:]
        # features that vary come first, in an order of each node's own
        place = rng.random((s, p)) + np.where(hi > lo, 0.0, 2.0)
        feature = np.argsort(place, axis=1)[:, :m]
        low, high = np.take_along_axis(lo, feature, 1), np.take_along_axis(hi, feature, 1)
        cut = low + rng.random((s, m)) * (high - low)
        cut = np.where(cut >= high, low, cut)
        feature = np.where(high > low, feature, -1)
        names = [f"c{i}" for i in range(m * k)]
        below = np.nan_to_num(_by_slot(rows, _left_counts(trees, slot, feature, cut, k), names, [F.sum] * (m * k), s))
        below = below.reshape(s, m, k)
        here = counts[opened][:, None, :]
        above = here - below
        fits = (feature >= 0) & (below.sum(axis=2) >= max(min_instances, 1)) & (above.sum(axis=2) >= max(min_instances, 1))
        # rounded, so that equal gains are equal however they are added up
        gain = np.where(fits, np.round(_gini(here) - _gini(below) - _gini(above), 9), -np.inf)
        best = gain.argmax(axis=1)
        ok = np.flatnonzero(np.isfinite(gain[np.arange(s), best]))
        nodes, b = opened[ok], best[ok]
        left = trees.split(nodes, feature[ok, b], cut[ok, b])
        children = np.stack((below[ok, b], above[ok, b]), axis=1).reshape(-1, k)
        counts = np.concatenate((counts, children))
        of_tree = np.concatenate((of_tree, np.repeat(of_tree[nodes], 2)))
        np.add.at(gain_of, (of_tree[nodes], feature[ok, b]), gain[ok, b])
        draws.append((nodes, feature[ok], cut[ok]))
        opened = np.stack((left, left + 1), axis=1).reshape(-1)
    total = gain_of.sum(axis=1, keepdims=True)
    share = np.divide(gain_of, total, out=np.zeros_like(gain_of), where=total > 0).mean(axis=0)
    return ExtraTreesModel(trees, counts, features, share / share.sum() if share.sum() else share, draws)


# --- histograms over candidate cuts -------------------------------------------------------------
def candidate_cuts(df: DataFrame, features: str = "features", max_cuts: int = 255) -> list[np.ndarray]:
    """Ascending cuts of each feature: midways between its different values where there are at
    most ``max_cuts`` + 1 of them, else ``max_cuts`` quantiles. At most that many numbers a
    feature reach the driver."""
    x = F.col(features)
    if df.schema[features].dataType.simpleString() == "vector":
        x = vector_to_array(x)
    flat = df.select(F.posexplode(x).alias("f", "v"))
    seen = flat.groupBy("f").agg(F.approx_count_distinct("v").alias("about")).collect()
    cuts: dict[int, np.ndarray] = {}
    few = [r.f for r in seen if r.about <= 2 * (max_cuts + 1)]
    if few:
        values = flat.where(F.col("f").isin(few)).distinct().groupBy("f").agg(
            F.sort_array(F.collect_list("v")).alias("v")).collect()  # bounded by the count above
        for r in values:
            if len(r.v) <= max_cuts + 1:
                v = np.array(r.v)
                cuts[r.f] = v[:-1] + (v[1:] - v[:-1]) / 2
                cuts[r.f] = np.where(cuts[r.f] >= v[1:], v[:-1], cuts[r.f])
    rest = [r.f for r in seen if r.f not in cuts]
    if rest:
        places = [(i + 1) / (max_cuts + 1) for i in range(max_cuts)]
        for r in flat.where(F.col("f").isin(rest)).groupBy("f").agg(
                F.percentile_approx("v", places, 100 * max_cuts).alias("q")).collect():
            cuts[r.f] = np.unique(np.array(r.q))
    return [cuts[f] for f in sorted(cuts)]


class _Cuts:
    """All features' cuts in a row; a feature with ``c`` cuts has ``c`` + 1 bins."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.start = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts])))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") + self.start[f] for f, c in enumerate(self.cuts)], axis=1)

    def below(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums at or below each cut, its feature, its value) from sums by bin (first axis)."""
        parts = [np.cumsum(sums[a:b], axis=0)[:-1] for a, b in zip(self.start, self.start[1:])]
        return (np.concatenate(parts), np.repeat(np.arange(len(self.cuts)), [len(c) for c in self.cuts]),
                np.concatenate(self.cuts) if self.cuts else np.empty(0))


def _by_entry(rows: DataFrame, work, shape: tuple) -> np.ndarray:
    """The sums of the tasks' arrays of this shape."""
    got = rows.mapInArrow(work, "entry int, v double").groupBy("entry").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape)
    out.reshape(-1)[got.column("entry").to_numpy()] = got.column("v").to_numpy()
    return out


def _entries(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return _table({"entry": some.astype(np.int32), "v": total.reshape(-1)[some]})


# --- all rounds in one job ----------------------------------------------------------------------
# To tell each other their sums takes tasks over 0.2 s, as long as the work on some 500,000 rows;
# fewer stay in one task.
_TASKS, _TASK_ROWS, _LEAST_ROWS = 16, 1_000_000, 500_000


def _beside(rows: DataFrame) -> DataFrame | None:
    """The rows dealt to tasks that can run beside each other and keep them, a part for each; or
    None for more rows than such tasks hold. Boosting is thousands of short rounds: over few rows
    a job for each costs far more than its work. What the tasks tell each other grows with the
    square of their number, so that many rows take a job for each round."""
    sc = rows.sparkSession.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return None  # Spark starts no such tasks there
    inner = sc._jsc.sc()
    slots = min(inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()), _TASKS)
    n = rows.count()
    if n > slots * _TASK_ROWS:
        return None
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.repartition(max(min(slots, -(-n // _LEAST_ROWS)), 1)).checkpoint(eager=True)


def _in_one_job(rows: DataFrame, work):
    """``work(x, y, add)`` in a task for each part of the rows, all at the same time.
    ``add(array)`` gives every task the same sum of what the tasks handed in (or what another
    ``how`` makes of it). The tasks reach the same result; the first one's is returned."""
    def run(batches):
        context = BarrierTaskContext.get()
        alone = len(context.getTaskInfos()) == 1

        def add(mine, how=np.sum):
            mine = np.ascontiguousarray(mine, dtype=float)
            if alone:
                return mine
            told = context.allGather(base64.b64encode(mine.tobytes()).decode())
            return how([np.frombuffer(base64.b64decode(t)).reshape(mine.shape) for t in told], axis=0)

        batches = [b for b in batches if len(b)]
        columns = [_matrix(b.column(0)) for b in batches]
        x = np.concatenate(columns) if columns else np.empty((0, 0))
        y = np.concatenate([b.column(1).to_numpy() for b in batches]) if batches else np.empty(0)
        made = work(x, y, add)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(made)], pa.binary())], names=["made"])

    return cloudpickle.loads(rows.mapInArrow(run, "made binary", barrier=True).collect()[0].made)


# --- AdaBoost on class probabilities (SAMME.R) --------------------------------------------------
class RealAdaBoostModel:
    """Stumps as (feature, cut, log probabilities at or below, above); ``votes`` are added up."""

    def __init__(self, stumps, classes, features, importances):
        self.stumps, self.classes, self.features, self.featureImportances = stumps, classes, features, importances

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the class with the largest sum of votes; ties go to the smaller."""
        import pandas as pd

        stumps, k = self.stumps, len(self.classes)

        def score(x):
            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            total = np.zeros((len(rows), k))
            for logs in _stump_logs(stumps, rows):
                total += (k - 1) * (logs - logs.mean(axis=1, keepdims=True))
            return pd.Series(np.array(names)[total.argmax(axis=1)] if len(rows) else np.empty(0))

        names = [float(c) for c in self.classes]
        score.__annotations__ = {"x": pd.Series, "return": pd.Series}
        if not names:
            return df.withColumn(out, F.lit(None).cast("double"))
        x = F.col(self.features)
        if df.schema[self.features].dataType.simpleString() == "vector":
            x = vector_to_array(x)
        return df.withColumn(out, F.pandas_udf(score, "double")(x))


def _stump_logs(stumps, x: np.ndarray):
    """Log class probabilities that each stump gives the rows."""
    for f, cut, low, high in stumps:
        yield np.where((x[:, f] <= cut)[:, None], low, high)


def _class_weights(cuts: _Cuts, stumps, k: int, rate: float):
    """Boosting weights by bin and class; rows bring the log weight from before ``stumps``."""
    bins = int(cuts.start[-1])

    def run(batches):
        total = np.zeros((bins, k))
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy().astype(np.int64)
            w = np.exp(b.column(2).to_numpy() + _log_weights(stumps, x, y, k, rate))
            place = cuts.bins(x) if len(x) else np.empty((0, len(cuts.cuts)), int)
            for f in range(place.shape[1]):
                total += np.bincount(place[:, f] * k + y, w, bins * k).reshape(bins, k)
        yield _entries(total)
    return run


def _log_weights(stumps, x, y, k, rate) -> np.ndarray:
    """What the stumps add to log weights, but for an amount that all rows share."""
    logs = np.zeros(len(x))
    code = np.full((len(x), k), -1.0 / max(k - 1, 1))
    code[np.arange(len(x)), y] = 1.0
    for log_p in _stump_logs(stumps, x):
        logs -= rate * (k - 1) / k * (code * log_p).sum(axis=1)
    return logs


def _advanced(stumps, k, rate):
    def run(batches):
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy().astype(np.int64)
            logs = b.column(2).to_numpy() + _log_weights(stumps, x, y, k, rate)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(logs)], names=b.schema.names)
    return run


def real_adaboost(df: DataFrame, rounds: int = 500, learning_rate: float = 0.75, label: str = "label",
                  features: str = "features", max_cuts: int = 255, keep_every: int = 50) -> RealAdaBoostModel:
    """AdaBoost by class probabilities (SAMME.R): depth-1 trees on reweighted rows.

    A round is one job: a row's weight follows from the stumps so far, the tasks add up weights
    by candidate cut and class, the cut with the best weighted Gini gain is taken (of equals the
    first feature's smallest) and its two leaves' class probabilities become votes. Ends early
    when a stump makes no error, or when no cut gains anything. Probabilities are kept above the
    smallest step of a double. Every ``keep_every`` rounds the log weights are written, less a
    common amount that keeps them in range. Labels may be any numbers; features aren't null.
    """
    classes = [r[0] for r in df.select(F.col(label).cast("double")).distinct().orderBy(label).collect()]
    k = len(classes)
    if k < 2:
        return RealAdaBoostModel([], classes, features, np.zeros(0)) if not k else RealAdaBoostModel(
            [(0, np.inf, np.zeros(1), np.zeros(1))], classes, features, np.zeros(0))
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("double")) - 1
    rows = _rows(df.withColumn("_code", code), features, "_code", [F.lit(0.0).alias("m")])
    cuts = _Cuts(candidate_cuts(df, features, max_cuts))
    p = len(cuts.cuts)
    stumps, kept = [], 0
    some = _beside(rows.select("x", "y"))
    if some is not None:
        stumps = _in_one_job(some, _stump_rounds(cuts, k, learning_rate, rounds, keep_every))
        rounds = 0
    for turn in range(rounds):
        if turn - kept == keep_every:
            moved = rows.mapInArrow(_advanced(stumps[kept:], k, learning_rate), rows.schema).checkpoint(eager=True)
            most = moved.agg(F.max("m")).first()[0]
            rows, kept = moved.withColumn("m", F.col("m") - F.lit(most)), turn
        sums = _by_entry(rows, _class_weights(cuts, stumps[kept:], k, learning_rate), (int(cuts.start[-1]), k))
        stump, sure = _best_stump(sums, cuts)
        stumps += [stump] if stump else []
        if sure:
            break
    used = np.bincount([s[0] for s in stumps], minlength=p).astype(float) if stumps else np.zeros(p)
    return RealAdaBoostModel(stumps, classes, features, used / max(used.sum(), 1))


def _best_stump(sums: np.ndarray, cuts: _Cuts):
    """The next stump from boosting weights by bin and class (or None), and whether it is the last."""
    eps = np.finfo(float).eps
    whole = sums[:cuts.start[1]].sum(axis=0)
    low, feature, value = cuts.below(sums / whole.sum())
    whole = whole / whole.sum()
    high = whole - low
    fits = (low.sum(axis=1) > eps) & (high.sum(axis=1) > eps)
    if not fits.any():
        return None, True
    gain = np.where(fits, np.round(_gini(whole) - _gini_weight(low) - _gini_weight(high), 12), -np.inf)
    best = int(gain.argmax())
    leaves = [np.maximum(side[best], 0) / side[best].sum() for side in (low, high)]
    logs = [np.log(np.clip(leaf, eps, None)) for leaf in leaves]
    error = 1 - low[best].max() - high[best].max()
    return (int(feature[best]), float(value[best]), *logs), error <= 1e-12


def _stump_rounds(cuts: _Cuts, k: int, rate: float, rounds: int, keep_every: int):
    """All rounds of :func:`real_adaboost` in tasks that keep their rows."""
    bins = int(cuts.start[-1])

    def run(x, y, add):
        y, logs, stumps = y.astype(np.int64), np.zeros(len(x)), []
        at = [place * k + y for place in cuts.bins(x).T] if len(x) else []
        for turn in range(rounds):
            total = np.zeros((bins, k))
            w = np.exp(logs)
            for place in at:
                total += np.bincount(place, w, bins * k).reshape(bins, k)
            stump, sure = _best_stump(add(total), cuts)
            stumps += [stump] if stump else []
            if sure:
                break
            logs += _log_weights(stumps[-1:], x, y, k, rate)
            if (turn + 1) % keep_every == 0:  # the largest, of all tasks: what each would give is summed up by place
                logs -= add(logs.max() if len(x) else -np.inf, np.max)
        return stumps
    return run


def _gini_weight(w: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity of class weights (last axis)."""
    n = w.sum(axis=-1)
    return n - np.divide((w * w).sum(axis=-1), n, out=np.zeros_like(n), where=n > 0)


# --- gradient boosting --------------------------------------------------------------------------
def _gradient_rounds(cuts: _Cuts, rounds: int, max_depth: int, step: float, min_instances: int):
    """All rounds of :func:`gradient_boosting` in tasks that keep their rows: (trees, what each node adds)."""
    bins, number = int(cuts.start[-1]), [len(c) for c in cuts.cuts]
    # a cut lies behind every bin of a feature but its last
    behind = np.concatenate([np.arange(a, b - 1) for a, b in zip(cuts.start, cuts.start[1:])])
    feature, value_at = np.repeat(np.arange(len(number)), number), np.concatenate(cuts.cuts)
    start = cuts.start[feature]

    def run(x, y, add):
        place = np.ascontiguousarray(cuts.bins(x).T) if len(x) else np.zeros((len(number), 0), int)
        sign, margin = 2 * y - 1, np.zeros(len(x))
        trees, value = Trees(rounds), np.zeros(rounds)
        for turn in range(rounds):
            target = 4 * sign / (1 + np.exp(2 * sign * margin)) if turn else sign
            rate = step if turn else 1.0
            leaf, row, at, opened = np.full(len(x), turn), np.arange(len(x)), np.zeros(len(x), int), np.array([turn])
            for depth in range(max_depth):
                size = len(opened) * bins
                mine = np.zeros((2, size))
                for f in range(len(number)):
                    slot = at * bins + place[f, row]
                    mine += np.bincount(slot, minlength=size), np.bincount(slot, target[row], size)
                sums = add(mine.reshape(2, len(opened), bins))
                n, s = sums[:, :, :cuts.start[1]].sum(axis=2)[:, :, None]
                if not depth:
                    value[turn] = rate * s[0, 0] / n[0, 0]
                upto = np.concatenate((np.zeros((2, len(opened), 1)), sums.cumsum(axis=2)), axis=2)
                n_left, s_left = upto[:, :, behind + 1] - upto[:, :, start]
                fits = (n_left >= min_instances) & (n - n_left >= min_instances)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s_left ** 2 / n_left + (s - s_left) ** 2 / (n - n_left) - s ** 2 / n
                gain = np.where(fits, np.round(gain, 9), -np.inf)
                best = gain.argmax(axis=1) if len(behind) else np.zeros(len(opened), int)
                ok = np.flatnonzero(gain[np.arange(len(opened)), best] > 0) if len(behind) else np.zeros(0, int)
                if not len(ok):
                    break
                best = best[ok]
                left = trees.split(opened[ok], feature[best], value_at[best])
                n_left, s_left, n, s = n_left[ok, best], s_left[ok, best], n[ok, 0], s[ok, 0]
                value = np.append(value, rate * np.stack((s_left / n_left, (s - s_left) / (n - n_left)), axis=1).reshape(-1))
                new = np.full(len(opened), -1)
                new[ok] = np.arange(len(ok))
                at = new[at]
                row, at = row[at >= 0], at[at >= 0]
                over = place[feature[best][at], row] > behind[best][at]
                leaf[row], at = left[at] + over, 2 * at + over
                opened = np.stack((left, left + 1), axis=1).reshape(-1)
            margin += value[leaf]
        return trees, value
    return run


def gradient_boosting(df: DataFrame, rounds: int = 500, max_depth: int = 5, step: float = 0.1, min_instances: int = 1,
                      label: str = "label", features: str = "features", max_cuts: int = 31) -> NewtonModel | None:
    """Boosted classification trees as Spark ML's ``GBTClassifier`` makes them, for few rows: all
    rounds are one job. None for no rows or more than the tasks can keep (see :func:`_beside`).

    The first tree fits the labels as -1 and 1, each other one the negative gradient of
    ``2 log(1 + exp(-2 y F))``; a split is the cut that takes most off the squared deviations, a
    leaf adds ``step`` times its mean (the first tree all of it). Cuts lie midway between different
    values, or at quantiles where there are more than ``max_cuts`` + 1.
    """
    rows = _rows(df, features, label)
    if not rows.where("y is null or y not in (0, 1)").isEmpty():
        raise ValueError("labels are 0 and 1")
    cuts = _Cuts(candidate_cuts(df, features, max_cuts))
    some = _beside(rows) if cuts.cuts else None
    if some is None:
        return None
    return NewtonModel(*_in_one_job(some, _gradient_rounds(cuts, rounds, max_depth, step, min_instances)), 0.0, [], features)


# --- random forest ------------------------------------------------------------------------------
def _forest_levels(cuts: _Cuts, n_trees: int, max_depth: int, min_instances: int, max_features: int, seed: int):
    """The trees of :func:`random_forest`, some at a time, in tasks that keep their rows:
    (trees, share of class 1 in each node)."""
    p, bins, number = len(cuts.cuts), int(cuts.start[-1]), [len(c) for c in cuts.cuts]
    behind = np.concatenate([np.arange(a, b - 1) for a, b in zip(cuts.start, cuts.start[1:])])
    feature, value_at = np.repeat(np.arange(p), number), np.concatenate(cuts.cuts)
    start = cuts.start[feature]

    def run(x, y, add):
        place = np.ascontiguousarray(cuts.bins(x).T) if len(x) else np.zeros((p, 0), int)
        # the draws of features are the same in all tasks, each task draws its own rows
        rng, own = np.random.default_rng(seed), np.random.default_rng([seed, BarrierTaskContext.get().partitionId()])
        trees, share = Trees(n_trees), np.zeros(n_trees)
        some = max(min(25, int(2_000_000 // max(add(np.full(1, len(x)), np.max)[0], 1))), 1)
        for first in range(0, n_trees, some):
            opened = np.arange(first, min(first + some, n_trees))
            times = own.poisson(1.0, (len(opened), len(x)))
            at, row = np.nonzero(times)
            w = times[at, row].astype(float)
            n, s = add(np.stack([np.bincount(at, v, len(opened)) for v in (w, w * y[row])]))
            share[opened] = s / np.maximum(n, 1)
            for _ in range(max_depth if len(behind) else 0):
                size = len(opened) * bins
                drawn = rng.random((len(opened), p)).argsort(axis=1).argsort(axis=1) < max_features
                mine = np.zeros((2, size))
                for f in range(p):
                    here = np.flatnonzero(drawn[at, f])
                    slot = at[here] * bins + place[f, row[here]]
                    mine += np.bincount(slot, w[here], size), np.bincount(slot, w[here] * y[row[here]], size)
                sums = add(mine.reshape(2, len(opened), bins))
                upto = np.concatenate((np.zeros((2, len(opened), 1)), sums.cumsum(axis=2)), axis=2)
                n_left, s_left = upto[:, :, behind + 1] - upto[:, :, start]
                n_all, s_all = n[:, None], s[:, None]
                fits = drawn[:, feature] & (n_left >= min_instances) & (n_all - n_left >= min_instances)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s_left ** 2 / n_left + (s_all - s_left) ** 2 / (n_all - n_left) - s_all ** 2 / n_all
                gain = np.where(fits, np.round(gain, 9), -np.inf)
                best = gain.argmax(axis=1)
                ok = np.flatnonzero(gain[np.arange(len(opened)), best] > 0)
                if not len(ok):
                    break
                best = best[ok]
                left = trees.split(opened[ok], feature[best], value_at[best])
                n_left, s_left = n_left[ok, best], s_left[ok, best]
                n = np.stack((n_left, n[ok] - n_left), axis=1).reshape(-1)
                s = np.stack((s_left, s[ok] - s_left), axis=1).reshape(-1)
                share = np.append(share, s / n)
                new = np.full(len(opened), -1)
                new[ok] = np.arange(len(ok))
                at = new[at]
                row, w, at = row[at >= 0], w[at >= 0], at[at >= 0]
                at = 2 * at + (place[feature[best][at], row] > behind[best][at])
                opened = np.stack((left, left + 1), axis=1).reshape(-1)
        return trees, share
    return run


def random_forest(df: DataFrame, n_trees: int = 500, max_depth: int = 5, min_instances: int = 1,
                  max_features: int | None = None, seed: int = 0, label: str = "label", features: str = "features",
                  max_cuts: int = 31) -> NewtonModel | None:
    """A forest for 0/1 labels as Spark ML's ``RandomForestClassifier`` grows it, for few rows: all
    trees are one job. None for no rows or more than the tasks can keep (see :func:`_beside`).

    A tree sees each row as often as a Poisson draw of mean 1 says; in every node ``max_features``
    of the features are drawn (the square root of their number, rounded up, unless given) and the
    cut with the best Gini gain is taken, if it gains anything and leaves ``min_instances`` on both
    sides. The leaves' shares of class 1 are averaged; the margin is that mean less a half.
    """
    rows = _rows(df, features, label)
    if not rows.where("y is null or y not in (0, 1)").isEmpty():
        raise ValueError("labels are 0 and 1")
    cuts = _Cuts(candidate_cuts(df, features, max_cuts))
    some = _beside(rows) if cuts.cuts else None
    if some is None:
        return None
    m = max_features or math.ceil(math.sqrt(len(cuts.cuts)))
    trees, share = _in_one_job(some, _forest_levels(cuts, n_trees, max_depth, min_instances, m, seed))
    return NewtonModel(trees, (share - 0.5) / n_trees, 0.0, [], features)


# --- Newton boosting ----------------------------------------------------------------------------
def sampled(row: np.ndarray, seed: int, turn: int, fraction: float) -> np.ndarray:
    """Whether a round's sample holds the rows with these hashes (decided by the hash alone)."""
    if fraction >= 1:
        return np.ones(len(row), bool)
    with np.errstate(over="ignore"):
        z = row.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed * 1_000_003 + turn + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z < np.uint64(min(int(fraction * 2.0 ** 64), 2 ** 64 - 1))


class NewtonModel:
    """Boosted trees with a weight in every leaf; ``columns`` are those drawn for each tree."""

    def __init__(self, trees: Trees, value: np.ndarray, base: float, columns: list, features: str):
        self.trees, self.value, self.base, self.columns, self.features = trees, value, base, columns, features

    def margins(self, x: np.ndarray) -> np.ndarray:
        x, of = np.unique(x, axis=0, return_inverse=True)
        total = np.full(len(x), self.base)
        for row, node in self.trees.portions(x):
            total += np.bincount(row, self.value[node], len(x))
        return total[of]

    def transform(self, df: DataFrame, out: str = "prediction", margin: str = "margin") -> DataFrame:
        """Adds the margin and the class (1 where it is above 0)."""
        import pandas as pd

        def score(x):
            return pd.Series(self.margins(np.stack(x.to_numpy())) if len(x) else np.empty(0))

        score.__annotations__ = {"x": pd.Series, "return": pd.Series}
        x = F.col(self.features)
        if df.schema[self.features].dataType.simpleString() == "vector":
            x = vector_to_array(x)
        return df.withColumn(margin, F.pandas_udf(score, "double")(x)).withColumn(out, (F.col(margin) > 0).cast("double"))


def _node_sums(cuts: _Cuts, trees: Trees, value: np.ndarray, turn: int, slot: np.ndarray, slots: int, seed: int,
               fraction: float, first: int):
    """Gradients and Hessians of this round's sample by open node and bin. Trees from ``first``
    on aren't yet in the margin that a row brings along."""
    bins = int(cuts.start[-1])

    def run(batches):
        total = np.zeros((2, slots, bins))
        for b in batches:
            x, y = _matrix(b.column(0)), b.column(1).to_numpy()
            use = sampled(b.column(2).to_numpy(), seed, turn, fraction)
            x, y, margin = x[use], y[use], b.column(3).to_numpy()[use].copy()
            if not len(x):
                continue
            for t in range(first, turn):
                margin += value[trees.walk(x, np.array([t]))[:, 0]]
            p = 0.5 * (1 + np.tanh(0.5 * margin))
            here = slot[trees.walk(x, np.array([turn]))[:, 0]]
            place = cuts.bins(x)
            some = here >= 0
            for f in range(place.shape[1]):
                at = here[some] * bins + place[some, f]
                total[0] += np.bincount(at, (p - y)[some], slots * bins).reshape(slots, bins)
                total[1] += np.bincount(at, (p * (1 - p))[some], slots * bins).reshape(slots, bins)
        yield _entries(total)
    return run


def _cell_rows(cuts: _Cuts, turns: int, seed: int, fraction: float):
    """Rows by round's sample, cell (a bin of every feature) and label."""
    shape = [len(c) + 1 for c in cuts.cuts]
    cells = 2 * math.prod(shape)

    def run(batches):
        total = np.zeros((turns, cells))
        for b in batches:
            x, y, r = _matrix(b.column(0)), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy()
            if len(x):
                cell = 2 * np.ravel_multi_index(tuple((cuts.bins(x) - cuts.start[:-1]).T), shape) + y
                for turn in range(turns):
                    total[turn] += np.bincount(cell[sampled(r, seed, turn, fraction)], minlength=cells)
        yield _entries(total)
    return run


class _Cells:
    """What :func:`_node_sums` gives, from numbers of rows: rows of a cell and label share their
    gradient, so few cells hold all that the rounds need, whatever the rows."""

    def __init__(self, cuts: _Cuts, rows: np.ndarray):
        self.cuts, self.rows = cuts, rows
        place = np.indices([len(c) + 1 for c in cuts.cuts]).reshape(len(cuts.cuts), -1).T
        ends = [np.append(c, np.inf) for c in cuts.cuts]
        self.x = np.stack([e[place[:, f]] for f, e in enumerate(ends)], axis=1)
        self.place, self.margin, self.first = place + cuts.start[:-1], np.zeros(len(place)), 0

    def sums(self, trees: Trees, value: np.ndarray, turn: int, slot: np.ndarray, slots: int) -> np.ndarray:
        for t in range(self.first, turn):
            self.margin += value[trees.walk(self.x, np.array([t]))[:, 0]]
        self.first = turn
        p = 0.5 * (1 + np.tanh(0.5 * self.margin))
        n = self.rows[turn].reshape(-1, 2)
        g, h = n[:, 0] * p + n[:, 1] * (p - 1), n.sum(axis=1) * p * (1 - p)
        here, bins = slot[trees.walk(self.x, np.array([turn]))[:, 0]], int(self.cuts.start[-1])
        some = np.flatnonzero(here >= 0)
        at = (here[some, None] * bins + self.place[some]).reshape(-1)
        each = self.place.shape[1]
        return np.stack([np.bincount(at, np.repeat(v[some], each), slots * bins) for v in (g, h)]).reshape(2, slots, bins)


def newton_boosting(df: DataFrame, id_col: str, rounds: int = 3000, max_depth: int = 4, eta: float = 0.3,
                    reg_lambda: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0,
                    subsample: float = 1.0, colsample: float = 1.0, seed: int = 0, label: str = "label",
                    features: str = "features", max_cuts: int = 255, keep_every: int = 20) -> NewtonModel:
    """Logistic boosting by second-order steps.

    A tree is grown on gradients and Hessians of a row sample (``subsample``, by the row's id)
    and a draw of columns (``colsample``), level by level, one job each: the cut with the largest
    gain in ``G^2 / (H + reg_lambda)`` summed over both sides is taken where each side's Hessians
    reach ``min_child_weight``. Then splits whose gain is below ``gamma`` go, from the leaves
    upwards. A leaf weighs ``-eta * G / (H + reg_lambda)``. Labels are 0 and 1; without rows every
    margin is 0. Every ``keep_every`` rounds the margins are written, so that a row walks only
    the trees since. Where the cuts leave few cells of features, as the 0/1 answers of a stack's
    bases do, one job counts each round's rows in every cell, and the rounds need no other.
    """
    rows = _rows(df, features, label, [F.xxhash64(F.col(id_col)).alias("r"), F.lit(0.0).alias("m")])
    cuts = _Cuts(candidate_cuts(df, features, max_cuts))
    rng, p = np.random.default_rng(seed), len(cuts.cuts)
    trees, value, columns, first = Trees(rounds), np.zeros(rounds), [], 0
    weight = lambda g, h: -eta * g / (h + reg_lambda)
    numbers = 2 * rounds * math.prod(len(c) + 1 for c in cuts.cuts)
    cells = _Cells(cuts, _by_entry(rows, _cell_rows(cuts, rounds, seed, subsample), (rounds, numbers // rounds))
                   ) if p and rounds and numbers <= _NUMBERS else None
    for turn in range(rounds if p else 0):
        drawn = np.sort(rng.permutation(p)[:max(int(p * colsample), 1)])
        columns.append(drawn.tolist())
        opened, gains = np.array([turn]), {}
        for _ in range(max_depth):
            slot = np.full(len(trees.feature), -1, np.int32)
            slot[opened] = np.arange(len(opened))
            g, h = cells.sums(trees, value, turn, slot, len(opened)) if cells else _by_entry(
                rows, _node_sums(cuts, trees, value, turn, slot, len(opened), seed, subsample, first),
                (2, len(opened), int(cuts.start[-1])))
            nodes, feature, cut, sides, got = [], [], [], [], []
            for i, node in enumerate(opened):
                whole = g[i, :cuts.start[1]].sum(), h[i, :cuts.start[1]].sum()
                value[node] = weight(*whole)
                (gl, of, at), (hl, *_) = cuts.below(g[i]), cuts.below(h[i])
                gr, hr = whole[0] - gl, whole[1] - hl
                gain = gl ** 2 / (hl + reg_lambda) + gr ** 2 / (hr + reg_lambda) - whole[0] ** 2 / (whole[1] + reg_lambda)
                fits = np.isin(of, drawn) & (hl >= min_child_weight) & (hr >= min_child_weight) & (hl > 0) & (hr > 0)
                gain = np.where(fits, np.round(gain, 10), -np.inf)
                best = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[best] > 1e-6:
                    nodes.append(node), feature.append(of[best]), cut.append(at[best])
                    sides.append(((gl[best], hl[best]), (gr[best], hr[best])))
                    got.append(gain[best])
            if not nodes:
                break
            left = trees.split(np.array(nodes), np.array(feature), np.array(cut))
            value = np.append(value, [weight(*s) for pair in sides for s in pair])
            gains.update(zip(nodes, got))
            opened = np.stack((left, left + 1), axis=1).reshape(-1)
        for node in sorted(gains, reverse=True):  # children come after their parents
            if gains[node] < gamma and (trees.feature[trees.left[node]:trees.left[node] + 2] < 0).all():
                trees.feature[node] = -1
        if (turn + 1) % keep_every == 0 and not cells:
            part = NewtonModel(trees, value, 0.0, columns, "x")
            done, first = first, turn + 1

            def advance(batches, done=done, last=turn + 1, part=part):
                for b in batches:
                    x, m = _matrix(b.column(0)), b.column(3).to_numpy().copy()
                    for t in range(done, last if len(x) else done):
                        m += part.value[part.trees.walk(x, np.array([t]))[:, 0]]
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(m)], names=b.schema.names)
            rows = rows.mapInArrow(advance, rows.schema).checkpoint(eager=True)
    return NewtonModel(trees, value, 0.0, columns, features)
