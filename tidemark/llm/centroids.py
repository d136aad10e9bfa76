"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are cut into blocks that are written once: for each dimension the block's different
values, and for each vector the number of its value. A round squares the difference of every
such value to every centroid (a small table per dimension) and gathers and adds the entries by
those numbers, so a difference is computed once for each value, not for each vector. A task
hands on one partial sum per centroid and dimension; what reaches the driver is that many sums,
whatever the data. All arithmetic is in whole numbers and exact, so results do not depend on
partitions or on tasks that run again.

Defined results: vectors that are null, have another length, or hold a null or non-finite
component take no part and have no row. Repeated rows are vectors of their own. First centroids
are the smallest by hash of the id, equal hashes by components; a null id's hash is the largest.
With fewer vectors than centroids each vector begins one. Components whose differences leave 27
bits are computed in Python integers; a distance or sum beyond a long is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved

BLOCK = "ids array<long>, codes binary, sizes binary, narrow binary, wide array<string>"
_NARROW = 1 << 26  # components below it: squares and their sums stay within a long
_LIMB = 60         # partial sums are handed on in limbs of this many bits


def scaled_floor(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite double."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else scale * int(x)


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """Rows of floor(scale * x): of int64 where all are narrow, else of Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(values * scale)
    if not y.size or np.abs(y).max() < _NARROW:
        return y.astype(np.int64)
    return np.array([[scaled_floor(float(x), scale) for x in row] for row in values], object)


def _read_block(row) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, codes by dimension, values by dimension) of a block row."""
    sizes = np.frombuffer(row["sizes"], np.int32)
    if row["wide"] is None:
        values = np.frombuffer(row["narrow"], np.int64)
    else:
        values = np.array([int(v) for v in row["wide"]], object)
    return (row["ids"], np.frombuffer(row["codes"], np.uint16).reshape(len(sizes), len(row["ids"])),
            np.split(values, np.cumsum(sizes)[:-1]))


def _blocks(dims: int, scale: int, block_rows: int):
    """Arrow rows (id, vector) -> blocks."""
    def make(ids, vectors):
        x = _integers(np.array(vectors, np.float64), scale)
        columns = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
        values = np.concatenate([v for v, _ in columns])
        wide = [str(v) for v in values] if x.dtype == object else None
        return {"ids": ids,
                "codes": np.concatenate([c.reshape(-1) for _, c in columns]).astype(np.uint16).tobytes(),
                "sizes": np.array([len(v) for v, _ in columns], np.int32).tobytes(),
                "narrow": None if wide else values.tobytes(), "wide": wide}

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("sizes", pa.binary()),
                        ("narrow", pa.binary()), ("wide", pa.list_(pa.string()))])

    def run(batches):
        ids, vectors = [], []
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                vectors.append(v.values.to_numpy())
                if len(ids) == block_rows:
                    yield pa.RecordBatch.from_pylist([make(ids, vectors)], schema)
                    ids, vectors = [], []
        if ids:
            yield pa.RecordBatch.from_pylist([make(ids, vectors)], schema)
    return run


def nearest(codes: np.ndarray, values: list[np.ndarray], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of a block's vectors; ties go to the smaller number."""
    wide = any(v.dtype == object for v in values) or max(abs(c) for row in centroids for c in row) >= _NARROW
    kind = object if wide else np.int64
    total = np.zeros((codes.shape[1], len(centroids)), kind)
    for d, v in enumerate(values):
        gap = v.astype(kind)[:, None] - np.array([c[d] for c in centroids], kind)[None, :]
        total += (gap * gap)[codes[d]]
    if wide:  # argmin of Python integers
        own = np.array([min(range(len(row)), key=row.__getitem__) for row in total.tolist()], np.int64)
    else:
        own = total.argmin(axis=1)
    return own, total[np.arange(len(own)), own]


def _rows(batches):
    for b in batches:
        yield from b.to_pylist()


def _sums(centroids: list[list[int]]):
    """Blocks -> (cluster, dim, limb, part, n): this task's sums, in limbs."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches):
        sums, counts = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for row in _rows(batches):
            _, codes, values = _read_block(row)
            own, _ = nearest(codes, values, centroids)
            counts += np.bincount(own, minlength=k)
            for d, v in enumerate(values):
                often = np.bincount(own * len(v) + codes[d], minlength=k * len(v)).reshape(k, len(v))
                sums[:, d] += (often.astype(v.dtype) @ v).astype(object)
        out = []
        for c in range(k):
            for d in range(dims if counts[c] else 0):
                rest, limb = int(sums[c, d]), 0
                while True:
                    low = rest if -(1 << _LIMB) < rest < 1 << _LIMB else rest & ((1 << _LIMB) - 1)
                    out.append((c, d, limb, low, int(counts[c])))
                    if low == rest:
                        break
                    rest, limb = rest >> _LIMB, limb + 1
        names = ("cluster", "dim", "limb", "part", "n")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], names)
    return run


def _assigned(centroids: list[list[int]]):
    """Blocks -> (id, cluster, distance)."""
    def run(batches):
        for row in _rows(batches):
            ids, codes, values = _read_block(row)
            own, far = nearest(codes, values, centroids)
            if far.dtype == object:
                far = [int(x) if x < 1 << 63 else None for x in far]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])
    return run


def cluster(vectors: DataFrame, key: str, column: str, k: int = 8, rounds: int = 10, dims: int = 64,
            scale: int = 1024, seed: int = 3, block_rows: int = 4096) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` per vector of ``dims``
    finite components; ``centroid`` is the array of its final centroid's components in decimal.

    Components are floor(``scale`` * x). First centroids: the ``k`` vectors with the smallest
    SHA-256 of ``seed:id``. ``rounds`` of assigning and moving, then a last assignment.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")) \
                  .filter((F.size("v") == dims) & finite)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = [[scaled_floor(x, scale) for x in r.v] for r in first]
    blocks = saved(kept.mapInArrow(_blocks(dims, scale, block_rows), BLOCK), "cluster-blocks")
    for _ in range(rounds if centroids else 0):
        parts = blocks.mapInArrow(_sums(centroids), "cluster int, dim int, limb int, part long, n long")
        moved = [list(c) for c in centroids]
        sums: dict = {}
        for r in parts.groupBy("cluster", "dim", "limb").agg(
                F.sum(F.col("part").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
            total, n = sums.get((r.cluster, r.dim), (0, 0))
            sums[r.cluster, r.dim] = (total + (int(r.s) << (_LIMB * r.limb)), r.n if r.limb == 0 else n)
        for (c, d), (total, n) in sums.items():
            moved[c][d] = total // n
        if moved == centroids:
            break  # every further round would repeat this one
        centroids = moved
    schema = "id long, cluster int, distance long"
    found = saved(blocks.mapInArrow(_assigned(centroids), schema), "cluster-rows") if centroids \
        else spark.createDataFrame([], schema)
    far = F.col("distance").cast("decimal(38,0)")
    # a distance beyond a long leaves its sums beyond one too
    whole = F.when(F.count("distance") == F.count("*"), F.sum(far)).alias("s")
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(whole).collect()}
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    every = None if any(s is None for s in per.values()) else fits(sum(per.values()))
    rows = [(c, fits(s), every, [str(x) for x in centroids[c]]) for c, s in per.items()]
    table = F.broadcast(spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>"))  # k rows
    return found.join(table, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
