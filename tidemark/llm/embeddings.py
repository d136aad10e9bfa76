"""Embedding near-duplicates by sorted projection passes.

Every pass sorts the vectors lexicographically by concatenated random hashes (signs of random
projections, packed into one long) and compares each vector with those in a bounded window
after it. A window gives a spanning forest of its verified links, never the pairs, and the
forests of all passes are united. Sorting is a range exchange, and the sorted order is cut into
blocks of a fixed number of rows with the next block's head attached, so no task depends on how
vectors cluster and no pair is lost at a boundary.

The number of passes follows the data: from the hash bits that a window spans in the first
order (its rows share them), and the chance that two vectors at the threshold agree in those,
as many passes are made as bring such a pair into a window with probability ``recall`` or more.

Links are then counted exactly inside each component, however dense it is: its vectors are
ordered by their angle to one of them and cut into runs. Two runs whose angles differ by more
than the linking angle have no link, two whose angles add up to less are linked whole, both by
the triangle inequality; the others are compared. So a missed link is one whose ends no chain of
found links joins, and a window that is full of links loses none. The price is that a component
which angles don't decide costs the square of its own size.

Equal vectors are one class, under a position of its own that is written once; ids come in
again only at the end, so null and repeated ids tie nothing together.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; so do vectors of different lengths; repeated rows are vectors of their own;
a null id counts as the largest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import saved
from tidemark.llm.components import components

LAST = (1 << 63) - 1
_BITS = 60       # hash bits of a key
_SLACK = 1e-7    # radians, against rounding in arguments by angles
_ROWS = 1024     # rows of a product computed at once


def _raw(dtype):
    """Bytes of each usable vector."""
    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                v = v.values
                if v is None or not len(v) or v.null_count:
                    out.append(None)
                    continue
                x = v.to_numpy(zero_copy_only=False).astype(dtype)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "raw"])
    return run


def _units(column, dtype) -> np.ndarray:
    """Unit vectors in double precision, by rows; all of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` in the shared folder with ``pos``, its place in the global order.

    Positions are partition offsets plus places inside the partition; the offsets are one row
    a partition, whatever the data.
    """
    spark = df.sparkSession
    parts = saved(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_part", F.spark_partition_id())
                  .withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    offsets, total = [], 0
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        offsets.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets, "_part int, _offset long"))
    return parts.join(table, "_part").withColumn("pos", F.col("_offset") + F.col("_in")) \
                .drop("_part", "_in", "_offset")


def _roots(hit, same):
    """For rows and columns of ``hit`` that have links: a row that stands for their component."""
    back = hit if same else np.ascontiguousarray(hit.T)
    left = np.full(len(hit), -1, np.int64)
    right = left if same else np.full(len(back), -1, np.int64)
    for s in np.flatnonzero(hit.any(axis=1)):
        if left[s] >= 0:
            continue
        left[s] = s
        front, steps = np.array([s]), [(hit, right), (back, left)]
        while len(front):
            rows, seen = steps[0]
            front = np.flatnonzero(rows[front].any(axis=0) & (seen < 0))
            seen[front] = s
            steps.reverse()
    return left, right


def _keys(dtype, passes, seed):
    """One row per vector and pass: (pass, dim, key, id)."""
    def run(batches):
        for b in batches:
            raw = b.column(1)
            dims = np.array([len(r) for r in raw.to_pylist()], np.int64) // np.dtype(dtype).itemsize
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                u = _units(raw.take(pa.array(rows)), dtype)
                for p in passes:
                    plane = np.random.default_rng([seed, p, dim]).standard_normal((dim, _BITS))
                    key = ((u @ plane) > 0) @ (1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64))
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p), pa.int32()), pa.array(np.full(n, dim), pa.int32()),
                         pa.array(key), b.column(0).take(pa.array(rows))], names=["pass", "dim", "key", "id"])
    return run


def _window_forests(dtype, window, cosine):
    """(root, id) of the vectors of a block that have a link inside a window; root leads theirs."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        ids, own = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "own"))
        group = t.column("pass").to_numpy().astype(np.int64) << 32 | t.column("dim").to_numpy()
        out = [(np.empty(0, np.int64),) * 2]
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)  # these follow one another in the order
            u, m = _units(t.column("raw").take(pa.array(rows)), dtype), int(own[rows].sum())
            hit = np.zeros((len(u), len(u)), bool)
            for i in range(0, m, _ROWS):
                part = slice(i, min(i + _ROWS, m))
                wide = slice(i, min(part.stop + window, len(u)))
                gap = np.arange(wide.start, wide.stop)[None, :] - np.arange(part.start, part.stop)[:, None]
                hit[part, wide] = (u[part] @ u[wide].T >= cosine) & (gap > 0) & (gap <= window)
            hit |= hit.T
            root, _ = _roots(hit, True)
            some = np.flatnonzero(root >= 0)
            out.append((ids[rows[root[some]]], ids[rows[some]]))
        return pa.table(dict(zip(("root", "id"), map(np.concatenate, zip(*out)))))
    return run


def passes_needed(shared: dict[int, int], cosine: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``, averaged
    over rows: ``shared`` counts rows by the leading bits that their window shares."""
    if not shared:
        return 1
    agree = 1 - math.acos(cosine) / math.pi
    meets = np.array([agree ** b for b in shared])
    weight = np.array(list(shared.values()), float) / sum(shared.values())
    passes = 1
    while weight @ (1 - (1 - meets) ** passes) < recall:
        passes += 1
    return passes


def _shared_bits(order: DataFrame, window: int) -> dict[int, int]:
    """Rows of a pass by the number of leading bits that they share with the row a window on;
    the last rows, whose windows hold all that follows, share none."""
    here = order.select("dim", "key", "pos")
    there = order.select((F.col("pos") - window).alias("pos"), F.col("key").alias("k2"), F.col("dim").alias("d2"))
    x = F.col("key").bitwiseXOR(F.col("k2"))
    bits = F.when(F.col("d2") != F.col("dim"), 0).when(x == 0, _BITS).otherwise(_BITS - F.length(F.bin(x)))
    found = here.join(there, "pos", "left").select(F.coalesce(bits, F.lit(0)).alias("bits"))
    return {r.bits: r["count"] for r in found.groupBy("bits").count().collect()}  # at most _BITS + 1 rows


def _blocks(order: DataFrame, items: DataFrame, block: int, window: int) -> DataFrame:
    """Rows of ``items`` by block of the order; the first ``window`` rows of a block stand in the
    block before as well (``own`` false)."""
    b = F.floor(F.col("pos") / block)
    here = F.struct(F.col("pass"), b.alias("block"), F.lit(True).alias("own"))
    before = F.struct(F.col("pass"), (b - 1).alias("block"), F.lit(False).alias("own"))
    copies = F.when((F.col("pos") % block < window) & (b > 0), F.array(here, before)).otherwise(F.array(here))
    return (order.withColumn("_c", F.explode(copies))
            .select("pass", "dim", "pos", "id", "_c.block", "_c.own").join(items, "id"))


def _angles(dtype):
    """Adds the angle of each vector to its component's first."""
    def run(batches):
        for b in batches:
            raw, pivot = (b.column(b.schema.get_field_index(c)) for c in ("raw", "pivot"))
            dims = np.array([len(r) for r in raw.to_pylist()], np.int64)
            angle = np.zeros(b.num_rows)
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                u, v = _units(raw.take(rows), dtype), _units(pivot.take(rows), dtype)
                angle[rows.to_numpy()] = np.arccos(np.clip(np.einsum("ij,ij->i", u, v), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(angle)], names=[*b.schema.names[:-1], "angle"])
    return run


def _count(dtype, cosine):
    """Links between two runs, inside components: (id, links) of vectors that have some."""
    def run(t: pa.Table) -> pa.Table:
        same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        comp, ids, n = (t.column(c).to_numpy() for c in ("comp", "id", "n"))
        order = np.argsort(comp, kind="stable")
        first = (t.column("run").to_numpy() == t.column("lo").to_numpy())[order]
        cut = np.flatnonzero(np.diff(comp[order])) + 1
        out = [(np.empty(0, np.int64),) * 2]
        for rows, one in zip(np.split(order, cut), np.split(first, cut)):
            a, b = (rows, rows) if same else (rows[one], rows[~one])
            if not len(a) or not len(b):
                continue
            u = _units(t.column("raw").take(pa.array(a)), dtype)
            v = u if same else _units(t.column("raw").take(pa.array(b)), dtype)
            of_a, of_b, n_a, n_b = np.zeros(len(a)), np.zeros(len(b)), n[a].astype(float), n[b].astype(float)
            for i in range(0, len(a), _ROWS):
                hit = u[i:i + _ROWS] @ v.T >= cosine
                if same:
                    hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
                hit = hit.astype(np.float64)
                of_a[i:i + _ROWS] = hit @ n_b
                of_b += n_a[i:i + _ROWS] @ hit
            out.append((ids[a], of_a.astype(np.int64)))
            if not same:
                out.append((ids[b], of_b.astype(np.int64)))
        return pa.table(dict(zip(("id", "links"), map(np.concatenate, zip(*out)))))
    return run


def _links(linked: DataFrame, dtype: str, cosine: float, run_rows: int) -> DataFrame:
    """``(id, links)`` inside components; ``linked`` has (comp, id, n, raw)."""
    limit = math.acos(cosine)
    pivots = linked.filter(F.col("id") == F.col("comp")).select("comp", F.col("raw").alias("pivot"))
    schema = "comp long, id long, n long, raw binary, angle double"
    angled = linked.select("comp", "id", "n", "raw").join(pivots, "comp").select(
        "comp", "id", "n", "raw", "pivot").mapInArrow(_angles(dtype), schema)
    # a run may hold many small components, a large one has many runs
    runs = saved(ranked(angled, ["comp", "angle", "id"], "component-order").withColumn(
        "run", F.floor(F.col("pos") / run_rows)), "component-runs")
    ends = saved(runs.groupBy("comp", "run").agg(F.min("angle").alias("least"), F.max("angle").alias("most"),
                                                 F.sum("n").alias("size")), "run-ends")
    lo = ends.select("comp", F.col("run").alias("lo"), F.col("most").alias("lo_most"), F.col("size").alias("lo_size"))
    hi = ends.select("comp", F.col("run").alias("hi"), F.col("most").alias("hi_most"), F.col("least").alias("hi_least"),
                     F.col("size").alias("hi_size"))
    whole = F.col("lo_most") + F.col("hi_most") <= limit - _SLACK
    pairs = lo.join(hi, "comp").filter("lo < hi").filter(F.col("hi_least") - F.col("lo_most") <= limit + _SLACK)
    pairs = saved(pairs.select("comp", "lo", "hi", "lo_size", "hi_size", whole.alias("whole")), "run-pairs")
    sides = F.explode(F.array(F.struct(F.col("lo").alias("run"), F.col("hi_size").alias("links")),
                              F.struct(F.col("hi").alias("run"), F.col("lo_size").alias("links"))))
    settled = pairs.filter("whole").select("comp", sides.alias("s")).groupBy("comp", "s.run").agg(
        F.sum("s.links").alias("links"))
    tiles = pairs.filter("not whole").select("comp", "lo", "hi")
    own = runs.select("comp", "run", "id", "n", "raw", F.col("run").alias("lo"), F.col("run").alias("hi"))
    part = runs.select("comp", "run", "id", "n", "raw")
    other = [part.join(tiles, (part["comp"] == tiles["comp"]) & (part["run"] == tiles[end]))
             .select(part["comp"], "run", "id", "n", "raw", "lo", "hi") for end in ("lo", "hi")]
    counted = own.unionByName(other[0]).unionByName(other[1]).groupBy("lo", "hi").applyInArrow(
        _count(dtype, cosine), "id long, links long")
    by_run = runs.select("comp", "run", "id").join(settled, ["comp", "run"]).select("id", "links")
    return counted.unionByName(by_run).groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str, column: str, cosine: float = 0.95, recall: float = 0.99,
                    window: int = 1024, run_rows: int = 8192, seed: int = 7) -> DataFrame:
    """``(id, n_links, component)`` per row; a null key is given as the largest long.

    ``window`` rows after each are compared in a pass; components are counted in runs of
    ``run_rows``. No pair below ``cosine`` links.
    """
    kind = vectors.schema[column].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = saved(vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), column)
                 .mapInArrow(_raw(dtype), "id long, raw binary"), "vectors")
    # classes of equal vectors
    classes = rows.filter("raw is not null").groupBy("raw").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = saved(ranked(classes.withColumn("dim", F.length("raw")), ["dim", "raw"], "vector-order")
                    .withColumnRenamed("pos", "id").drop("dim"), "vector-classes")
    # the passes: the first order says how many are needed
    items = classes.select("id", "raw")
    sort = lambda ps, name: ranked(
        items.mapInArrow(_keys(dtype, ps, seed), "pass int, dim int, key long, id long"),
        ["pass", "dim", "key", "id"], name)
    order = sort([0], "first-order")
    passes = passes_needed(_shared_bits(order, window), cosine, recall)
    orders = [order] + ([sort(list(range(1, passes)), "pass-order")] if passes > 1 else [])
    forests = [_blocks(o, items, 2 * window, window).groupBy("pass", "block").applyInArrow(
        _window_forests(dtype, window, cosine), "root long, id long") for o in orders]
    edges = forests[0].unionByName(forests[1]) if len(forests) > 1 else forests[0]
    comp = saved(components(edges.select(F.col("root").alias("a"), F.col("id").alias("b")).filter("a <> b"),
                            "embedding"), "vector-components")
    members = comp.unionByName(comp.select(F.col("component").alias("id"), "component").distinct())
    linked = classes.join(members, "id").select(F.col("component").alias("comp"), "id", "n", "raw")
    links = _links(saved(linked, "linked-vectors"), dtype, cosine, run_rows)
    found = saved(classes.join(links, "id", "left").join(comp, "id", "left").select(
        "raw", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("root")), "vector-links")
    least = saved(found.groupBy("root").agg(F.min("least").alias("component")), "root-ids")
    return rows.join(saved(found.drop("least").join(least, "root"), "found-vectors"), "raw", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component"))
