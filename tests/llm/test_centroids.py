import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.conftest import SMALL
from tidemark.llm import centroids, queries


def brute(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cent = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cent]
            out.append((i, d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        own = assign()
        for c in range(len(cent)):
            mine = [v for (_, o, _), (_, v) in zip(own, kept) if o == c]
            if mine:
                cent[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    total = sum(d for *_, d in own)
    inertia = {c: sum(d for _, o, d in own if o == c) for c in range(len(cent))}
    cut = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted(((i, c, cut(d), cut(inertia[c]), cut(total), sha[c]) for i, c, d in own), key=str)


def run(spark, path, rows, kind="float"):
    spark.createDataFrame([(i, v, 0, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, cluster int") \
        .repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in queries.op12_centroid_clustering(spark, str(path)).collect()), key=str)


def test_small_table_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_centroid_clustering(spark, SMALL).collect()), key=str)
    assert got == brute(rows) and len(got) > 10


def test_odd_vectors_ties_and_repeats(spark, tmp_path):
    r = np.random.default_rng(1)
    base = [r.integers(-3, 4, 64) / 1024 for _ in range(6)]
    rows = [(int(i), base[i % 6].astype("f4").tolist()) for i in range(40)]
    rows += [(None, base[0].astype("f4").tolist()), (None, base[1].astype("f4").tolist()), (7, base[3].astype("f4").tolist()),
             (100, None), (101, []), (102, [1.0] * 63), (103, [None] + [1.0] * 63), (104, [float("nan")] * 64),
             (105, [float("inf")] + [0.0] * 63), (106, [-0.0001] * 64)]
    assert run(spark, tmp_path / "t", rows) == brute(rows)


def test_wide_components_are_exact(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(64) * 10.0 ** r.integers(-2, 300)).tolist()) for i in range(30)]
    rows += [(100 + i, r.standard_normal(64).tolist()) for i in range(30)]
    assert run(spark, tmp_path / "t", rows, "double") == brute(rows)


@pytest.mark.parametrize("n", [0, 3])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert run(spark, tmp_path / "t", rows) == brute(rows)


def test_blocks_of_any_size_give_the_same(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    few = centroids.cluster(df, "vec_id", "embedding", rounds=3, block_rows=7).collect()
    one = centroids.cluster(df.repartition(5), "vec_id", "embedding", rounds=3).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, one))


def test_empty_table(spark, empty_dir):
    assert queries.op12_centroid_clustering(spark, str(empty_dir)).count() == 0
