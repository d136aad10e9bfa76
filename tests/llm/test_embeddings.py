import numpy as np
import pytest

from tests.llm.conftest import SMALL
from tidemark.llm import embeddings, queries


def brute(rows, cosine=0.95):
    """vec_id -> (n_links, component) by comparing all pairs."""
    good = {k: np.array(v, float) for k, v in rows.items()
            if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {k: (0, k) for k in rows}
    for dim in {len(v) for v in good.values()}:
        ids = sorted(k for k in good if len(good[k]) == dim)
        u = np.array([good[k] / np.linalg.norm(good[k]) for k in ids])
        link = u @ u.T >= cosine
        np.fill_diagonal(link, False)
        comp = list(range(len(ids)))
        for i in range(len(ids)):
            for j in np.flatnonzero(link[i]):
                lo, hi = sorted((comp[i], comp[j]))
                if lo != hi:
                    comp = [lo if c == hi else c for c in comp]
        out.update({k: (int(link[i].sum()), ids[comp[i]]) for i, k in enumerate(ids)})
    return out


def run(spark, path, rows, schema="vec_id long, embedding array<float>, label int, kept boolean"):
    spark.createDataFrame([(k, v, 0, None) for k, v in rows.items()], schema).repartition(3) \
        .write.parquet(f"{path}/embeddings.parquet")
    return {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_embedding_near_dedup(spark, str(path)).collect()}


def clusters(seed, near, spread, singles=150, dim=24):
    r = np.random.default_rng(seed)
    out = []
    for n in near:
        base = r.standard_normal(dim)
        out += [(base + spread * np.linalg.norm(base) / dim ** 0.5 * r.standard_normal(dim)).astype("f4").tolist()
                for _ in range(n)]
    out += [r.standard_normal(dim).astype("f4").tolist() for _ in range(singles)]
    return {int(i): out[i] for i in r.permutation(len(out))}


@pytest.mark.parametrize("spread", [0.05, 0.15, 0.24, 0.3])
def test_one_window_equals_brute_force(spark, tmp_path, spread):
    rows = clusters(int(spread * 100), [2, 3, 9, 40, 220], spread)
    assert run(spark, tmp_path / "t", rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.1, 0.2])
def test_recall_with_small_windows(spark, spread):
    """Windows much smaller than the table: rows whose id is divisible by 50 against all rows."""
    rows = clusters(int(spread * 100), [2] * 150 + [3, 9, 40, 220], spread, 1200, 32)
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3)
    found = embeddings.near_duplicates(df, "vec_id", "embedding", window=16, run_rows=64)
    got, want = {r.id: (r.n_links, r.component) for r in found.collect()}, brute(rows)
    asked = [k for k in rows if k % 50 == 0]
    assert sum(got[k][0] for k in asked) >= 0.9 * sum(want[k][0] for k in asked)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in rows)
    assert all(want[k][1] == want[got[k][1]][1] for k in rows)  # never joined across components


def test_passes_follow_the_bits_that_windows_share():
    need = lambda shared: embeddings.passes_needed(shared, 0.95, 0.99)
    assert need({}) == 1 and need({0: 10}) == 1
    assert need({4: 10}) < need({8: 10}) < need({4: 5, 16: 5}) < need({16: 10})
    agree = 1 - np.arccos(0.95) / np.pi
    assert 1 - (1 - agree ** 8) ** need({8: 10}) >= 0.99 > 1 - (1 - agree ** 8) ** (need({8: 10}) - 1)


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = {1: [1.0, 0.0], 2: [3.0, 0.0], 3: [0.0, 0.0], 4: None, 5: [1.0, None], 6: [nan, 1.0], 7: [inf, 0.0],
            8: [], 9: [1.0, 0.0, 0.0], 10: [2.0, 0.0, 0.0], 11: [-1.0, 0.0], 12: [1e-30, 0.0], 13: [3e38, 1.0],
            14: [1.0, 0.0]}
    assert run(spark, tmp_path / "t", rows) == brute(rows)


def test_small_table_and_empty(spark, empty_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_embedding_near_dedup(spark, SMALL).collect()}
    assert got == brute(rows)
    assert queries.op4_embedding_near_dedup(spark, empty_dir).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.1]), (5, [1.0, 0.1]), (5, [1.0, 0.1]), (7, [0.0, 1.0])],
                               "vec_id long, embedding array<float>")
    got = sorted((r.id, r.n_links, r.component) for r in embeddings.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(5, 2, 5), (5, 2, 5), (7, 0, 7), ((1 << 63) - 1, 2, 5)]


def test_loose_groups_larger_than_any_block_are_whole(spark):
    """Cosines of about 0.96: hardly two vectors lie within half the linking angle."""
    rows = clusters(11, [700, 150, 3], 0.204, 60, 48)
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3)
    found = embeddings.near_duplicates(df, "vec_id", "embedding", window=16, run_rows=32)
    assert {r.id: (r.n_links, r.component) for r in found.collect()} == brute(rows)


@pytest.mark.parametrize("spread", [0.02, 0.1, 0.17])
def test_dense_groups_are_counted_whole(spark, spread):
    """Runs that angles decide are counted without a comparison, all others are compared."""
    rows = clusters(13, [400, 90], spread, 60, 48) | {1000: [1.0] * 48, 1001: [1.0] * 48, 1002: [2.0] * 48}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3)
    found = embeddings.near_duplicates(df, "vec_id", "embedding", window=32, run_rows=16)
    assert {r.id: (r.n_links, r.component) for r in found.collect()} == brute(rows)


def test_vectors_that_share_an_id_or_have_none(spark):
    last = (1 << 63) - 1
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, [1.0, 0.01]), (5, [-1.0, 0.0]), (5, [0.0, -1.0]),
            (5, [0.0, -1.0]), (7, [0.01, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.id, r.n_links, r.component) for r in embeddings.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(5, 0, 5), (5, 1, 5), (5, 1, 5), (7, 1, 7), (last, 1, 7), (last, 1, last), (last, 1, last)]
