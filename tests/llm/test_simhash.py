import random

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import SMALL, texts_of, write_docs
from tidemark.llm import queries, simhash
from tidemark.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, max_bits=4):
    """id -> smallest id reachable, from fingerprints by id."""
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    comp = list(range(len(ids)))
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= max_bits):
            a, b = comp[i], comp[j]
            if a != b:
                lo, hi = min(a, b), max(a, b)
                comp = [lo if c == hi else c for c in comp]
    return {k: ids[c] for k, c in zip(ids, comp)}


def near_copies():
    r = random.Random(3)
    text = lambda n: [f"V{r.randrange(900)}" for _ in range(n)]
    docs = []
    for n in (8, 40, 400, 1500):
        base = text(n)
        for _ in range(12):
            t = list(base)
            t[r.randrange(n)] = "Edited"
            docs.append(" ".join(t))
        docs += [" ".join(base), " ".join(base).lower(), "\n".join(base)]
    return docs + [" ".join(text(60)) for _ in range(40)]


@pytest.mark.parametrize("which", ["near", "edge", "small"])
def test_matches_brute_force(spark, tmp_path, edge_dir, which):
    d = {"edge": edge_dir, "small": SMALL}.get(which) or write_docs(spark, tmp_path / "t", near_copies())
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, d).collect()}
    fps = {k: brute_fingerprint(t) for k, t in texts_of(spark, d).items()}
    comp = brute_components(fps)
    assert got == {k: (f"{f:016x}", comp[k]) for k, f in fps.items()}


@pytest.mark.parametrize("max_bits,hot", [(4, 1000), (4, 3), (3, 2), (2, 3), (1, 2), (0, 5)])
def test_links_with_hot_buckets(spark, max_bits, hot):
    r = random.Random(max_bits * 100 + hot)
    fps = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))))
    fps |= {r.getrandbits(64) for _ in range(50)}
    ids = {i: f for i, f in enumerate(sorted(fps))}
    rows = [(i, simhash._signed(f)) for i, f in ids.items()]
    df = spark.createDataFrame(rows, "id long, fp long")
    found = simhash.links(df.select("fp"), max_bits, 3, hot)
    for row in found.collect():
        assert bin((row.fp ^ row.other) & (2 ** 64 - 1)).count("1") <= max_bits
    edges = found.join(df.withColumnRenamed("id", "a"), "fp").join(
        df.withColumnRenamed("fp", "other").withColumnRenamed("id", "b"), "other")
    comp = {r.id: r.component for r in components(edges).collect()}
    assert {i: comp.get(i, i) for i in ids} == brute_components(ids, max_bits)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 1150)]
    df = spark.createDataFrame(chain + star + [(5, 5), (3, 2)], "a long, b long").repartition(7)
    comp = {r.id: r.component for r in components(df).collect()}
    assert comp == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 2000: 1000}


def test_empty(spark, empty_dir):
    assert queries.op9_simhash_near_dedup(spark, empty_dir).count() == 0
