import hashlib
import random

import pytest

from tests.llm.conftest import SMALL, texts_of, write_docs
from tidemark.llm import queries, substrings


def brute(texts, window=50):
    words = {k: (t or "").encode().split() for k, t in texts.items()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i:i + window]), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def planted():
    r = random.Random(5)
    text = lambda n: " ".join(f"v{r.randrange(4000)}" for _ in range(n))
    hot, exact, long = text(70), text(50), text(400)
    docs = [text(r.randrange(10, 300)) for _ in range(60)]
    docs += [text(r.randrange(0, 60)) + " " + hot + "\n" + text(r.randrange(0, 60)) for _ in range(60)]
    docs += [text(5) + " " + exact + " " + text(7), text(11) + "  " + exact, exact,
             exact.rsplit(" ", 1)[0], exact.split(" ", 1)[1] + " x"]
    docs += [long, long, " ".join(long.split()[100:260]) + " " + text(80), long + " " + hot,
             "same " * 49, "same " * 50, "same " * 51, "same " * 200, "two words " * 60]
    # matches shifted by every remainder of the period
    docs += [text(s) + " " + " ".join(long.split()[s:s + 50]) + " " + text(3) for s in range(40)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("which", ["planted", "edge", "small"])
def test_matches_brute_force(spark, tmp_path, edge_dir, which):
    d = {"edge": edge_dir, "small": SMALL}.get(which) or write_docs(spark, tmp_path / "t", planted())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_substring_dedup(spark, d).collect()}
    assert got == brute(texts_of(spark, d))


def test_other_window_and_null_and_repeated_ids(spark):
    a = " ".join(f"a{i}" for i in range(12))
    df = spark.createDataFrame([(None, a), (4, a + " more"), (4, a + " more"), (9, "z " + a), (None, a)],
                               "doc_id long, text string")
    report, changed = substrings.deduplicate(df, "doc_id", window=10, period=7)
    got = sorted((r.id, r.n_removed) for r in report.collect())
    last = (1 << 63) - 1
    assert got == [(4, 0), (4, 0), (9, 12), (last, 12), (last, 12)]
    assert {r.id: r.kept_text for r in changed.collect()} == {9: "z", last: ""}


@pytest.mark.parametrize("period", [2, 7, 13, 21, 31])
def test_cover_has_every_difference(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_empty(spark, empty_dir):
    assert queries.op8_substring_dedup(spark, empty_dir).count() == 0


def test_texts_that_share_an_id_or_have_none_are_cut_by_their_own_windows(spark):
    words = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    a, b = words("a", 12), words("b", 12)
    rows = [(1, a), (2, b), (5, "x y z " + a), (5, b + " u v"), (5, words("c", 20)), (None, words("d", 30)),
            (None, "q " + a), (None, a), (None, words("e", 20)), (5, "x y z " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    report, changed = substrings.deduplicate(df, "doc_id", window=10, period=7)
    last = (1 << 63) - 1
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 12, 0, a), (2, 12, 0, b), (5, 15, 12, "x y z"), (5, 15, 12, "x y z"), (5, 14, 12, "u v"),
            (5, 20, 0, words("c", 20)), (last, 30, 0, words("d", 30)), (last, 13, 12, "q"), (last, 12, 12, ""),
            (last, 20, 0, words("e", 20))]
    assert sorted(map(tuple, report.collect())) == sorted((i, n, r, sha(t)) for i, n, r, t in want)
    assert sorted((r.id, r.kept_text) for r in changed.collect()) == [
        (5, "u v"), (5, "x y z"), (last, ""), (last, "q")]
