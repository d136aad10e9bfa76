"""The pipeline's stages against brute force, each on its own input."""

import re

import pytest

import corpus_pipeline as cp
from tests.llm import test_quality, test_secrets, test_simhash, test_substrings
from tests.llm.conftest import EDGE_TEXTS, SMALL, write_docs

PROSE = " ".join(f"plain{i} words{i * 7 % 31} stand{i * 13 % 97}" for i in range(40)) + "."
PLANTED = [PROSE, PROSE, PROSE.replace("plain3", "changed"), "Menu | Home | About | Contact\n" + PROSE[::-1] + ".",
           PROSE + " password = hunter2hunter2hunter2", None, "", "BUY!! " * 90,
           " ".join(f"own{i}" for i in range(70)) + "\n" + " ".join(PROSE.split()[10:75]) + "."]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("which", ["planted", "small"])
def test_stages(spark, tmp_path, which):
    d = SMALL if which == "small" else write_docs(spark, tmp_path / "t", PLANTED + EDGE_TEXTS)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = rows(docs)
    outs = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, d)
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = spark.read.parquet(path)
        outs.append(docs)
    quality, near, cut, clean, packed = outs
    # quality: base failures go, clean documents stay as they are
    got = rows(quality)
    for k, r in before.items():
        if test_quality.brute(r.text)[5]:
            assert k not in got
        elif r.text == PROSE:
            assert got[k].text == r.text
    for r in got.values():
        assert r.n_chars == len(r.text) and len(r.text) <= len(before[r.doc_id].text)
    # near copies: the smallest id of each component
    comp = test_simhash.brute_components({k: test_simhash.brute_fingerprint(r.text) for k, r in got.items()})
    stay = {k for k, c in comp.items() if c == k}
    assert set(rows(near)) == stay and all(rows(near)[k] == got[k] for k in stay)
    # substrings
    want = test_substrings.brute({k: r.text for k, r in rows(near).items()})
    after = rows(cut)
    for k, (n, gone, _) in want.items():
        if not gone:
            assert after[k].text == got[k].text
        elif gone == n:
            assert k not in after
        else:
            assert len(after[k].text.split()) == n - gone and after[k].n_chars == len(after[k].text)
    assert set(after) <= set(want)
    # secrets
    done = rows(clean)
    assert set(done) == set(after)
    for k, r in done.items():
        spans = test_secrets.brute(after[k].text)[4]
        assert (r.text == after[k].text) == (not spans) and not test_secrets.brute(r.text)[4]
        assert r.text.count("[REDACTED]") <= len(re.findall(",", spans)) + bool(spans)
    # packing holds every document that is left
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(done)


def test_run_and_empty(spark, empty_dir):
    assert cp.run(spark, SMALL).count() > 0
    assert cp.run(spark, empty_dir).count() == 0


def test_planted_outcome(spark, tmp_path):
    d = write_docs(spark, tmp_path / "t", PLANTED, extra=False)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = rows(cp.quality_rules(spark, docs, d))
    assert set(kept) == {0, 1, 2, 3, 4, 8} and kept[3].text == PROSE[::-1] + "."


def test_columns_with_any_name_stay_as_they_are(spark):
    names = ["kept", "cleaned", "id", "row", "blob_id", "_text", "kept_text", "component", "findings", "fp"]
    rows = [(i, t, None, f"s{i}", len(t), *[f"{n}{i}" for n in names])
            for i, t in enumerate([PROSE, PROSE, PROSE + " token = abcdefghijklmnop"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} string" for n in names))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] and r.source == f"s{r.doc_id}"


IDS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed):
    return " ".join(f"s{seed}w{i * 7919 % 1009}" for i in range(120)) + "."


def test_near_dedup_keeps_texts_that_share_an_id_or_have_none(spark):
    near = prose(5).replace("w1 ", "w1x ")
    texts = [(5, prose(5)), (None, near), (None, prose(6)), (None, prose(7)), (None, prose(7)), (8, prose(8)),
             (8, prose(9)), (8, prose(9))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], IDS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in cp.simhash_near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, prose(5)), (None, prose(6)), (None, prose(7)), (8, prose(8)), (8, prose(9))], key=str)


def test_substring_stage_keeps_texts_that_share_an_id_or_have_none(spark):
    shared = prose(1)
    texts = [(1, shared), (4, "own start " + shared), (4, prose(2)), (None, prose(3)), (None, shared), (None, prose(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], IDS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in cp.substring_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, shared), (4, "own start"), (4, prose(2)), (None, prose(3)), (None, prose(4))], key=str)
