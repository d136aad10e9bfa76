import base64
import gzip
import hashlib
import random

import pytest

from tests.llm.conftest import SMALL
from tidemark.llm import queries, warc


def brute(rows):
    data = {k: (h or "").encode() for k, _, h in rows}
    best = {}
    for k, d in data.items():
        best[d] = max(best.get(d, k), k)
    return {k: (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(),
                "response" if best[d] == k else "revisit", None if best[d] == k else best[d])
            for k, d in data.items()}


ODD = [(1, "http://a.org/", "x"), (2, None, "x"), (3, "http://b.org/ q\r\nInjected: 1", "x"), (4, "", None),
       (5, "not a url", ""), (6, "http://[bad", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
       (7, "http://www.A.org:8080/P?q=1#f", "é漢\x00\r\n\r\n"), (8, "http://a.org/", "y" * 300_000),
       (9, "http://a.org/", "\r\n\r\n" * 50), (-3, "http://a.org/", "x"), (10, "http://a.org/", " ")] \
      + [(100 + i, f"http://hot.org/{i % 3}", "same") for i in range(200)]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_round_trip_and_order(spark, tmp_path, which):
    d = SMALL
    if which == "odd":
        d = str(tmp_path / "t")
        spark.createDataFrame([r + ("clash",) for r in ODD], "page_id long, url string, html string, ts string") \
            .repartition(3).write.parquet(f"{d}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    got = queries.op10_warc(spark, d).collect()
    assert {r.page_id: tuple(r)[1:5] for r in got} == brute(rows) and len(got) == len(rows)
    order = [(r.urlkey, r.captured, r.page_id) for r in got]
    assert order == sorted(order)


def test_archives_on_disk_and_long_runs(spark, tmp_path):
    df = spark.createDataFrame([r for r in ODD], "id long, url string, payload string") \
        .selectExpr("id", "url", "timestamp_seconds(1000 - id) ts", "coalesce(payload, '') payload")
    path = str(tmp_path / "w")
    index = warc.archive_and_index(df, min_bytes=2, archive_bytes=20_000, path="file://" + path)
    rows = index.collect()
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    assert len(files) > 5 and len(rows) == len(ODD)
    assert len({r.run for r in rows}) > 5
    payloads = {k: (p or "").encode() for k, _, p in ODD}
    for r in rows:  # the index points at the record: a seek and a read give it whole
        with open(tmp_path / "w" / r.archive, "rb") as f:
            f.seek(r.offset)
            data = gzip.decompress(f.read(r.length))
        head, block = warc.record(data)
        assert head["X-Capture-ID"] == str(r.id) and head["WARC-Type"] == r.record_type
        if r.record_type == "response":
            assert block.split(b"\r\n\r\n", 1)[1] == payloads[r.id]
    for name, data in files.items():  # members follow each other without a gap
        spans = sorted((r.offset, r.length) for r in rows if r.archive == name)
        assert [a for a, _ in spans] + [len(data)] == [0] + [a + n for a, n in spans]
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") >= len(spans)
    assert {r.record_type for r in rows if r.id in (1, 2, 3, -3)} == {"response"}  # one byte: too small
    order = [(r.urlkey, r.ts, r.id) for r in rows]
    assert order == sorted(order)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (None, None, "b")],
                               "id long, url string, payload string").selectExpr("*", "timestamp_seconds(0) ts")
    got = sorted((r.id or 0, r.record_type, r.refers_to or 0) for r in warc.archive_and_index(df).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "response", 0)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(50) for _ in range(r.randrange(30))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("runs, rows, block, ways", [(1, 500, 7, 16), (40, 60, 5, 2), (7, 400, 64, 3), (300, 3, 4, 1), (0, 0, 4, 2)])
def test_blocks_merge_in_bounded_memory(runs, rows, block, ways):
    r = random.Random(runs)
    data = [sorted((r.randrange(10_000), run, i) for i in range(rows)) for run in range(runs)]
    held = peak = 0

    def read():
        nonlocal held, peak
        cut = [run[i:i + block] for run in data for i in range(0, rows, block)]
        for b in sorted(cut):
            held += len(b)
            peak = max(peak, held)
            yield b[0], b

    out = []
    for row in warc.merge_blocks(read(), lambda x: x, ways):
        held -= 1
        out.append(row)
    assert out == sorted(x for run in data for x in run)
    assert peak <= max(2 * runs, ways) * block + 2 * block


def test_runs_longer_than_a_block_and_members_longer_than_a_limit(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "concat('http://h', id % 7, '.org/', id % 11) url",
                                      "timestamp_seconds(id % 5) ts", "repeat(cast(id as string), 20) payload")
    path = "file://" + str(tmp_path / "w")
    warc.write(df, path, archive_bytes=400_000)
    runs = warc.saved(warc.read_runs(spark, path, block_rows=16), "runs")
    assert runs.select("run").distinct().count() > 4
    rows = warc.merge_index(runs, block_rows=16, ways=2).collect()
    order = [(r.urlkey, r.ts, r.id) for r in rows]
    assert order == sorted(order) and len(rows) == 3000
    text = b"WARC/1.1\r\nContent-Length: 5000\r\n\r\n" + bytes(random.Random(1).randbytes(5000)) + b"\r\n\r\n"
    packed = warc.compressed(text, limit=700) + b"\0"
    (a, head, block), (b, _, _) = [(x[0], x[2], x[3]) for x in warc.parse(packed + packed)]
    assert (a, b) == (0, len(packed)) and text.endswith(block + b"\r\n\r\n")
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(packed[:-5]))


def test_null_and_negative_ids_keep_one_order(spark):
    ids = [None, -3, -1, 0, 2, None, -2]
    df = spark.createDataFrame([(i, "http://a.org/", "p") for i in ids], "id long, url string, payload string") \
        .selectExpr("*", "timestamp_seconds(0) ts")
    got = [r.id for r in warc.archive_and_index(df, archive_bytes=700).collect()]
    assert got == [None, None, -3, -2, -1, 0, 2]


def test_url_key():
    assert warc.url_key("http://www.A.org:8080/P?q=1#f") == "org,a:8080)/p?q=1"
    assert warc.url_key("https://x.y.com") == "com,y,x)/" and warc.url_key("urn:page:3") == "urn:page:3"


def test_empty(spark, empty_dir):
    assert queries.op10_warc(spark, empty_dir).count() == 0
