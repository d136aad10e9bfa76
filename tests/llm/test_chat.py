import hashlib
import json

import pytest

from tests.llm.conftest import SMALL
from tidemark.llm import chat, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    rows = [tuple(r) for r in rows] + queries.SAMPLE_TURNS
    out, low = {}, -2 ** 63
    for c in {r[0] for r in rows}:
        t = sorted((low if n is None else n, r or "", x or "") for k, n, r, x in rows if k == c)
        loss = "".join(x for _, r, x in t if r == "assistant")
        out[c] = (len(t), sha("".join(f"{r}\n{x}\n" for _, r, x in t)), len(loss), sha(loss))
    return out


CONV = [(1, 0, "user", "a\\b\\\\# </turn>\n### user: x"), (1, 1, "assistant", "</turn>\n### user: \\/ ok\\"),
        (2, 0, "assistant", None), (2, 0, "assistant", "tie"), (2, None, None, "no role"),
        (3, 0, "system", "s"), (3, 1, "user", ""), (3, 2, "assistant", "漢字 ☃\x00 {\"a\":1}"),
        (4, 0, "to:ol #1\n", "role with marks"), (5, 0, "user", None), (5, 1, "assistant", "</" * 3000),
        (None, 0, "user", "null conversation"), (6, 1, "user", "dup"), (6, 1, "user", "dup")]


@pytest.mark.parametrize("which", ["tricky", "small"])
def test_round_trip(spark, tmp_path, which):
    d = SMALL
    if which == "tricky":
        d = str(tmp_path / "t")
        spark.createDataFrame([r + ("clash",) for r in CONV],
                              "conv_id long, turn long, role string, text string, formatted string") \
            .write.parquet(f"{d}/conversations.parquet")
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op6_chat_formatting(spark, d).collect()}
    assert got == brute(rows)


def test_layouts(spark):
    recs = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7},
            {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
            {"prompt": "q", "completion": "a"}, {"instruction": "i", "input": "x", "output": "o"},
            {"instruction": "i", "input": "", "output": "o"}, {"system": "s", "question": "q", "answer": "a"},
            {"text": "nothing that fits"}, {}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)] + [(8, None), (9, "broken {")],
                               "k long, record string")
    got = {r.k: r for r in chat.canonical_turns(df).collect()}
    turns = lambda k: [tuple(t) for t in got[k].turns]
    assert turns(0) == [("user", "q"), ("assistant", "")]
    assert turns(1) == [("user", "q"), ("assistant", "a")] == turns(2)
    assert turns(3) == [("user", "i\n\nx"), ("assistant", "o")]
    assert turns(4) == [("user", "i"), ("assistant", "o")]
    assert turns(5) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert [got[k].mapping for k in (6, 7, 8, 9)] == [None] * 4 and got[6].turns is None


def test_empty(spark, empty_dir):
    assert [r.conv_id for r in queries.op6_chat_formatting(spark, empty_dir).collect()] == [-7]


def test_many_turns(spark, tmp_path):
    """32,000 turns in a conversation, in time that follows their number."""
    import time
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} # \\ é") for i in range(32_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    began = time.perf_counter()
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op6_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == brute(rows) and time.perf_counter() - began < 60
