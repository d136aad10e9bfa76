import hashlib
import heapq
import random
import re
import zlib

import pytest

from tests.llm.conftest import SMALL
from tidemark.llm import queries, repair

WS = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, lines) by a search over (row, roles so far), cheapest then least audit."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        put = lambda c, e, j, s, new=(): heapq.heappush(heap, (cost + c, audit + e, j, s, lines + new))
        for name in ("user", "assistant"):
            if (state, name[0]) in step:
                put(3, "I", i, name[0], (f"{name}:",))
        if i < len(rows):
            role, text, fault = rows[i]
            put(4, "D", i + 1, state)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in step:
                    put(more, "K", i + 1, role[:1], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    if (state, name[0]) in step:
                        put(3 + more, "R", i + 1, name[0], (f"{name}:{text}",))


def brute(table):
    out, convs = {}, {}
    for conv, turn, role, text in table:
        mine = convs.setdefault(conv, [])
        sp = lambda x: " " if x is None else x
        role, text = sp(role), sp(text)
        fate = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (2 if fate == 3 else 1)
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, rows = set(), []
        for _, role, text in mine:
            bare = text.rstrip(WS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else \
                "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows)
        out[conv] = (gaps if gaps < 1 << 63 else None, *[sum(r[2] == f for r in rows) for f in
                     ("blank", "duplicate", "truncated")], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, path, table, parts=3):
    spark.createDataFrame([(*r, "clash", 1) for r in table],
                          "conv_id long, turn long, role string, text string, audit string, conv int") \
        .repartition(parts).write.parquet(f"{path}/conversations.parquet")
    return {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(path)).collect()}


def test_small_tables_equal_brute_force(spark):
    for d in (SMALL, "/root/testdata/sf0.01"):
        table = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select(
            "conv_id", "turn", "role", "text").collect()]
        got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, d).collect()}
        assert got == brute(table)


def test_odd_conversations(spark, tmp_path):
    r = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User", "☃"]
    texts = ["Hello.", "What?", "no end", "  ", "", None, "same!", "same!", "Ça va ?\n", "tail. \x0b\t", "x☃", "new\nline."]
    table = [(r.choice([None, *range(60)]), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts))
             for _ in range(900)]
    table += [(1000, 5, "user", "twice.")] * 3 + [(1001, t, "user", "Often.") for t in range(40)]
    table += [(1002, -(1 << 63), "user", "a."), (1002, (1 << 63) - 1, "assistant", "b.")]
    table += [(1003, None, "user", "a."), (1003, None, "assistant", "b."), (1003, 4, "user", "a.")]
    assert run(spark, tmp_path / "t", table) == brute(table)


def test_one_long_conversation(spark, tmp_path):
    r = random.Random(6)
    table = [(5, t, r.choice(["user", "assistant"]), r.choice(["Yes.", "No", "", f"{t}!", f"{t}?"])) for t in range(3000)]
    table += [(6, 0, "user", "Long. " * 200_000), (6, 1, "assistant", "x" * 300_000 + ".")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert run(spark, tmp_path / "t", table, 5) == brute(table)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_equal_a_plain_search(block):
    tables, r = repair.Tables(block), random.Random(block)
    names = ["system", "user", "assistant", "other"]
    for _ in range(400):
        symbols = [r.randrange(16) for _ in range(r.randrange(14))]
        rows = [(names[s // 4], "t", (None, "blank", "duplicate", "truncated")[s % 4]) for s in symbols]
        cost, audit, lines = cheapest(rows)
        assert tables.solve("".join(chr(65 + s) for s in symbols)) == (cost, audit)
        made = repair.Repairer(audit)
        got = [line for role, text, _ in rows for line in made.row(role, text)] + list(made.end())
        assert tuple(got) == lines


def test_long_strings_take_time_in_proportion():
    import time
    tables = repair.Tables()
    def seconds(n):
        began = time.perf_counter()
        tables.solve("EIEAEHF" * n)
        return time.perf_counter() - began
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_empty_table(spark, empty_dir):
    assert queries.op13_conversation_repair(spark, str(empty_dir)).count() == 0
