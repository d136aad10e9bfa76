"""The SQL twins, on the driver tables and on edge texts."""

import duckdb
import pytest

from tests.llm.conftest import SMALL, write_docs
from tests.llm.test_chat import CONV
from tests.llm.test_quality import REPEATS
from tests.llm.test_secrets import TRICKY
from tests.llm.test_substrings import planted
from tidemark.llm import queries


def compare(spark, name, d, tables):
    con = duckdb.connect()
    for t in tables:
        path = f"{d}/{t}.parquet" if d == SMALL else f"{d}/{t}.parquet/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, d)
    res = con.execute(queries.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in df.columns) for r in res.fetchall())))
    assert sorted(map(repr, map(tuple, df.collect()))) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_small_tables(spark, name):
    compare(spark, name, SMALL, ["documents", "conversations"])


@pytest.mark.parametrize("name", ["op1_secret_scans", "op2_quality_rules", "op8_substring_dedup"])
def test_edge_texts(spark, tmp_path, name):
    texts = {"op1_secret_scans": TRICKY, "op2_quality_rules": REPEATS, "op8_substring_dedup": planted()}[name]
    compare(spark, name, write_docs(spark, tmp_path / "t", texts, extra=False), ["documents"])


def test_edge_conversations(spark, tmp_path):
    d = str(tmp_path / "c")
    spark.createDataFrame([r for r in CONV if r[0] is not None], "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{d}/conversations.parquet")
    compare(spark, "op6_chat_formatting", d, ["conversations"])
