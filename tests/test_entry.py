"""The driver contract: entry() runs on sf0.001 with a stable schema, and every oracle
key is a query key."""

import importlib.util
import os

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(HERE, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_and_registry(spark):
    mod = load_entry()
    df = mod.entry(spark)
    assert df.schema.simpleString() == \
        "struct<event_type:string,weekday:int,traffic:double,n_rows:bigint>"
    assert df.count() > 0
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 129 and len(o) >= 96
