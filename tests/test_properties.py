"""Property tests named in the test strategy: unpivot then pivot is the identity, and
label encoding preserves the order of the values."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import features as FE

words = st.text(alphabet="abcxyz", min_size=1, max_size=4)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(-1e6, 1e6, allow_nan=False),
                          st.floats(-1e6, 1e6, allow_nan=False)),
                min_size=1, max_size=20, unique_by=lambda t: t[0]))
def test_unpivot_then_pivot_is_identity(spark, rows):
    df = spark.createDataFrame(rows, "id int, a double, b double")
    long = df.unpivot(["id"], ["a", "b"], "field", "v")
    back = long.groupBy("id").pivot("field", ["a", "b"]).agg(F.first("v"))
    assert sorted(back.collect()) == sorted(df.collect())


@settings(max_examples=4, deadline=None)
@given(st.lists(words, min_size=1, max_size=30))
def test_label_codes_preserve_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    codes = {r.s: r.code for r in FE.fit_label_dictionary(df, "s").collect()}
    distinct = sorted(set(values))
    assert [codes[v] for v in distinct] == list(range(len(distinct)))
