"""Series operators against pandas on small frames, with more range segments than
series so that one series always spans several segments (the skew path)."""

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st

from tidemark.operators import series as SR

KEYS, ORDER = ["k"], ["t"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, v double")


def hot_frame(rng, n=120, null_rate=0.4):
    # One hot series holding most rows, a few small ones.
    ks = rng.choice(["hot", "hot", "hot", "a", "b"], size=n)
    vals = rng.normal(size=n).round(3)
    vals[rng.random(n) < null_rate] = np.nan
    return [(str(k), int(i), None if np.isnan(x) else float(x)) for i, (k, x) in enumerate(zip(ks, vals))]


def to_pd(rows):
    return pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])


def test_hot_series_spans_several_segments(spark):
    rows = [("hot", i, float(i)) for i in range(200)]
    s = SR.segmented(frame(spark, rows), KEYS, ORDER, partitions=8)
    assert s.select(SR.SEG).distinct().count() > 1


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.floats(min_value=0.0, max_value=0.95))
def test_fill_gaps_matches_pandas(spark, seed, null_rate):
    rows = hot_frame(np.random.default_rng(seed), null_rate=null_rate)
    got = SR.fill_gaps(frame(spark, rows), KEYS, ORDER, ["v"], partitions=7).toPandas()
    exp = to_pd(rows)
    exp["v"] = exp.groupby("k")["v"].transform(lambda s: s.ffill().bfill())
    m = exp.merge(got, on=["k", "t"], suffixes=("_e", "_g"))
    assert len(m) == len(rows)
    assert ((m.v_e == m.v_g) | (m.v_e.isna() & m.v_g.isna())).all()


def test_forward_only_keeps_leading_nulls(spark):
    rows = [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("b", 0, None)]
    got = {(r.k, r.t): r.v for r in SR.fill_gaps(frame(spark, rows), KEYS, ORDER, ["v"],
                                                 backward=False, partitions=3).collect()}
    assert got == {("a", 0): None, ("a", 1): 2.0, ("a", 2): 2.0, ("b", 0): None}


def test_position_matches_rank(spark):
    rows = hot_frame(np.random.default_rng(1))
    got = SR.with_position(frame(spark, rows), KEYS, ORDER, total="n", partitions=9).toPandas()
    exp = to_pd(rows)
    exp["pos"] = exp.groupby("k").cumcount()
    m = exp.merge(got, on=["k", "t"])
    assert (m.pos_x == m.pos_y).all()
    assert (m.n == m.groupby("k")["t"].transform("size")).all()


def test_global_position_without_keys(spark):
    rows = [("x", int(t), 0.0) for t in np.random.default_rng(2).permutation(300)]
    got = SR.with_position(frame(spark, rows), [], ORDER, partitions=6).toPandas()
    assert sorted(got.pos) == list(range(300))
    assert (got.sort_values("t").pos.values == np.arange(300)).all()


def test_lags_and_leads_match_shift(spark):
    rows = hot_frame(np.random.default_rng(3), n=150)
    got = SR.lag_features(frame(spark, rows), KEYS, ORDER, "v", lags=12, leads=4,
                          partitions=10).toPandas()
    exp = to_pd(rows)
    m = exp.merge(got[["k", "t"] + [c for c in got.columns if "_la" in c or "_le" in c]],
                  on=["k", "t"])
    for i in range(1, 13):
        e = m.groupby("k")["v"].shift(i)
        assert ((e == m[f"v_lag_{i}"]) | (e.isna() & m[f"v_lag_{i}"].isna())).all(), i
    for i in range(1, 5):
        e = m.groupby("k")["v"].shift(-i)
        assert ((e == m[f"v_lead_{i}"]) | (e.isna() & m[f"v_lead_{i}"].isna())).all(), i


def test_sliding_window_matches_rolling(spark):
    rows = [(k, int(t), float(t % 7)) for t in range(100) for k in ["hot"]] + \
           [("a", int(t), 1.0) for t in range(5)]
    got = SR.sliding_window(frame(spark, rows), KEYS, ORDER, "v", size=30,
                            partitions=8).toPandas()
    exp = to_pd(rows)
    exp["s"] = exp.groupby("k")["v"].transform(lambda s: s.rolling(30, min_periods=1).sum())
    exp["n"] = exp.groupby("k")["v"].transform(lambda s: s.rolling(30, min_periods=1).count())
    m = exp.merge(got, on=["k", "t"])
    assert (m.win_n == m.n).all()
    assert np.allclose(m.win_values.apply(sum), m.s)


def test_rows_at_max_keeps_ties(spark):
    rows = [("a", 0, 3.0), ("a", 1, 3.0), ("a", 2, 1.0), ("b", 0, 2.0)]
    got = sorted((r.k, r.t) for r in SR.rows_at_max(frame(spark, rows), "v", ["k"]).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0)]
    assert [r.t for r in SR.rows_at_max(frame(spark, rows), "v").collect()] in ([0, 1], [1, 0])


def test_sliding_sum_matches_rolling_with_nulls(spark):
    rng = np.random.default_rng(11)
    rows = hot_frame(rng, n=160, null_rate=0.5)
    got = SR.sliding_sum(frame(spark, rows), KEYS, ORDER, "v", size=6, partitions=9).toPandas()
    exp = to_pd(rows)
    exp["s"] = exp.groupby("k")["v"].transform(lambda s: s.rolling(6, min_periods=1).sum())
    exp["cnt"] = exp.groupby("k")["v"].transform(lambda s: s.rolling(6, min_periods=1).count())
    exp["n"] = exp.groupby("k").cumcount().clip(upper=5) + 1
    m = exp.merge(got, on=["k", "t"])
    assert (m.win_n == m.n).all()
    both_null = m.win_sum.isna() & (m.cnt == 0)
    assert (both_null | np.isclose(m.win_sum.fillna(-1e9), m.s)).all()


def test_null_keys_form_their_own_series(spark):
    rows = [(None, 0, 1.0), (None, 1, None), ("a", 0, None), ("a", 1, 5.0), (None, 2, None)]
    got = {(r.k, r.t): (r.v, r.pos) for r in SR.with_position(
        SR.fill_gaps(frame(spark, rows), KEYS, ORDER, ["v"], partitions=3),
        KEYS, ORDER, partitions=3).collect()}
    assert got == {(None, 0): (1.0, 0), (None, 1): (1.0, 1), (None, 2): (1.0, 2),
                   ("a", 0): (5.0, 0), ("a", 1): (5.0, 1)}


def test_empty_input(spark):
    empty = frame(spark, [])
    assert SR.fill_gaps(empty, KEYS, ORDER, ["v"]).count() == 0
    assert SR.lag_features(empty, KEYS, ORDER, "v", lags=3, leads=2).count() == 0
    assert SR.sliding_sum(empty, KEYS, ORDER, "v", size=4).count() == 0


def test_join_back_keeps_big_side_partitioning(spark):
    """With broadcasts off, the summary join is a sort-merge join on the plain
    (segment, key) columns -- no null-safe rewrite that would re-shuffle the big side."""
    rows = [("hot", i, None if i % 3 else float(i)) for i in range(60)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_aqe = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = SR.fill_gaps(frame(spark, rows), KEYS, ORDER, ["v"], partitions=4)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        if old_aqe is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old_aqe)
    assert "SortMergeJoin [_seg" in plan
    assert "coalesce(_seg" not in plan and "isnull(_sk" not in plan
