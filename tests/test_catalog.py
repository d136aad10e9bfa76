"""Every catalogue query with an oracle matches DuckDB on the smallest driver tables;
every query without one runs and returns its declared columns."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from tidemark.plans import registry
from tidemark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
registry.load_all()


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, con, name):
    sdf = registry.QUERIES[name](spark, SF)
    scols = sdf.columns
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    res = con.execute(registry.ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    perm = [dcols.index(c) for c in scols]
    drows = [tuple(norm(r[i]) for i in perm) for r in res.fetchall()]
    assert sorted(srows, key=key) == sorted(drows, key=key)


def majority(rows):
    ones = sum(r.label for r in rows) / len(rows)
    return max(ones, 1 - ones)


@pytest.mark.parametrize("name", ["rf_classifier", "decision_tree", "logistic_l1", "gbt_classifier", "adaboost",
                                  "linear_svc"])
def test_classifiers_score_every_test_row(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    per_class = [r["count"] for r in labels.groupBy("quality").count().collect()]
    assert len(rows) == len({r.doc_id for r in rows}) == sum(math.ceil(n * 0.25) for n in per_class)
    hits = sum(r.label == r.prediction for r in rows) / len(rows)
    assert hits >= majority(rows) - 0.05 and {r.prediction for r in rows} <= {0.0, 1.0}


def test_regressors_score_every_test_row(spark):
    """The events' values follow none of the features, so only the range can be held here;
    test_models.py holds what a regressor learns."""
    events = [r.value for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    for name in ("rf_regressor", "gbt_regressor"):
        rows = registry.QUERIES[name](spark, SF).collect()
        assert len(rows) == len({r.event_id for r in rows}) == math.ceil(len(events) * 0.25)
        mean = sum(events) / len(events)
        assert abs(sum(r.prediction for r in rows) / len(rows) - mean) < 0.2 * mean
        assert all(math.isfinite(r.prediction) for r in rows)


def test_saved_model_predicts_the_same(spark):
    rows = registry.QUERIES["model_save_load"](spark, SF).collect()
    assert rows and all(r.before == r.after for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["impute_forest", "impute_ridge", "impute_blend"])
def test_imputation_keeps_every_row(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    events = {r.event_id: r.value for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    assert len(rows) == len(events) == len({r.event_id for r in rows})
    for r in rows:  # what is known stays, what is not is filled
        assert r.gv_filled == events[r.event_id] if events[r.event_id] > 10 else r.gv_filled is not None


def test_batch_score_and_bad_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = registry.QUERIES["batch_score"](spark, SF).collect()
    assert len(rows) == docs == len({r.doc_id for r in rows})
    wrong = registry.QUERIES["bad_case_report"](spark, SF).collect()
    scored = registry.QUERIES["logistic_l1"](spark, SF).collect()
    assert {(r.doc_id, r.prediction) for r in wrong} == \
        {(r.doc_id, r.prediction) for r in scored if r.prediction != r.label}


def test_forecast_and_lane_metrics_cover_every_series(spark):
    fc = registry.QUERIES["ar_forecast"](spark, SF).collect()
    kinds = {r.event_type for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect()}
    assert {(r.event_type, r.step) for r in fc} == {(k, i) for k in kinds for i in range(1, 251)}
    assert all(math.isfinite(r.forecast) for r in fc)
    lanes = registry.QUERIES["lane_model_metrics"](spark, SF).collect()
    assert len({r.Devices for r in lanes}) > 1 and len({(r.Devices, r.Lane) for r in lanes}) == len(lanes)
    out = registry.QUERIES["predict_direction"](spark, SF).collect()
    assert out and {r.direction for r in out} <= {"1", "3"} and all(r.predictedValue > 0 for r in out)


def test_coefficients_and_importances(spark):
    coef = registry.QUERIES["coefficient_table"](spark, SF).collect()
    assert [r.feature for r in coef][-1] == "(intercept)" and len({r.feature for r in coef}) == len(coef) == 10
    ar = registry.QUERIES["ar_fit"](spark, SF).collect()
    assert len({r.feature for r in ar}) == len(ar) == 23


def test_cleaning_matches_at_the_next_size(spark):
    """The cleaning pipeline once more where its joins are larger."""
    big = SF.replace("sf0.001", "sf0.01")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{big}/{t}.parquet'")
    sdf = registry.QUERIES["clean_features"](spark, big)
    res = c.execute(registry.ORACLES["clean_features"])
    perm = [[d[0] for d in res.description].index(x) for x in sdf.columns]
    assert sorted([tuple(norm(x) for x in r) for r in sdf.collect()], key=key) == \
        sorted([tuple(norm(r[i]) for i in perm) for r in res.fetchall()], key=key)
