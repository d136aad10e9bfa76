"""Multi-series traffic work: per-series preparation, the global model, direction scoring,
and the autoregressive fit and forecast.

The analysed scripts looped over devices and lanes in Python, re-sorting a device's frame
for every lane and pickling one forest per lane. Here the whole fleet is one DataFrame:
preparation is a skew-safe series fill, training is one distributed fit with the device
and lane as features (per-series closed-form regressions are in ``operators.evaluate``),
and scoring plus the direction roll-up is one ``transform`` and one ``groupBy``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import linear as LN
from tidemark.operators import models as MD
from tidemark.operators import series as SR


def prepare_readings(df: DataFrame, keys: Sequence[str], time: str, seq: str,
                     fill_cols: Sequence[str]) -> DataFrame:
    """Sort each series by time, fill gaps forward then backward, add calendar parts."""
    filled = SR.fill_gaps(df, list(keys), [time, seq], list(fill_cols))
    return filled.withColumns({
        "date": S.date_part(time), "time_of_day": S.time_of_day(time),
        "dayofweek": S.weekday_monday0(time), "hour": S.hour_of_day(time)})


def direction_of(lane_col: str, split_at: int = 30) -> F.Column:
    """Lanes below ``split_at`` form direction "1", the others direction "3"."""
    return F.when(F.col(lane_col) < split_at, F.lit("1")).otherwise(F.lit("3"))


def score_directions(model, readings: DataFrame, device: str, lane: str, time: str,
                     pred: str = "prediction") -> DataFrame:
    """Predict every reading, sum the lane predictions per device, time and direction,
    and return the long table (Jtstation, direction, predictedValue, time) in time order.
    """
    scored = model.transform(readings)
    rolled = scored.groupBy(F.col(device).cast("string").alias("Jtstation"),
                            direction_of(lane).alias("direction"), F.col(time).alias("time")) \
                   .agg(F.sum(pred).alias("predictedValue"))
    return rolled.select("Jtstation", "direction", "predictedValue", "time") \
                 .orderBy("time", "Jtstation", "direction")


# --- autoregression ------------------------------------------------------------------------
def ar_design(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
              lags: int = 20, period: int = 200) -> DataFrame:
    """Lagged values ``{value}_lag_1..lags`` plus the periodic phase of the time index
    (as sine and cosine of ``2*pi*pos/period``) -- the AR input window."""
    posd = SR.lag_features(df, keys, order, value, lags=lags, position="pos")
    ang = F.lit(2 * math.pi / period) * F.col("pos")
    return posd.withColumns({"phase_sin": F.sin(ang), "phase_cos": F.cos(ang)})


def ar_feature_names(value: str, lags: int) -> list[str]:
    return [f"{value}_lag_{i}" for i in range(1, lags + 1)] + ["phase_sin", "phase_cos"]


def ar_fit(design: DataFrame, value: str, lags: int = 20, reg: float = 0.0):
    """One-step-ahead linear AR model shared by all series (rows with a full window)."""
    names = ar_feature_names(value, lags)
    data = MD.assemble(MD.complete_rows(design, names), names).withColumnRenamed(value, "label")
    lr = LinearRegression(regParam=reg, elasticNetParam=0.0, labelCol="label")
    return lr.fit(data), names


def ar_direct_fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  lags: int = 20, horizon: int = 10, period: int = 200, reg: float = 0.0):
    """Direct multi-step AR: one linear model per step ahead (``lead_1..lead_horizon`` as
    targets) over the same lag + phase window -- the ``output window`` form of the model.

    All targets share the rows (whole windows of ``lags + horizon`` points) and so one Gram
    matrix: one table of windows, two passes, one factorisation. Returns (coefficients as
    (feature, step), intercepts by step, feature names). ``reg`` is a ridge penalty.
    """
    posd = SR.lag_features(df, keys, order, value, lags=lags, leads=horizon, position="pos")
    ang = F.lit(2 * math.pi / period) * F.col("pos")
    design = posd.withColumns({"phase_sin": F.sin(ang), "phase_cos": F.cos(ang)})
    names = ar_feature_names(value, lags)
    columns = names + [f"{value}_lead_{h}" for h in range(1, horizon + 1)]
    # one array column: windows with a gap are left out where the sums are taken
    data = MD.training_table(design.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("window")))
    coef, intercepts = LN.solve(LN.gram(data, "window", len(columns)), horizon, reg)
    return coef, intercepts, names


def ar_forecast(design: DataFrame, model, keys: Sequence[str], value: str, lags: int,
                period: int, horizon: int) -> DataFrame:
    """Recursive continuation ``horizon`` steps past the end of every series.

    Per series only the last ``lags`` values and the final position are kept (a bounded
    group, filtered before the aggregation); the recursion itself runs inside one row as
    ``aggregate(sequence(1, h), ...)`` with the fitted coefficients as literals, so all
    series forecast in parallel with no Python per step.
    """
    keys = list(keys)
    coef = [float(x) for x in model.coefficients.toArray()]
    a_lag, (c_sin, c_cos) = coef[:lags], coef[lags:lags + 2]
    b0 = float(model.intercept)
    # Keys are packed in a struct, whose equality is null-safe: a null key is a series too.
    packed = design.select(F.struct(*keys).alias("_sk"), "pos", value)
    ends = packed.groupBy("_sk").agg(F.max("pos").alias("_last"))
    tail = packed.join(ends, "_sk").where(F.col("pos") > F.col("_last") - lags)
    hist = tail.groupBy("_sk", "_last").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", value))),
                    lambda s: s[value]).alias("_hist"))

    def step(acc, t):
        h = acc["h"]
        y = F.lit(b0)
        for i in range(1, lags + 1):
            y = y + F.lit(a_lag[i - 1]) * F.try_element_at(h, F.lit(-i))
        ang = F.lit(2 * math.pi / period) * (F.col("_last") + t)
        y = y + F.lit(c_sin) * F.sin(ang) + F.lit(c_cos) * F.cos(ang)
        return F.struct(F.concat(F.slice(h, 2, lags), F.array(y)).alias("h"),
                        F.concat(acc["out"], F.array(y)).alias("out"))

    start = F.struct(F.col("_hist").alias("h"),
                     F.array().cast("array<double>").alias("out"))
    res = hist.withColumn("_fc", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start,
                                             step)["out"])
    return res.select("_sk.*", F.posexplode("_fc").alias("_i", "forecast")).select(
        *keys, (F.col("_i") + 1).alias("step"), "forecast")


# --- the station workflow as functions ------------------------------------------------------
STATION_FEATURES = ["PercentageCar", "AverageDistance", "TimeOccupy", "Speed", "hour",
                    "dayofweek"]


#: Folders of a split station file, however many devices it holds.
DEVICE_FOLDERS = 64


def load_data(spark, csv_path: str, out_path: str):
    """Read a mixed station file (header replaced by the station schema), split it by device
    into ``DEVICE_FOLDERS`` folders in a single job, and return (devices, readings).

    A device's rows lie in one folder. A folder of its own for each device would make files,
    listings and renames grow with the devices. ``devices`` is a DataFrame of the distinct
    device ids (not a collected list).
    """
    from tidemark.sources import csv as C
    readings = C.read_csv(spark, csv_path, C.STATION_SCHEMA)
    C.write_device_files(readings, out_path, "Devices", DEVICE_FOLDERS, "parquet")
    back = read_split(spark, out_path)
    return back.select("Devices").distinct(), back


def read_split(spark, path: str, device: int | None = None) -> DataFrame:
    """The readings that :func:`load_data` split, or one device's out of its folder alone.

    Ids are integers where all of them fit, as folder names would be read, so that a row's hash
    (which splits the rows) does not depend on the layout.
    """
    from pyspark.sql import types as T
    from tidemark.sources import csv as C
    whole = T.StructType([*C.STATION_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
    back = C.read_partitioned(spark, path, whole)
    low, high = back.agg(F.min("Devices"), F.max("Devices")).first()
    fits = low is not None and -2 ** 31 <= low and high < 2 ** 31
    if device is not None:
        back = C.read_device(spark, path, "Devices", device, C.STATION_SCHEMA, DEVICE_FOLDERS, "parquet")
    return back.select(*[c for c in C.STATION_SCHEMA.names if c != "Devices"],
                       F.col("Devices").cast("int" if fits else "long").alias("Devices"))


def _station_design(readings: DataFrame) -> DataFrame:
    """Fill each (device, lane) series, add calendar parts and assemble the features.

    Station rows carry no id and (time, lane) may repeat within a device, so a hash of
    the whole row (deterministic, recomputed identically on retry) breaks ties in series
    order and identifies the row for splitting. Every reading stays: a feature that is still
    null is NaN in the vector, which trees score; fits take the complete rows.
    """
    keyed = readings.withColumn("_row", F.xxhash64(*readings.columns))
    prepared = prepare_readings(keyed, ["Devices", "Lane"], "Time", "_row", ["Speed"])
    return MD.assemble(prepared, STATION_INPUTS, handle_invalid="keep") \
             .withColumnRenamed("Traffic", "label")


STATION_INPUTS = STATION_FEATURES + ["Lane", "Devices"]


def _complete(design: DataFrame) -> DataFrame:
    return MD.complete_rows(design, STATION_INPUTS + ["label"])


def build_model(readings: DataFrame, num_trees: int = 30, seed: int = 0):
    """One forest for the whole fleet; the lane and the device are features of every row."""
    return MD.rf_regressor(num_trees, 10, seed).fit(_complete(_station_design(readings)))


def build_one_device(readings: DataFrame, device: int, num_trees: int = 30,
                     test_fraction: float = 0.25, seed: int = 0):
    """Fit on one device's readings and report MSE / MAE / R^2 per lane on a held-out
    ``test_fraction`` (the per-lane report of the analysed trainer)."""
    from tidemark.operators import evaluate as EV
    from tidemark.operators import split as SP
    data = _station_design(readings.where(F.col("Devices") == F.lit(device)))
    data = SP.train_test_split(data, "_row", test_fraction)
    model = MD.rf_regressor(num_trees, 10, seed).fit(_complete(data.where("is_test = 0")))
    scored = model.transform(data.where("is_test = 1"))
    return model, EV.regression_metrics(scored, "label", "prediction", ["Lane"])


def lane_metrics(readings: DataFrame, num_trees: int = 30, test_fraction: float = 0.25,
                 seed: int = 0) -> DataFrame:
    """MSE / MAE / R^2 on a held-out ``test_fraction`` for every device and lane, from one fleet
    model in one plan."""
    from tidemark.operators import evaluate as EV
    from tidemark.operators import split as SP
    data = MD.training_table(SP.train_test_split(_station_design(readings), "_row", test_fraction))
    model = MD.rf_regressor(num_trees, 10, seed).fit(_complete(data.where("is_test = 0")))
    scored = model.transform(data.where("is_test = 1"))
    return EV.regression_metrics(scored, "label", "prediction", ["Devices", "Lane"])


def model_predict(model, readings: DataFrame) -> DataFrame:
    """Score readings with a fleet model and roll the lanes up to the two directions."""
    return score_directions(model, _station_design(readings), "Devices", "Lane", "Time")
