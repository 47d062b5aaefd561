"""Queries for forecasting: autoregression, trained models, runs, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import (
    HOURLY, complete, once, pool, query, r, sql_filled, sql_series, sql_windows, sql_with,
)
from tidegauge.functions.accuracy import mae, mse
from tidegauge.operators.autoregression import ar1_fit, ar1_forecast, with_previous
from tidegauge.operators.scaling import minmax_fit, minmax_scale
from tidegauge.operators.scoring import residual_anomalies
from tidegauge.plans.forecaster import Settings, predict, train
from tidegauge.plans.runs import SERIES_KEY, _numbered, predict_run, train_run
from tidegauge.plans.store import list_models, load_model, save_model
from tidegauge.session import scratch_path

SPLIT = "2024-01-22"
TRAIN = "day < DATE '2024-01-22'"
TEST = "day >= DATE '2024-01-22'"
TRAIN_RANGE, TEST_RANGE = "<2023-12-31,2024-01-22)", "<2024-01-22,2024-02-01)"
SPEC = "click|n~click_n|d~click_d;view|n~view_n;error|n~error_n#window_start,window_end"
SETTINGS = Settings(sequence_len=12, steps_ahead=1, delta=True)

PAIRS = (
    sql_windows(HOURLY),
    sql_filled(),
    "zeros AS (SELECT protocol, day, window_start, coalesce(n, 0)::DOUBLE AS n FROM filled)",
    sql_series("zeros"),
    """pairs AS (SELECT * FROM (
         SELECT *, lag(n) OVER (PARTITION BY protocol ORDER BY t) AS n_was FROM ser) WHERE t >= 1)""",
    f"""model AS (SELECT protocol, regr_slope(n, n_was) AS slope, regr_intercept(n, n_was) AS intercept
                  FROM pairs WHERE {TRAIN} GROUP BY protocol)""",
    """fitted AS (SELECT protocol, t, day, window_start, n, n_was, intercept + slope * n_was AS forecast
                  FROM pairs JOIN model USING (protocol))""",
)


def _pairs(spark, sf_dir):
    """Hourly counts on the full grid with zeros, next to the window before."""
    return with_previous(complete(spark, sf_dir, HOURLY), "n")


def _train_rows(pairs):
    return pairs.where(F.col("day") < F.lit(SPLIT).cast("date"))


def _test_rows(pairs):
    return pairs.where(F.col("day") >= F.lit(SPLIT).cast("date"))


@query("ar1_fit", sql_with(*PAIRS) + "SELECT protocol, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM model")
def autoregression(spark, sf_dir):
    model = ar1_fit(_train_rows(_pairs(spark, sf_dir)), "n")
    return model.select("protocol", r("slope"), r("intercept"))


@query(
    "ar1_forecast",
    sql_with(*PAIRS) + f"SELECT protocol, t, window_start, n, round(forecast, 4) AS forecast FROM fitted WHERE {TEST}",
)
def autoregression_forecast(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    predicted = ar1_forecast(_test_rows(pairs), ar1_fit(_train_rows(pairs), "n"), "n")
    return predicted.select("protocol", "t", "window_start", "n", r("forecast", 4))


@query(
    "eval_scaled",
    sql_with(*PAIRS, f"bounds AS (SELECT protocol, min(n) AS lo, max(n) AS hi FROM pairs WHERE {TRAIN} GROUP BY protocol)")
    + f"""SELECT protocol, round(avg(pow((n - forecast) / (hi - lo), 2)), 6) AS mse,
                 round(avg(abs((n - forecast) / (hi - lo))), 6) AS mae
          FROM fitted JOIN bounds USING (protocol) WHERE {TEST} GROUP BY protocol""",
)
def scaled_errors(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    train_rows = _train_rows(pairs)
    fitted = minmax_fit(train_rows, ["n"], by=["protocol"])
    # Both sides use the training bounds of the actual values.
    both = fitted.unionByName(fitted.withColumn("feature", F.lit("forecast")))
    predicted = ar1_forecast(_test_rows(pairs), ar1_fit(train_rows, "n"), "n")
    scaled = minmax_scale(predicted, ["n", "forecast"], both, by=["protocol"])
    scores = scaled.groupBy("protocol").agg(
        mse(F.col("n"), F.col("forecast")).alias("mse"), mae(F.col("n"), F.col("forecast")).alias("mae")
    )
    return scores.select("protocol", r("mse"), r("mae"))


@query(
    "residual_anomaly",
    sql_with(*PAIRS, f"spread AS (SELECT protocol, 3 * stddev_samp(n - forecast) AS threshold FROM fitted WHERE {TRAIN} GROUP BY protocol)")
    + f"""SELECT protocol, t, window_start, round(n - forecast, 4) AS residual, round(threshold, 4) AS threshold,
                 abs(n - forecast) > threshold AS is_anomaly
          FROM fitted JOIN spread USING (protocol) WHERE {TEST}""",
)
def anomalies(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    predicted = ar1_forecast(pairs, ar1_fit(_train_rows(pairs), "n"), "n")
    flagged = residual_anomalies(_test_rows(predicted), "n", "forecast", _train_rows(predicted))
    return flagged.select("protocol", "t", "window_start", r("residual", 4), r("threshold", 4), "is_anomaly")


def _prepared(spark, sf_dir, time_range):
    return _numbered(pool(spark, sf_dir), SPEC, HOURLY, time_range, [])


@query("train_forecaster")
def trained(spark, sf_dir):
    """Coefficients of the linear forecaster, one row per output and input."""
    rows, columns = _prepared(spark, sf_dir, TRAIN_RANGE)
    weights = train(rows, columns, SETTINGS, [SERIES_KEY], 600).weights
    inputs = [f"_in_{c}_{i}" for c in columns for i in range(SETTINGS.sequence_len)]
    found = [(c, name, weight) for c in columns for name, weight in zip([*inputs, "intercept"], weights[c])]
    return spark.createDataFrame(found, "output string, input string, weight double").select("output", "input", r("weight"))


def _shown(forecasts, columns):
    return forecasts.select("t", "window_start", *[r(f"{side}_{c}", 4) for c in columns for side in ("actual", "forecast")])


def stored_model(spark, sf_dir) -> str:
    """Folder with one trained model, for the queries that only apply it."""

    def make():
        root = scratch_path(spark, "models")
        _run(spark, sf_dir, root, "run")
        return root

    return once(spark, sf_dir, "model", make)


@query("forecast")
def forecast(spark, sf_dir):
    model, _ = load_model(spark, stored_model(spark, sf_dir), "run")
    test_rows, columns = _prepared(spark, sf_dir, TEST_RANGE)
    return _shown(predict(model, test_rows, 600), columns)


@query("forecast_horizon")
def forecast_horizon(spark, sf_dir):
    """Boosted trees, three steps ahead, on values instead of changes."""
    train_rows, columns = _prepared(spark, sf_dir, TRAIN_RANGE)
    test_rows, _ = _prepared(spark, sf_dir, TEST_RANGE)
    settings = Settings(sequence_len=6, steps_ahead=3, delta=False, regressor="gbt", passes=5, validation_share=0.1)
    return _shown(predict(train(train_rows, columns, settings, [SERIES_KEY], 600), test_rows, 600), columns)


@query(
    "model_roundtrip",
    sql_with(
        sql_windows(HOURLY),
        *[
            part
            for p in ("click", "view", "error")
            for part in (f"{p}_raw AS (SELECT * FROM win WHERE protocol = '{p}')", sql_filled(f"{p}_raw", f"{p}_all"))
        ],
    )
    + f"""SELECT count(*) - 12 AS forecasts, 0.0::DOUBLE AS click_n, 0.0::DOUBLE AS click_d, 0.0::DOUBLE AS view_n, 0.0::DOUBLE AS error_n
          FROM click_all c JOIN view_all USING (window_start, window_end) JOIN error_all USING (window_start, window_end)
          WHERE c.{TEST}""",
)
def roundtrip(spark, sf_dir):
    """Largest difference between forecasts before saving and after loading: 0."""
    train_rows, columns = _prepared(spark, sf_dir, TRAIN_RANGE)
    test_rows, _ = _prepared(spark, sf_dir, TEST_RANGE)
    made = train(train_rows, columns, SETTINGS, [SERIES_KEY], 600)
    root = scratch_path(spark, "models")
    save_model(spark, made, root, "roundtrip", SPEC, HOURLY, TRAIN_RANGE)
    loaded, _ = load_model(spark, root, "roundtrip")
    one = predict(made, test_rows, 600)
    other = predict(loaded, test_rows, 600).select("t", *[F.col(f"forecast_{c}").alias(f"again_{c}") for c in columns])
    paired = one.join(other, "t")
    return paired.agg(
        F.count(F.lit(1)).alias("forecasts"),
        *[F.max(F.abs(F.col(f"forecast_{c}") - F.col(f"again_{c}"))).alias(c) for c in columns],
    )


def _run(spark, sf_dir, root, name, settings=SETTINGS):
    return train_run(spark, pool(spark, sf_dir), SPEC, HOURLY, TRAIN_RANGE, TEST_RANGE, root, name, settings)


@query("train_run")
def training(spark, sf_dir):
    _, report = _run(spark, sf_dir, scratch_path(spark, "models"), "run")
    return report.select("model", "ws", "train_range", "test_range", "steps_ahead", "feature", "metric", r("value", 5))


@query("predict_run")
def prediction(spark, sf_dir):
    forecasts, _ = predict_run(spark, pool(spark, sf_dir), stored_model(spark, sf_dir), "run", TEST_RANGE)
    return _shown(forecasts, ["click_n", "click_d", "view_n", "error_n"])


@query(
    "list_models",
    f"""SELECT name, '{HOURLY}' AS ws, '{SPEC}' AS spec, '{TRAIN_RANGE}' AS train_range, '{TEST_RANGE}' AS test_range,
               sequence_len::INT AS sequence_len, 24::INT AS metrics
        FROM (VALUES ('one', 12), ('two', 3)) AS stored(name, sequence_len)""",
)
def models(spark, sf_dir):
    root = scratch_path(spark, "models")
    _run(spark, sf_dir, root, "one")
    _run(spark, sf_dir, root, "two", Settings(sequence_len=3, delta=False))
    listed = list_models(spark, root)
    return listed.select(
        "name", "ws", "spec", "train_range", "test_range",
        F.get_json_object("settings", "$.sequence_len").cast("int").alias("sequence_len"),
        F.size("metrics").alias("metrics"),
    )


# ---- one column and few lags, where the regression has a closed form ----

PLAIN_SPEC = "click|n~click_n#window_start,window_end"


def _few_lags(length: int, delta: bool = False) -> Settings:
    return Settings(sequence_len=length, delta=delta, bounded=False, reg_param=0.0)


def _sql_forecast(length: int, delta: bool = False) -> str:
    """Forecasts of the test range by least squares on one or two lags."""
    level = "x - lag(x) OVER w" if delta else "x"
    fit = "1 AS one, regr_slope(y, a) AS wa, 0 AS wb, regr_intercept(y, a) AS c"
    if length == 2:
        det = "(var_pop(a) * var_pop(b) - pow(covar_pop(a, b), 2))"
        fit = f"""(covar_pop(a, y) * var_pop(b) - covar_pop(b, y) * covar_pop(a, b)) / {det} AS wa,
                  (covar_pop(b, y) * var_pop(a) - covar_pop(a, y) * covar_pop(a, b)) / {det} AS wb,
                  avg(y) - wa * avg(a) - wb * avg(b) AS c"""
    first = length if delta else length - 1
    return sql_with(
        sql_windows(HOURLY),
        sql_filled(),
        f"""kept AS (SELECT {TRAIN} AS is_train, window_start, coalesce(n, 0)::DOUBLE AS x FROM filled WHERE protocol = 'click')""",
        f"""levels AS (SELECT *, row_number() OVER w - 1 AS o, lead(x) OVER w AS actual, {level} AS a,
                              lead(window_start) OVER w AS next_start
                       FROM kept WINDOW w AS (PARTITION BY is_train ORDER BY window_start))""",
        f"""origins AS (SELECT * FROM (
               SELECT *, lag(a) OVER (PARTITION BY is_train ORDER BY o) AS b, actual - {"x" if delta else "0"} AS y FROM levels)
             WHERE o >= {first})""",
        f"weights AS (SELECT {fit} FROM origins WHERE is_train AND y IS NOT NULL)",
        f"""forecasts AS (SELECT o + 1 AS t, coalesce(next_start, window_start + to_minutes(10)) AS window_start, actual,
                                 c + wa * a + wb * coalesce(b, 0) + {"x" if delta else "0"} AS forecast
                          FROM origins, weights WHERE NOT is_train)""",
        # Changes over one step are scaled as inputs are, by the extent of all of them.
        "bounds AS (SELECT min(a) AS lo, max(a) AS hi FROM levels WHERE is_train)",
    )


_SHOW = "SELECT t, window_start, round(actual, 4) + 0.0 AS actual_click_n, round(forecast, 4) + 0.0 AS forecast_click_n FROM forecasts"


def _forecast_few(spark, sf_dir, length, delta=False):
    train_rows, columns = _numbered(pool(spark, sf_dir), PLAIN_SPEC, HOURLY, TRAIN_RANGE, [])
    test_rows, _ = _numbered(pool(spark, sf_dir), PLAIN_SPEC, HOURLY, TEST_RANGE, [])
    return _shown(predict(train(train_rows, columns, _few_lags(length, delta), [SERIES_KEY], 600), test_rows, 600), columns)


@query("forecast_one_lag", _sql_forecast(1) + _SHOW)
def forecast_one_lag(spark, sf_dir):
    return _forecast_few(spark, sf_dir, 1)


@query("forecast_one_change", _sql_forecast(1, delta=True) + _SHOW)
def forecast_one_change(spark, sf_dir):
    return _forecast_few(spark, sf_dir, 1, delta=True)


@query("forecast_two_lags", _sql_forecast(2) + _SHOW)
def forecast_two_lags(spark, sf_dir):
    return _forecast_few(spark, sf_dir, 2)


_SQL_METRICS = """SELECT 'click_n' AS feature, metric, round(value, 5) + 0.0 AS value FROM (
  SELECT unnest(['smape', 'r2', 'rmse', 'cosine', 'scaled_mse', 'scaled_mae']) AS metric, unnest([
           CASE WHEN count_if(actual = 0 AND forecast = 0) = 0
                THEN 100 * avg(2 * abs(forecast - actual) / nullif(abs(actual) + abs(forecast), 0)) END,
           1 - sum(pow(actual - forecast, 2)) / (count(*) * var_pop(actual)),
           sqrt(avg(pow(actual - forecast, 2))),
           sum(actual * forecast) / (sqrt(sum(actual * actual)) * sqrt(sum(forecast * forecast))),
           avg(pow((actual - forecast) / (hi - lo), 2)),
           avg(abs(actual - forecast) / (hi - lo))]) AS value
  FROM forecasts, bounds WHERE actual IS NOT NULL GROUP BY lo, hi)"""


def _run_few(spark, sf_dir, root):
    return train_run(spark, pool(spark, sf_dir), PLAIN_SPEC, HOURLY, TRAIN_RANGE, TEST_RANGE, root, "few", _few_lags(1))


@query("train_run_one_lag", _sql_forecast(1) + _SQL_METRICS)
def training_one_lag(spark, sf_dir):
    _, report = _run_few(spark, sf_dir, scratch_path(spark, "models"))
    return report.select("feature", "metric", r("value", 5))


@query("predict_run_one_lag", _sql_forecast(1) + _SQL_METRICS)
def prediction_one_lag(spark, sf_dir):
    """Metrics of a model that was stored and loaded again."""
    root = scratch_path(spark, "models")
    _run_few(spark, sf_dir, root)
    _, metrics = predict_run(spark, pool(spark, sf_dir), root, "few", TEST_RANGE)
    return metrics.select("feature", "metric", r("value", 5))
