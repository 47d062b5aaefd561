"""Queries for positional operators, scaling and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import (
    HOURLY, demand, query, r, series, sql_filled, sql_series, sql_windows, sql_with, TUMBLING,
)
from tidegauge.operators.position import before, with_neighbours
from tidegauge.operators.scaling import minmax_fit, minmax_inverse, minmax_scale
from tidegauge.operators.scoring import error_metrics, score_forecast
from tidegauge.operators.series import (
    first_difference, future_rows, horizon_target, inverse_difference, positional_slice, sequence_windows,
)

SER = (sql_windows(HOURLY), sql_series())
LENGTH, AHEAD = 12, 3
OVER = "OVER (PARTITION BY protocol ORDER BY t)"


@query("positional_slice", sql_with(*SER) + "SELECT protocol, t, window_start, n, d FROM ser WHERE t >= 12 AND t < n_rows - 3")
def sliced(spark, sf_dir):
    return positional_slice(series(spark, sf_dir), LENGTH, AHEAD).select("protocol", "t", "window_start", "n", "d")


@query(
    "first_difference",
    sql_with(*SER)
    + f"""SELECT * FROM (SELECT protocol, t, window_start, n - lag(n) {OVER} AS n, d - lag(d) {OVER} AS d,
                 round(v - lag(v) {OVER}, 4) + 0.0::DOUBLE AS v FROM ser) WHERE t >= 1""",
)
def differences(spark, sf_dir):
    changed = first_difference(series(spark, sf_dir), ["n", "d", "v"])
    return changed.select("protocol", "t", "window_start", "n", "d", r("v", 4))


@query(
    "first_difference_respecting_gaps",
    sql_with(*SER)
    + f"""SELECT protocol, t, window_start, CASE WHEN window_start - before <= INTERVAL 10 MINUTE THEN change END AS n
          FROM (SELECT *, lag(window_start) {OVER} AS before, n - lag(n) {OVER} AS change FROM ser) WHERE t >= 1""",
)
def differences_in_gaps(spark, sf_dir):
    changed = first_difference(series(spark, sf_dir), ["n"], gap_slide_seconds=600)
    return changed.select("protocol", "t", "window_start", "n")


def _lags(column: str) -> str:
    return ", ".join(f"lag({column}, {i}) {OVER} AS {column}_lag{i}" for i in range(1, LENGTH + 1))


@query(
    "sequence_windows",
    sql_with(*SER)
    + f"SELECT * FROM (SELECT protocol, t, n, d, {_lags('n')}, {_lags('d')} FROM ser) WHERE t >= {LENGTH}",
)
def sequences(spark, sf_dir):
    rows = series(spark, sf_dir).select("protocol", "t", "n", "d")
    return sequence_windows(rows, ["n", "d"], LENGTH)


@query(
    "horizon_target",
    sql_with(*SER)
    + f"""SELECT * FROM (SELECT protocol, t, n, d, lead(n, {AHEAD - 1}) {OVER} AS n_target,
                 lead(d, {AHEAD - 1}) {OVER} AS d_target FROM ser) WHERE n_target IS NOT NULL""",
)
def targets(spark, sf_dir):
    return horizon_target(series(spark, sf_dir).select("protocol", "t", "n", "d"), ["n", "d"], AHEAD)


@query(
    "future_rows",
    sql_with(*SER)
    + f"""SELECT protocol, t, window_start, window_end, n, d FROM ser
          UNION ALL
          SELECT protocol, t + k, window_start + to_seconds(600 * k), window_end + to_seconds(600 * k), NULL, NULL
          FROM ser, range(1, {AHEAD + 1}) AS s(k) WHERE t = n_rows - 1""",
)
def future(spark, sf_dir):
    rows = series(spark, sf_dir).select("protocol", "t", "window_start", "window_end", "n", "d")
    return future_rows(rows, AHEAD, 600)


@query(
    "inverse_difference",
    sql_with(*SER)
    + f"""SELECT * FROM (SELECT protocol, t, 2 * lag(n) {OVER} - lag(n, 2) {OVER} AS n_forecast,
                 2 * lag(d) {OVER} - lag(d, 2) {OVER} AS d_forecast FROM ser) WHERE t >= 2""",
)
def drift(spark, sf_dir):
    """Drift forecast: the last change repeated, added back to the last value."""
    made = {
        f"{c}_forecast": lambda spec, c=c: F.lag(c).over(spec) - F.lag(c, 2).over(spec) for c in ("n", "d")
    }
    rows = with_neighbours(series(spark, sf_dir).select("protocol", "t", "n", "d"), made, back=2)
    restored = inverse_difference(rows, {"n": "n_forecast", "d": "d_forecast"})
    return restored.where("t >= 2").select("protocol", "t", "n_forecast", "d_forecast")


BOUNDS = """bounds AS (
  SELECT protocol, min(n)::DOUBLE AS n_lo, max(n)::DOUBLE AS n_hi, min(d)::DOUBLE AS d_lo, max(d)::DOUBLE AS d_hi
  FROM ser GROUP BY protocol)"""


@query(
    "minmax_fit",
    """WITH long AS (
         UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
         ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x)
       SELECT feature, min(x) AS lo, max(x) AS hi, max(x) - min(x) AS span FROM long GROUP BY feature""",
)
def bounds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return minmax_fit(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _scaled(spark, sf_dir):
    rows = series(spark, sf_dir).select("protocol", "t", "n", "d")
    fitted = minmax_fit(rows, ["n", "d"], by=["protocol"])
    return minmax_scale(rows, ["n", "d"], fitted, by=["protocol"]), fitted


@query(
    "minmax_scale",
    sql_with(*SER, BOUNDS)
    + """SELECT protocol, t, round((n - n_lo) / CASE WHEN n_hi = n_lo THEN 1 ELSE n_hi - n_lo END, 6) AS n,
                round((d - d_lo) / CASE WHEN d_hi = d_lo THEN 1 ELSE d_hi - d_lo END, 6) AS d
         FROM ser JOIN bounds USING (protocol)""",
)
def scale(spark, sf_dir):
    return _scaled(spark, sf_dir)[0].select("protocol", "t", r("n"), r("d"))


@query("minmax_inverse", sql_with(*SER) + "SELECT protocol, t, round(n::DOUBLE, 6) AS n, round(d::DOUBLE, 6) AS d FROM ser")
def unscale(spark, sf_dir):
    scaled, fitted = _scaled(spark, sf_dir)
    return minmax_inverse(scaled, ["n", "d"], fitted, by=["protocol"]).select("protocol", "t", r("n"), r("d"))


# Error metrics score the persistence forecast: each window repeats the one before.

PAIRS = f"""pairs AS (
  SELECT protocol, feature, a, f FROM (
    SELECT protocol, t, unnest(['n', 'd', 'v']) AS feature, unnest([n::DOUBLE, d::DOUBLE, v]) AS a,
           unnest([n0::DOUBLE, d0::DOUBLE, v0]) AS f
    FROM (SELECT *, lag(n) {OVER} AS n0, lag(d) {OVER} AS d0, lag(v) {OVER} AS v0 FROM ser))
  WHERE t >= 1)"""
SQL_METRICS = {
    "rmse": "sqrt(avg((a - f) * (a - f)))",
    "cosine": "sum(a * f) / nullif(sqrt(sum(a * a)) * sqrt(sum(f * f)), 0)",
    "r2": """CASE WHEN count(*) * var_pop(a) > 0 THEN 1 - sum((a - f) * (a - f)) / (count(*) * var_pop(a))
             WHEN sum((a - f) * (a - f)) = 0 THEN 1 ELSE 0 END""",
    "mape": "CASE WHEN count(*) FILTER (a = 0) = 0 THEN avg(abs((a - f) / nullif(a, 0))) * 100 END",
    "smape": """CASE WHEN count(*) FILTER (a = 0 AND f = 0) = 0
                THEN avg(2 * abs(f - a) / nullif(abs(a) + abs(f), 0)) * 100 END""",
}


def _metric_sql(metric: str) -> str:
    return (
        sql_with(*SER, PAIRS)
        + f"""SELECT protocol, feature, '{metric}' AS metric, round({SQL_METRICS[metric]}, 5) AS value
              FROM pairs GROUP BY protocol, feature"""
    )


def _persistence(spark, sf_dir):
    made = {f"{c}_forecast": before(c) for c in ("n", "d", "v")}
    return with_neighbours(series(spark, sf_dir), made, back=1).where("t >= 1")


def _register(metric: str):
    @query(f"metric_{metric}", _metric_sql(metric))
    def scored(spark, sf_dir):
        pairs = {c: (c, f"{c}_forecast") for c in ("n", "d", "v")}
        result = error_metrics(_persistence(spark, sf_dir), pairs, [metric], by=["protocol"])
        return result.withColumn("value", F.round("value", 5))


for _metric in ("rmse", "cosine", "r2", "mape"):
    _register(_metric)

DEMAND = (
    sql_windows(TUMBLING),
    sql_filled(),
    "zeros AS (SELECT protocol, window_start, coalesce(n, 0)::DOUBLE AS n FROM filled)",
    sql_series("zeros"),
)


@query(
    "metric_smape",
    sql_with(*DEMAND, f"pairs AS (SELECT * FROM (SELECT protocol, t, n AS a, lag(n) {OVER} AS f FROM ser) WHERE t >= 1)")
    + f"""SELECT protocol, 'n' AS feature, 'smape' AS metric, round({SQL_METRICS['smape']}, 5) AS value
          FROM pairs GROUP BY protocol
          UNION ALL
          SELECT protocol, 'n', 'smape_defined', round(avg(2 * abs(f - a) / nullif(abs(a) + abs(f), 0)) * 100, 5)
          FROM pairs GROUP BY protocol""",
)
def smape_on_demand(spark, sf_dir):
    """Zero demand twice in a row leaves the strict score undefined."""
    rows = with_neighbours(demand(spark, sf_dir), {"n_forecast": before("n")}, back=1).where("t >= 1")
    pairs = {"n": ("n", "n_forecast")}
    strict = error_metrics(rows, pairs, ["smape"], by=["protocol"])
    defined = error_metrics(rows, pairs, ["smape"], by=["protocol"], skip_undefined=True)
    both = strict.unionByName(defined.withColumn("metric", F.lit("smape_defined")))
    return both.withColumn("value", F.round("value", 5))


@query(
    "metric_bundle",
    sql_with(*SER, PAIRS)
    + " UNION ALL ".join(
        f"""SELECT protocol, feature, '{m}' AS metric, round({SQL_METRICS[m]}, 5) AS value
            FROM pairs GROUP BY protocol, feature HAVING count(*) > 1"""
        for m in ("smape", "r2", "rmse", "cosine")
    ),
)
def bundle(spark, sf_dir):
    rows = series(spark, sf_dir)
    columns = ["n", "d", "v"]
    # A persistence forecast is the series itself, keyed by the next position.
    forecast = rows.select("protocol", (F.col("t") + 1).alias("t"), *columns)
    scored = score_forecast(rows, forecast, columns, ["protocol", "t"], by=["protocol"])
    return scored.withColumn("value", F.round("value", 5))
