"""Train and predict runs over a datapool."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.times import parse_window_tag
from tidegauge.operators.position import with_position
from tidegauge.operators.scoring import BUNDLE, error_metrics
from tidegauge.plans.forecaster import Forecaster, Settings, predict, train
from tidegauge.plans.store import load_model, save_model
from tidegauge.session import materialise
from tidegauge.sources.datapool import WINDOW_KEYS, select_series

SERIES_KEY = "series"


def _numbered(pool: DataFrame, spec, ws: str, time_range, excluded) -> tuple[DataFrame, list[str]]:
    """The selected series, stored once, with positions, and its feature columns."""
    chosen = materialise(select_series(pool, spec, ws, time_range, excluded), "series")
    columns = [c for c in chosen.columns if c not in WINDOW_KEYS]
    return with_position(chosen.withColumn(SERIES_KEY, F.lit("main")), by=[SERIES_KEY]), columns


def score(forecasts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metrics of a forecast frame, ``(feature, metric, value)``: the bundle on
    original values, and mean squared and absolute error on scaled ones."""
    original = error_metrics(forecasts, {c: (f"actual_{c}", f"forecast_{c}") for c in columns}, BUNDLE)
    in_scale = error_metrics(
        forecasts, {c: (f"scaled_actual_{c}", f"scaled_forecast_{c}") for c in columns}, ("mse", "mae")
    )
    return original.unionByName(in_scale.withColumn("metric", F.concat(F.lit("scaled_"), "metric")))


def train_run(
    spark: SparkSession,
    pool: DataFrame,
    spec: str | Sequence[dict],
    ws: str,
    train_range: str,
    test_range: str,
    model_root: str,
    name: str,
    settings: Settings | None = None,
    train_excluded: Sequence[str] = (),
    test_excluded: Sequence[str] = (),
) -> tuple[Forecaster, DataFrame]:
    """Read both ranges with one spec, train, predict the test range, score, save.

    Returns the forecaster and a report with one row per feature and metric.
    """
    settings = settings or Settings()
    slide = parse_window_tag(ws)[1]
    train_series, columns = _numbered(pool, spec, ws, train_range, train_excluded)
    started = time.monotonic()
    forecaster = train(train_series, columns, settings, [SERIES_KEY], slide)
    seconds = time.monotonic() - started
    test_series, _ = _numbered(pool, spec, ws, test_range, test_excluded)
    forecasts = materialise(predict(forecaster, test_series, slide), "forecasts")
    metrics = score(forecasts, columns)
    rows = [(r["feature"], r["metric"], r["value"]) for r in metrics.collect()]
    save_model(
        spark, forecaster, model_root, name, spec, ws, train_range, train_excluded,
        test_range, test_excluded, rows, seconds,
    )
    report = spark.createDataFrame(rows, "feature string, metric string, value double").withColumns(
        {
            "model": F.lit(name), "ws": F.lit(ws), "spec": F.lit(spec if isinstance(spec, str) else json.dumps(list(spec))),
            "train_range": F.lit(train_range), "test_range": F.lit(test_range),
            "steps_ahead": F.lit(settings.steps_ahead), "training_seconds": F.lit(seconds),
        }
    )
    return forecaster, report


def predict_run(
    spark: SparkSession,
    pool: DataFrame,
    model_root: str,
    name: str,
    time_range: str,
    excluded: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Apply a stored model, with its own spec and window tag, to a new range.

    Returns the forecasts and their metrics.
    """
    forecaster, meta = load_model(spark, model_root, name)
    series, columns = _numbered(pool, meta["spec"], meta["ws"], time_range, excluded)
    forecasts = materialise(predict(forecaster, series, parse_window_tag(meta["ws"])[1]), "forecasts")
    return forecasts, score(forecasts, columns)
