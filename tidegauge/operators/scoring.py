"""Forecast error metrics as a long table, and residual flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.accuracy import FORMULAS, smape
from tidegauge.operators.joins import attach

BUNDLE = ("smape", "r2", "rmse", "cosine")


def error_metrics(
    pairs: DataFrame,
    features: dict[str, tuple[str, str]],
    metrics: Sequence[str] = BUNDLE,
    by: Sequence[str] = (),
    skip_undefined: bool = False,
) -> DataFrame:
    """Score every feature with every metric in one aggregation.

    ``features`` maps a name to its ``(actual, forecast)`` columns. The result
    is ``(by..., feature, metric, value)``; a feature with fewer than two
    complete pairs has no rows.
    """
    by = list(by)

    def score(metric: str, actual, forecast):
        if metric == "smape":
            return smape(actual, forecast, skip_undefined)
        return FORMULAS[metric](actual, forecast)

    wide = pairs.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count_if(F.col(a).isNotNull() & F.col(f).isNotNull()).alias("pairs"),
                *[score(m, F.col(a), F.col(f)).cast("double").alias(m) for m in metrics],
            ).alias(name)
            for name, (a, f) in features.items()
        ]
    )
    rows = wide.select(*by, F.explode(F.array(*[F.col(n) for n in features])).alias("_s"))
    return (
        rows.where("_s.pairs > 1")
        .select(*by, "_s.*")
        .drop("pairs")
        .unpivot([*by, "feature"], list(metrics), "metric", "value")
    )


def score_forecast(
    actual: DataFrame,
    forecast: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    metrics: Sequence[str] = BUNDLE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Join actual and forecast values on the target position, then score them.

    ``keys`` identify one target, e.g. ``["protocol", "t"]``, so no join key
    holds more than one row per side.
    """
    right = forecast.select(*keys, *[F.col(c).alias(f"{c}_forecast") for c in columns])
    pairs = actual.select(*keys, *columns).join(right, list(keys))
    return error_metrics(pairs, {c: (c, f"{c}_forecast") for c in columns}, metrics, by)


def residual_anomalies(
    pairs: DataFrame,
    actual: str,
    forecast: str,
    training: DataFrame,
    factor: float = 3.0,
    by: Sequence[str] = ("protocol",),
) -> DataFrame:
    """Add ``residual``, ``threshold`` and ``is_anomaly`` to actual/forecast pairs.

    A window is flagged where its residual exceeds ``factor`` standard
    deviations of the residuals in ``training``, which has the same columns.
    """
    by = list(by)
    spread = training.groupBy(*by).agg(
        (F.stddev_samp(F.col(actual) - F.col(forecast)) * factor).alias("threshold")
    )
    marked = attach(pairs, spread, by).withColumn("residual", F.col(actual) - F.col(forecast))
    return marked.withColumn("is_anomaly", F.abs("residual") > F.col("threshold"))
