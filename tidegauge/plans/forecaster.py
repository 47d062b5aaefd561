"""Multivariate one-shot forecaster: preparation, training and prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.numeric import to_number
from tidegauge.functions.times import epoch_seconds, from_epoch_seconds
from tidegauge.operators.position import BLOCK_ROWS, after, before, with_neighbours
from tidegauge.operators.repair import interpolate_linear, zero_fill
from tidegauge.operators.scaling import scaled, unscaled
from tidegauge.operators.series import lag_name
from tidegauge.plans.linear import ridge, sample_moments
from tidegauge.session import materialise

REGRESSORS = ("linear", "gbt", "random_forest", "fm")
#: Widest sequence whose normal equations are summed in one pass; beyond it, or
#: with options for Spark's own solver, the solution is approached iteratively.
MOMENT_INPUTS = 256


@dataclass
class Settings:
    """Hyperparameters of a forecaster.

    ``passes`` bounds the iterations (or trees). Iterative solvers stop earlier
    once the loss improves by less than ``tol``; boosting does so once its error
    on the validation share improves by less than ``patience``. Direct solutions
    and forests have nothing to stop.
    """

    sequence_len: int = 12
    steps_ahead: int = 1
    delta: bool = True
    interpolate: bool = False
    regressor: str = "linear"
    passes: int = 50
    patience: float = 0.01
    tol: float = 1e-6
    validation_share: float = 0.0
    bounded: bool = True
    reg_param: float = 1e-6
    seed: int = 7
    options: dict = field(default_factory=dict)


@dataclass
class Forecaster:
    """A fitted model with everything prediction needs."""

    settings: Settings
    columns: list[str]
    by: list[str]
    input_bounds: dict[str, tuple[float, float]]
    target_bounds: dict[str, tuple[float, float]]
    model: PipelineModel
    #: Of a linear model fitted directly: weights of the scaled inputs, then the intercept.
    weights: dict[str, list[float]] | None = None


def _input_name(column: str, step: int) -> str:
    return f"_in_{column}_{step}"


def repair(df: DataFrame, columns: Sequence[str], by: Sequence[str], settings: Settings, position: str = "t") -> DataFrame:
    """Numeric repair before modelling: numbers, interpolation if asked for, then zeros."""
    if settings.interpolate:
        df = df.withColumns({c: to_number(F.col(c)) for c in columns})
        df = interpolate_linear(df, columns, by, position)
    return zero_fill(df, columns)


def samples(
    series: DataFrame,
    columns: Sequence[str],
    settings: Settings,
    by: Sequence[str],
    slide_seconds: int,
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per forecast origin, unscaled.

    ``_in_<c>_<i>`` is the i-th most recent input (a change when ``delta``),
    ``base_<c>`` the last known value, ``_out_<c>`` the target in model terms
    (the change over the horizon when ``delta``) and ``actual_<c>`` the true
    value. The key is the target's position and ``window_start``; origins near
    the end of a series get targets after it, with NULL actual values. History
    and target come from a single block window.
    """
    length, ahead = settings.sequence_len, settings.steps_ahead
    back = length if settings.delta else length - 1
    made = {lag_name(c, i): before(c, i) for c in columns for i in range(1, back + 1)}
    made |= {f"actual_{c}": after(c, ahead) for c in columns}
    made["_target_start"] = after("window_start", ahead)
    made["_end_start"] = lambda spec: F.last("window_start").over(spec.rowsBetween(0, ahead))
    made["_end_position"] = lambda spec: F.last(position).over(spec.rowsBetween(0, ahead))
    kept = series.select(*by, position, "window_start", *columns)
    seen = with_neighbours(kept, made, back=back, ahead=ahead, by=by, position=position, block_rows=block_rows)
    target = F.col(position) + ahead
    beyond = from_epoch_seconds(
        epoch_seconds(F.col("_end_start")) + (target - F.col("_end_position")) * slide_seconds
    )

    def at(column: str, steps: int) -> str:
        return f"`{lag_name(column, steps)}`" if steps else f"`{column}`"

    # As SQL text: there is one expression per column and step.
    inputs = [
        f"{at(c, i)} - {at(c, i + 1)} AS `{_input_name(c, i)}`" if settings.delta else f"{at(c, i)} AS `{_input_name(c, i)}`"
        for c in columns
        for i in range(length)
    ]
    targets = [f"`actual_{c}` - `{c}` AS `_out_{c}`" if settings.delta else f"`actual_{c}` AS `_out_{c}`" for c in columns]
    return seen.where(F.col(position) >= back).select(
        *by,
        target.alias(position),
        F.coalesce("_target_start", beyond).alias("window_start"),
        *[F.expr(text) for text in inputs + targets],
        *[F.col(c).alias(f"base_{c}") for c in columns],
        *[f"actual_{c}" for c in columns],
    )


def _inputs(columns: Sequence[str], settings: Settings) -> list[tuple[str, str]]:
    return [(c, _input_name(c, i)) for c in columns for i in range(settings.sequence_len)]


def _fit_bounds(rows: DataFrame, columns: Sequence[str], settings: Settings) -> tuple[dict, dict]:
    """Training bounds of inputs and targets, from one aggregation.

    Targets share the input bounds unless they are changes over several steps.
    """

    def extent(names: list[str], pick, fold) -> Column:
        return fold(pick(*names) if len(names) > 1 else F.col(names[0])).cast("double")

    own_targets = settings.delta and settings.steps_ahead > 1
    groups = {("in", c): [_input_name(c, i) for i in range(settings.sequence_len)] for c in columns}
    if own_targets:
        groups |= {("out", c): [f"_out_{c}"] for c in columns}
    row = rows.agg(
        *[extent(names, F.least, F.min).alias(f"{side}_lo_{c}") for (side, c), names in groups.items()],
        *[extent(names, F.greatest, F.max).alias(f"{side}_hi_{c}") for (side, c), names in groups.items()],
    ).head()
    inputs = {c: (row[f"in_lo_{c}"], row[f"in_hi_{c}"]) for c in columns}
    if any(lo is None for lo, _ in inputs.values()):
        raise ValueError("not enough rows for one full input sequence")
    if not own_targets:
        return inputs, dict(inputs)
    return inputs, {c: (row[f"out_lo_{c}"], row[f"out_hi_{c}"]) for c in columns}


def _with_scaled_inputs(rows: DataFrame, columns, settings: Settings, bounds: dict) -> DataFrame:
    """:func:`~tidegauge.operators.scaling.scaled` with literal bounds on every input."""
    made = {}
    for c, name in _inputs(columns, settings):
        lo, hi = bounds[c]
        made[name] = F.expr(f"(CAST(`{name}` AS DOUBLE) - {float(lo)!r}D) / {float(hi - lo) or 1.0!r}D")
    return rows.withColumns(made)


def _regressor(settings: Settings, column: str):
    common = {
        "featuresCol": "_features", "labelCol": f"_label_{column}", "predictionCol": f"_pred_{column}",
    } | settings.options
    if settings.regressor == "linear":
        # Overlapping windows make lags nearly dependent, hence the small penalty.
        return LinearRegression(maxIter=settings.passes, regParam=settings.reg_param, tol=settings.tol, **common)
    if settings.regressor == "gbt":
        stop = {"validationIndicatorCol": "_validation", "validationTol": settings.patience}
        return GBTRegressor(
            maxIter=settings.passes, seed=settings.seed, **(stop if settings.validation_share else {}), **common
        )
    if settings.regressor == "random_forest":
        return RandomForestRegressor(numTrees=settings.passes, seed=settings.seed, **common)
    return FMRegressor(maxIter=settings.passes, tol=settings.tol, seed=settings.seed, **common)


def _train_linear(
    series: DataFrame, columns: list[str], settings: Settings, by: list[str], position: str
) -> Forecaster:
    """All outputs from the joint moments of inputs and targets."""
    inputs = len(columns) * settings.sequence_len
    found = sample_moments(series, columns, settings.sequence_len, settings.steps_ahead, settings.delta, by, position)
    if not found.count:
        raise ValueError("not enough rows for one full input sequence")
    low, high = (np.split(side[:inputs], len(columns)) for side in (found.low, found.high))
    input_bounds = {c: (float(lo.min()), float(hi.max())) for c, lo, hi in zip(columns, low, high)}
    target_bounds = dict(input_bounds)
    if settings.delta and settings.steps_ahead > 1:
        target_bounds = {c: (float(found.low[inputs + k]), float(found.high[inputs + k])) for k, c in enumerate(columns)}
    base, span = (
        np.array([f(*input_bounds[c]) for c, _ in _inputs(columns, settings)])
        for f in (lambda lo, hi: lo, lambda lo, hi: hi - lo or 1.0)
    )
    target_span = np.array([hi - lo or 1.0 for lo, hi in (target_bounds[c] for c in columns)])
    weights = ridge(found, inputs, settings.reg_param, span, target_span)
    middle = (found.mean[:inputs] - base) / span
    shown, fitted = [], {}
    for k, c in enumerate(columns):
        level = (found.mean[inputs + k] - target_bounds[c][0]) / target_span[k]
        fitted[c] = [*map(float, weights[k]), float(level - weights[k] @ middle)]
        terms = [f"{w!r}D * `{name}`" for w, (_, name) in zip(fitted[c], _inputs(columns, settings))]
        shown.append(f"{' + '.join([f'{fitted[c][-1]!r}D', *terms])} AS `_pred_{c}`")
    formula = SQLTransformer(statement=f"SELECT *, {', '.join(shown)} FROM __THIS__")
    return Forecaster(settings, columns, by, input_bounds, target_bounds, PipelineModel(stages=[formula]), fitted)


def train(
    series: DataFrame,
    columns: Sequence[str],
    settings: Settings,
    by: Sequence[str],
    slide_seconds: int,
    position: str = "t",
) -> Forecaster:
    """Fit one regressor per column on scaled sequences of all columns.

    Linear models read the series once. For others the repaired series is stored
    and its sequences are made again where they are needed. With
    ``validation_share`` the latest part of the training time span decides when
    boosting stops.
    """
    columns, by = list(columns), list(by)
    if settings.regressor not in REGRESSORS:
        raise ValueError(f"unknown regressor {settings.regressor!r}, choose from {REGRESSORS}")
    repaired = repair(series, columns, by, settings, position)
    if settings.regressor == "linear" and not settings.options and len(columns) * settings.sequence_len <= MOMENT_INPUTS:
        return _train_linear(repaired, columns, settings, by, position)
    repaired = materialise(repaired.select(*by, position, "window_start", *columns), "repaired")
    rows = samples(repaired, columns, settings, by, slide_seconds, position)
    input_bounds, target_bounds = _fit_bounds(rows, columns, settings)
    known = rows.where(reduce(lambda a, b: a & b, [F.col(f"_out_{c}").isNotNull() for c in columns]))
    labelled = _with_scaled_inputs(known, columns, settings, input_bounds).withColumns(
        {f"_label_{c}": scaled(F.col(f"_out_{c}").cast("double"), *map(F.lit, target_bounds[c])) for c in columns}
    )
    if settings.validation_share:
        span = known.agg(
            F.min(epoch_seconds(F.col("window_start"))).alias("lo"), F.max(epoch_seconds(F.col("window_start"))).alias("hi")
        ).head()
        cut = span["hi"] - settings.validation_share * (span["hi"] - span["lo"])
        labelled = labelled.withColumn("_validation", epoch_seconds(F.col("window_start")) > cut)
    assembler = VectorAssembler(inputCols=[n for _, n in _inputs(columns, settings)], outputCol="_features")
    used = ["_features", *[f"_label_{c}" for c in columns], *(["_validation"] if settings.validation_share else [])]
    # Kept while fitting only: every regressor passes over the same vectors.
    ready = assembler.transform(labelled).select(*used).persist()
    try:
        fitted = [_regressor(settings, c).fit(ready) for c in columns]
    finally:
        ready.unpersist()
    return Forecaster(
        settings, columns, by, input_bounds, target_bounds, PipelineModel(stages=[assembler, *fitted])
    )


def predict(
    forecaster: Forecaster, series: DataFrame, slide_seconds: int, position: str = "t"
) -> DataFrame:
    """Forecasts keyed by target position and ``window_start``.

    ``forecast_<c>`` and ``actual_<c>`` are in original units (actual NULL beyond
    the end); ``scaled_forecast_<c>`` and ``scaled_actual_<c>`` in model units
    with the training bounds.
    """
    settings, columns, by = forecaster.settings, forecaster.columns, forecaster.by
    repaired = repair(series, columns, by, settings, position)
    rows = samples(repaired, columns, settings, by, slide_seconds, position)
    predicted = forecaster.model.transform(_with_scaled_inputs(rows, columns, settings, forecaster.input_bounds))
    result = [*by, position, "window_start"]
    for c in columns:
        bounds = [F.lit(b) for b in forecaster.target_bounds[c]]
        raw = F.col(f"_pred_{c}")
        if settings.bounded:
            raw = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
        value = unscaled(raw, *bounds)
        result += [
            F.col(f"actual_{c}").cast("double").alias(f"actual_{c}"),
            (F.col(f"base_{c}") + value if settings.delta else value).alias(f"forecast_{c}"),
            scaled(F.col(f"_out_{c}").cast("double"), *bounds).alias(f"scaled_actual_{c}"),
            raw.alias(f"scaled_forecast_{c}"),
        ]
    return predicted.select(*result)
