"""Forecast error formulas as aggregate columns over (actual, forecast) pairs.

Every formula reads only rows where both sides are present and is a plain
algebraic aggregate, so Spark combines it on the map side. Division goes
through ``try_divide`` because ANSI mode raises on a zero divisor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(actual: Column, forecast: Column) -> tuple[Column, Column]:
    both = actual.isNotNull() & forecast.isNotNull()
    return (
        F.when(both, actual.cast("double")),
        F.when(both, forecast.cast("double")),
    )


def rmse(actual: Column, forecast: Column) -> Column:
    a, f = _pair(actual, forecast)
    return F.sqrt(F.avg((a - f) * (a - f)))


def cosine(actual: Column, forecast: Column) -> Column:
    """NULL when either side is all zero."""
    a, f = _pair(actual, forecast)
    return F.try_divide(F.sum(a * f), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(f * f)))


def r2(actual: Column, forecast: Column) -> Column:
    """A constant actual scores 1 with a perfect forecast and 0 otherwise."""
    a, f = _pair(actual, forecast)
    residual = F.sum((a - f) * (a - f))
    total = F.count(a) * F.var_pop(a)
    return F.when(total > 0, 1 - F.try_divide(residual, total)).when(residual == 0, 1.0).when(
        residual > 0, 0.0
    )


def mape(actual: Column, forecast: Column) -> Column:
    """Percent; NULL when any actual is 0."""
    a, f = _pair(actual, forecast)
    return F.when(F.count_if(a == 0) == 0, F.avg(F.abs(F.try_divide(a - f, a))) * 100)


def smape(actual: Column, forecast: Column, skip_undefined: bool = False) -> Column:
    """Percent in 0..200. A row with both sides 0 makes the result NULL, or is
    left out altogether with ``skip_undefined``."""
    a, f = _pair(actual, forecast)
    share = F.try_divide(2 * F.abs(f - a), F.abs(a) + F.abs(f))
    score = F.avg(share) * 100
    if skip_undefined:
        return score
    return F.when(F.count_if((a == 0) & (f == 0)) == 0, score)


def mse(actual: Column, forecast: Column) -> Column:
    a, f = _pair(actual, forecast)
    return F.avg((a - f) * (a - f))


def mae(actual: Column, forecast: Column) -> Column:
    a, f = _pair(actual, forecast)
    return F.avg(F.abs(a - f))


FORMULAS = {
    "rmse": rmse,
    "cosine": cosine,
    "r2": r2,
    "mape": mape,
    "smape": smape,
    "mse": mse,
    "mae": mae,
}
