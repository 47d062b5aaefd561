"""Min-max scaling with bounds kept as data, so they can be stored and reused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.joins import attach


def minmax_fit(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Bounds per column in one pass: ``(by..., feature, lo, hi, span)``."""
    wide = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.min(c).cast("double").alias("lo"),
                F.max(c).cast("double").alias("hi"),
            ).alias(c)
            for c in columns
        ]
    )
    bounds = wide.select(*by, F.explode(F.array(*[F.col(c) for c in columns])).alias("_b"))
    return bounds.select(*by, "_b.feature", "_b.lo", "_b.hi", (F.col("_b.hi") - F.col("_b.lo")).alias("span"))


def bounds_of(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Bounds without a series key as a dictionary, one entry per column."""
    return {r["feature"]: (r["lo"], r["hi"]) for r in bounds.select("feature", "lo", "hi").collect()}


def scaled(value: Column, lo: Column, hi: Column) -> Column:
    """``(x - lo) / (hi - lo)``; a constant column has divisor 1. Not clipped."""
    span = hi - lo
    return (value - lo) / F.when(span == 0, 1.0).otherwise(span)


def unscaled(value: Column, lo: Column, hi: Column) -> Column:
    span = hi - lo
    return value * F.when(span == 0, 1.0).otherwise(span) + lo


def _with_bounds(df: DataFrame, columns: Sequence[str], bounds, by: Sequence[str], formula) -> DataFrame:
    if not by and not isinstance(bounds, dict):
        bounds = bounds_of(bounds)
    if isinstance(bounds, dict):
        return df.withColumns(
            {c: formula(F.col(c).cast("double"), F.lit(bounds[c][0]), F.lit(bounds[c][1])) for c in columns}
        )
    wide = bounds.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("lo", "hi"))).alias(f"_b_{c}") for c in columns]
    )
    joined = attach(df, wide, by)
    return joined.withColumns(
        {c: formula(F.col(c).cast("double"), F.col(f"_b_{c}.lo"), F.col(f"_b_{c}.hi")) for c in columns}
    ).drop(*[f"_b_{c}" for c in columns])


def minmax_scale(df: DataFrame, columns: Sequence[str], bounds, by: Sequence[str] = ()) -> DataFrame:
    """Scale columns to the unit range of the data the bounds were fitted on.

    ``bounds`` is a dictionary from :func:`bounds_of`, used as literals, or a
    frame from :func:`minmax_fit` with one set of bounds per series.
    """
    return _with_bounds(df, columns, bounds, by, scaled)


def minmax_inverse(df: DataFrame, columns: Sequence[str], bounds, by: Sequence[str] = ()) -> DataFrame:
    """Undo :func:`minmax_scale`."""
    return _with_bounds(df, columns, bounds, by, unscaled)
