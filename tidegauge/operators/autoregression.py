"""First-order autoregression per series: the closed-form forecaster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.joins import attach
from tidegauge.operators.position import BLOCK_ROWS, before, with_neighbours


def with_previous(
    df: DataFrame,
    column: str,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``<column>_was``, the value one position earlier, and drop first rows."""
    made = {f"{column}_was": before(column)}
    seen = with_neighbours(df, made, back=1, by=by, position=position, block_rows=block_rows)
    return seen.where(F.col(position) >= 1)


def ar1_fit(pairs: DataFrame, column: str, by: Sequence[str] = ("protocol",)) -> DataFrame:
    """Least-squares ``x[t] = intercept + slope * x[t-1]`` for every series at once.

    ``pairs`` comes from :func:`with_previous`.
    """
    return pairs.groupBy(*by).agg(
        F.regr_slope(column, f"{column}_was").alias("slope"),
        F.regr_intercept(column, f"{column}_was").alias("intercept"),
    )


def ar1_forecast(pairs: DataFrame, model: DataFrame, column: str, by: Sequence[str] = ("protocol",)) -> DataFrame:
    """Add ``forecast``, the one-step prediction for each row's own position."""
    fitted = attach(pairs, model, by)
    return fitted.withColumn("forecast", F.col("intercept") + F.col("slope") * F.col(f"{column}_was")).drop(
        "slope", "intercept"
    )
