"""Positional operators on series: differences, sequences, targets, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.times import epoch_seconds, from_epoch_seconds
from tidegauge.operators.position import BLOCK_ROWS, after, before, with_neighbours


def sorted_series(df: DataFrame, by: Sequence[str] = ("protocol",), order: str = "window_start") -> DataFrame:
    """Rows in ascending time order, for use right before a sink."""
    return df.orderBy(*by, order)


def positional_slice(df: DataFrame, head: int, tail: int, position: str = "t", total: str = "n_rows") -> DataFrame:
    """Drop the first ``head`` and last ``tail`` rows of every series.

    Needs the position and length columns of
    :func:`~tidegauge.operators.position.with_position`.
    """
    return df.where((F.col(position) >= head) & (F.col(position) < F.col(total) - tail))


def _spans_gap(steps: int, slide_seconds: int):
    """True where the row ``steps`` back is further away than ``steps`` slides."""
    return lambda spec: (
        epoch_seconds(F.col("window_start")) - epoch_seconds(F.lag("window_start", steps).over(spec))
    ) > steps * slide_seconds


def first_difference(
    df: DataFrame,
    columns: Sequence[str],
    steps: int = 1,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    gap_slide_seconds: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``x[t] - x[t-steps]`` in place of each column; the first rows are dropped.

    With ``gap_slide_seconds`` a difference across a missing window is NULL.
    """
    made = {f"_was_{c}": before(c, steps) for c in columns}
    if gap_slide_seconds:
        made["_gap"] = _spans_gap(steps, gap_slide_seconds)
    seen = with_neighbours(df, made, back=steps, by=by, position=position, block_rows=block_rows)
    change = {c: F.col(c) - F.col(f"_was_{c}") for c in columns}
    if gap_slide_seconds:
        change = {c: F.when(~F.col("_gap"), change[c]) for c in columns}
    return seen.where(F.col(position) >= steps).withColumns(change).drop(*made)


def inverse_difference(
    df: DataFrame,
    changes: dict[str, str],
    steps: int = 1,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Turn predicted changes back into values: ``x[t-steps] + change[t]``.

    ``changes`` maps a value column to the column with its predicted change; the
    change column is replaced by the restored value.
    """
    made = {f"_was_{c}": before(c, steps) for c in changes}
    seen = with_neighbours(df, made, back=steps, by=by, position=position, block_rows=block_rows)
    return seen.withColumns({d: F.col(f"_was_{c}") + F.col(d) for c, d in changes.items()}).drop(*made)


def lag_name(column: str, steps: int) -> str:
    return f"{column}_lag{steps}"


def sequence_windows(
    df: DataFrame,
    columns: Sequence[str],
    length: int,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the previous ``length`` rows of every column as ``<c>_lag1..<c>_lagL``.

    Only positions with a full history are kept.
    """
    made = {lag_name(c, i): before(c, i) for c in columns for i in range(1, length + 1)}
    seen = with_neighbours(df, made, back=length, by=by, position=position, block_rows=block_rows)
    return seen.where(F.col(position) >= length)


def horizon_target(
    df: DataFrame,
    columns: Sequence[str],
    steps_ahead: int,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``<c>_target``: the value ``steps_ahead`` rows after the last known row.

    The row at ``t`` is the first one after the known history, so the target is
    ``steps_ahead - 1`` rows further. Rows without a target are dropped.
    """
    made = {f"{c}_target": after(c, steps_ahead - 1) for c in columns}
    made["_there"] = after(position, steps_ahead - 1)
    seen = with_neighbours(
        df, made, back=0, ahead=steps_ahead - 1, by=by, position=position, block_rows=block_rows
    )
    return seen.where(F.col("_there").isNotNull()).drop("_there")


def future_rows(
    df: DataFrame,
    steps: int,
    slide_seconds: int,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
) -> DataFrame:
    """Append ``steps`` rows with NULL features after the end of every series."""
    by = list(by)
    last = df.groupBy(*by).agg(
        F.max(position).alias("_last"),
        F.max_by("window_start", position).alias("_start"),
        F.max_by("window_end", position).alias("_end"),
    )
    ahead = F.col("_step") * slide_seconds
    made = last.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *by,
        (F.col("_last") + F.col("_step")).alias(position),
        from_epoch_seconds(epoch_seconds(F.col("_start")) + ahead).alias("window_start"),
        from_epoch_seconds(epoch_seconds(F.col("_end")) + ahead).alias("window_end"),
    )
    return df.unionByName(made, allowMissingColumns=True)
