"""Cleaning and gap repair of time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numeric import to_number, zero_if_missing
from tidegauge.functions.times import DAY_SECONDS, epoch_seconds, from_epoch_seconds
from tidegauge.operators.position import BLOCK_ROWS, with_nearest


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn columns into DOUBLE; cells that are not finite numbers become NULL."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce columns and put 0 in place of every missing cell."""
    return df.withColumns({c: zero_if_missing(F.col(c)) for c in columns})


def repair_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Standard repair before training: :func:`zero_fill` on all columns but ``keep``."""
    return zero_fill(df, [c for c in df.columns if c not in keep])


def interpolate_linear(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill missing cells on the straight line between the nearest present cells.

    Cells after the last present one repeat it; cells before the first stay NULL.
    """
    nearest = with_nearest(df, columns, by, position, block_rows)
    filled = {}
    for c in columns:
        prev, following = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        start, end = prev["value"].cast("double"), following["value"].cast("double")
        share = F.try_divide(
            (F.col(position) - prev["at"]).cast("double"), (following["at"] - prev["at"]).cast("double")
        )
        filled[c] = F.coalesce(F.col(c).cast("double"), start + (end - start) * share, start)
    return nearest.withColumns(filled).drop(
        *[f"_prev_{c}" for c in columns], *[f"_next_{c}" for c in columns]
    )


def _first_window(by: Sequence[str]):
    return Window.partitionBy(*by, "day").orderBy("window_start")


def estimate_window_spec(df: DataFrame, by: Sequence[str] = ("protocol",)) -> DataFrame:
    """Window length and slide per series and day, in seconds.

    The slide is the smallest gap between consecutive starts, the length that
    of the first window. A single row gives no slide.
    """
    by = list(by)
    start, end = epoch_seconds(F.col("window_start")), epoch_seconds(F.col("window_end"))
    timed = df.select(
        *by, F.col("window_start").cast("date").alias("day"), "window_start",
        start.alias("_start"), (end - start).alias("_length"),
    )
    gaps = timed.withColumn("_gap", F.col("_start") - F.lag("_start").over(_first_window(by)))
    return gaps.groupBy(*by, "day").agg(
        F.min_by("_length", "window_start").alias("window_seconds"),
        F.min("_gap").alias("slide_seconds"),
    )


def gap_fill(
    df: DataFrame,
    slide_seconds: int,
    by: Sequence[str] = ("protocol",),
) -> DataFrame:
    """Complete every (series, day) to a regular grid of window starts.

    The grid begins at midnight and steps by the day's own estimated slide
    (``slide_seconds`` serves days with a single row). It ends with the last
    observed start if that window reaches the end of the day, else with the
    window that ends at midnight. Rows added carry NULL features; ``window_end``
    is recomputed from the length of the day's first window. Starts off the
    grid are dropped. Expects one row per series and ``window_start``.

    Each row emits its own grid slot and the empty slots up to the next row, so
    one shuffle by (series, day) does all the work and nothing is joined.
    """
    by = list(by)
    features = [c for c in df.columns if c not in {*by, "window_start", "window_end", "day"}]
    in_day = _first_window(by)
    whole_day = Window.partitionBy(*by, "day")
    start, end = epoch_seconds(F.col("window_start")), epoch_seconds(F.col("window_end"))
    timed = df.withColumns(
        {"day": F.col("window_start").cast("date"), "_start": start, "_end": end}
    ).withColumns(
        {
            "_gap": F.col("_start") - F.lag("_start").over(in_day),
            "_following": F.lead("_start").over(in_day),
            "_nth": F.row_number().over(in_day),
            "_length": F.first(F.col("_end") - F.col("_start")).over(in_day),
        }
    )
    timed = timed.withColumns(
        {
            "_slide": F.coalesce(F.min("_gap").over(whole_day), F.lit(slide_seconds).cast("bigint")),
            "_midnight": (F.unix_date("day").cast("bigint") * DAY_SECONDS),
        }
    )
    midnight, slide, length = F.col("_midnight"), F.col("_slide"), F.col("_length")
    last_slot = F.when(F.col("_end") < midnight + DAY_SECONDS, midnight + DAY_SECONDS - length).otherwise(
        F.col("_start")
    )

    def steps_up(seconds):
        return F.floor((seconds - midnight + slide - 1) / slide).cast("bigint")

    first_step = F.when(F.col("_nth") == 1, F.lit(0)).otherwise(steps_up(F.col("_start"))).cast("bigint")
    last_step = F.when(
        F.col("_following").isNotNull(), steps_up(F.col("_following")) - 1
    ).otherwise(F.floor((last_slot - midnight) / slide).cast("bigint"))
    grid = (
        timed.withColumns({"_first_step": first_step, "_last_step": last_step})
        .where("_first_step <= _last_step")
        .withColumn("_step", F.explode(F.sequence("_first_step", "_last_step")))
        .withColumn("_slot", F.col("_step") * slide + midnight)
    )
    on_row = F.col("_slot") == F.col("_start")
    return grid.select(
        *by,
        "day",
        from_epoch_seconds(F.col("_slot")).alias("window_start"),
        from_epoch_seconds(F.col("_slot") + length).alias("window_end"),
        *[F.when(on_row, F.col(c)).alias(c) for c in features],
    )
