import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows_of, values
from tidegauge.operators.position import with_position
from tidegauge.operators.scaling import bounds_of, minmax_fit, minmax_inverse, minmax_scale
from tidegauge.operators.series import (
    first_difference, future_rows, horizon_target, inverse_difference, positional_slice, sequence_windows, sorted_series,
)


def series(spark, cells, protocol="s"):
    base = dt.datetime(2024, 1, 1)
    rows = [
        (protocol, t, base + dt.timedelta(minutes=10 * t), base + dt.timedelta(minutes=10 * t + 60), float(x))
        for t, x in enumerate(cells)
    ]
    return spark.createDataFrame(
        rows, "protocol string, t long, window_start timestamp_ntz, window_end timestamp_ntz, x double"
    )


@pytest.mark.parametrize("size", [1, 2, 100_000])
def test_difference_and_back(spark, size):
    df = series(spark, [5, 2, 9, 1])
    changed = first_difference(df, ["x"], block_rows=size)
    assert values(changed, "t", "x") == [-3, 7, -8]
    two = first_difference(df, ["x"], steps=2, block_rows=size)
    assert values(two, "t", "x") == [4, -1]
    forecast = df.join(two.select("t", F.col("x").alias("change")), "t", "left")
    back = inverse_difference(forecast, {"x": "change"}, steps=2, block_rows=size)
    assert values(back, "t", "change") == [None, None, 9, 1]


def test_difference_across_a_gap(spark):
    df = series(spark, [5, 2, 9, 1]).where("t <> 1")
    placed = with_position(df.drop("t"))
    assert values(first_difference(placed, ["x"]), "t", "x") == [4, -8]
    assert values(first_difference(placed, ["x"], gap_slide_seconds=600), "t", "x") == [None, -8]


@pytest.mark.parametrize("size", [3, 100_000])
def test_sequences_and_targets(spark, size):
    df = series(spark, range(8))
    lags = sequence_windows(df, ["x"], 3, block_rows=size)
    assert rows_of(lags, "t", "x_lag1", "x_lag2", "x_lag3") == [(t, t - 1, t - 2, t - 3) for t in range(3, 8)]
    assert values(horizon_target(df, ["x"], 1, block_rows=size), "t", "x_target") == list(range(8))
    assert values(horizon_target(df, ["x"], 3, block_rows=size), "t", "x_target") == list(range(2, 8))


def test_slice_and_future_rows(spark):
    df = series(spark, range(6)).union(series(spark, range(3), "r"))
    placed = with_position(df.drop("t"), total="n_rows")
    assert rows_of(positional_slice(placed, 2, 1), "protocol", "t") == [("s", t) for t in (2, 3, 4)]
    ahead = future_rows(df, 2, 600)
    assert ahead.count() == 13
    made = ahead.where("protocol = 's' AND x IS NULL").orderBy("t").collect()
    assert [r["t"] for r in made] == [6, 7]
    assert made[1]["window_start"] == dt.datetime(2024, 1, 1, 1, 10)
    assert made[1]["window_end"] == dt.datetime(2024, 1, 1, 2, 10)


def test_sorted(walk):
    starts = [(r["protocol"], r["window_start"]) for r in sorted_series(walk).collect()]
    assert starts == sorted(starts)


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    bounds = bounds_of(minmax_fit(df, ["x", "c"]))
    assert bounds == {"x": (1.0, 3.0), "c": (5.0, 5.0)}
    scaled = minmax_scale(df, ["x", "c"], bounds)
    assert rows_of(scaled) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert rows_of(minmax_inverse(scaled, ["x", "c"], bounds)) == rows_of(df)
    # Reapplied to other data without clipping.
    other = spark.createDataFrame([(5.0, 7.0)], "x double, c double")
    assert rows_of(minmax_scale(other, ["x", "c"], bounds)) == [(2.0, 2.0)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_minmax_per_series(spark, walk, limit, monkeypatch):
    from tidegauge.operators import joins, scaling

    monkeypatch.setattr(
        scaling, "attach", lambda rows, summary, by: joins.attach(rows, summary, by, broadcast_rows=limit, salts=3)
    )
    fitted = minmax_fit(walk, ["x"], by=["protocol"])
    got = minmax_scale(walk, ["x"], fitted, by=["protocol"])
    whole = Window.partitionBy("protocol")
    span = F.max("x").over(whole) - F.min("x").over(whole)
    naive = walk.withColumn("x", (F.col("x") - F.min("x").over(whole)) / span)
    assert rows_of(got, *walk.columns) == rows_of(naive, *walk.columns)
