import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, ts, values
from tidegauge.operators.repair import coerce_numeric, estimate_window_spec, gap_fill, interpolate_linear, repair_numeric, zero_fill

SCHEMA = "protocol string, window_start timestamp_ntz, window_end timestamp_ntz, n long"


def windows(spark, starts, length=60, protocol="conn"):
    rows = [(protocol, ts(s), ts(s) + dt.timedelta(minutes=length), k + 1) for k, s in enumerate(starts)]
    return spark.createDataFrame(rows, SCHEMA)


def slots(df):
    return [r["window_start"].strftime("%d %H:%M") for r in df.orderBy("window_start").collect()]


def test_bad_cells(spark):
    cells = ["1.5", "", " ", "None", "NaN", "inf", "-inf", "abc", None, " 7 ", "1e3"]
    df = spark.createDataFrame(list(enumerate(cells)), "t int, c string")
    assert values(coerce_numeric(df, ["c"]), "t", "c") == [1.5] + [None] * 8 + [7.0, 1000.0]
    assert values(zero_fill(df, ["c"]), "t", "c") == [1.5] + [0.0] * 8 + [7.0, 1000.0]
    assert values(repair_numeric(df, keep=["t"]), "t", "c") == [1.5] + [0.0] * 8 + [7.0, 1000.0]
    numbers = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, float("inf")), (3, None)], "t int, c double")
    assert values(zero_fill(numbers, ["c"]), "t", "c") == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("size", [2, 100_000])
def test_interpolation(spark, size):
    cells = [None, 1.0, None, 3.0, None, None, 9.0, None, None]
    df = spark.createDataFrame([("s", k, c) for k, c in enumerate(cells)], "protocol string, t long, c double")
    got = values(interpolate_linear(df, ["c"], block_rows=size), "t", "c")
    assert got == [None, 1.0, 2.0, 3.0, 5.0, 7.0, 9.0, 9.0, 9.0]


def test_window_spec(spark):
    df = windows(spark, ["2019-06-01 00:20", "2019-06-01 00:40", "2019-06-01 01:40", "2019-06-02 05:00"])
    assert rows_of(estimate_window_spec(df), "day", "window_seconds", "slide_seconds") == [
        (dt.date(2019, 6, 1), 3600, 1200), (dt.date(2019, 6, 2), 3600, None),
    ]


def test_complete_day_is_kept(spark):
    starts = [f"2019-06-01 {m // 60:02d}:{m % 60:02d}" for m in range(0, 1440, 10)]
    got = gap_fill(windows(spark, starts), 600)
    assert got.count() == 144 and got.where("n IS NULL").count() == 0


def test_gaps_at_every_place(spark):
    # Missing first, middle and last windows; day 2 is not touched by day 1.
    day1 = [f"2019-06-01 {m // 60:02d}:{m % 60:02d}" for m in range(30, 1200, 10) if m not in (50, 60, 600)]
    got = gap_fill(windows(spark, day1 + ["2019-06-03 00:00", "2019-06-03 00:10"]), 600)
    first = got.where("day = DATE'2019-06-01'")
    # The grid ends with the window that ends at midnight: 23:00 for one hour.
    assert slots(first) == [f"01 {m // 60:02d}:{m % 60:02d}" for m in range(0, 1381, 10)]
    assert first.where("n IS NOT NULL").count() == len(day1)
    assert first.where("window_end - window_start <> INTERVAL '1' HOUR").count() == 0
    assert got.where("day = DATE'2019-06-02'").count() == 0
    assert got.where("day = DATE'2019-06-03'").count() == 139


def test_last_window_beyond_midnight_sets_the_end(spark):
    got = gap_fill(windows(spark, ["2019-06-01 00:00", "2019-06-01 00:10", "2019-06-01 23:20"]), 600)
    assert slots(got)[-1] == "01 23:20"


def test_off_grid_start_is_dropped(spark):
    got = gap_fill(windows(spark, ["2019-06-01 00:00", "2019-06-01 00:10", "2019-06-01 00:25", "2019-06-01 00:40"]), 600)
    assert got.where("window_start = TIMESTAMP_NTZ'2019-06-01 00:25:00'").count() == 0
    assert slots(got)[:5] == ["01 00:00", "01 00:10", "01 00:20", "01 00:30", "01 00:40"]
    assert got.where("n IS NOT NULL").count() == 3


def test_single_row_uses_the_given_slide(spark):
    got = gap_fill(windows(spark, ["2019-06-01 12:00"]), 600)
    assert got.count() == 139 and got.where("n IS NOT NULL").count() == 1


def test_gap_fill_shuffles_once(spark):
    from helpers import plan_of

    df = spark.range(10).select(
        F.lit("a").alias("protocol"),
        F.expr("TIMESTAMP_NTZ'2019-06-01 00:00:00' + make_dt_interval(0, 0, cast(id AS int) * 10)").alias("window_start"),
        F.expr("TIMESTAMP_NTZ'2019-06-01 01:00:00' + make_dt_interval(0, 0, cast(id AS int) * 10)").alias("window_end"),
        F.col("id").alias("n"),
    )
    plan = plan_of(gap_fill(df, 600))
    assert plan.count("Exchange") == 1 and "Join" not in plan
