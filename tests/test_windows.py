import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import plan_of, rows_of
from tidegauge.functions.times import epoch_seconds, from_epoch_seconds, parse_window_tag
from tidegauge.operators.windows import window_features


@pytest.fixture(scope="module")
def raw(spark):
    """One protocol and one user hold most of the rows; some users are unknown."""
    rng = random.Random(1)
    base = dt.datetime(2024, 3, 30, 22)
    rows = [
        (
            "hot" if rng.random() < 0.7 else rng.choice("xy"),
            base + dt.timedelta(seconds=rng.randint(0, 3 * 86400), microseconds=rng.randint(0, 999999)),
            None if rng.random() < 0.05 else (1 if rng.random() < 0.6 else rng.randint(2, 40)),
            float(rng.randint(0, 500)),
        )
        for _ in range(2500)
    ]
    rows.append(("x", None, 1, 5.0))
    return spark.createDataFrame(rows, "protocol string, ts timestamp_ntz, user_id long, value double").cache()


@pytest.mark.parametrize("tag", ["w01h-s10m", "w10m-s01m", "w10m-s10m", "w25m-s10m", "w10m-s30m"])
def test_equals_expanding_every_event(raw, tag):
    length, slide = parse_window_tag(tag)
    got = window_features(raw, tag, distinct={"d": "user_id"}, sums={"v": "value"})
    if slide <= length:
        window = F.window("ts", f"{length} seconds", f"{slide} seconds")
        naive = raw.groupBy("protocol", window).agg(
            F.count("*").alias("n"), F.countDistinct("user_id").alias("d"), F.sum("value").alias("v")
        ).select("protocol", "window.start", "window.end", "n", "d", "v")
        assert rows_of(got) == rows_of(naive)
    else:
        start = epoch_seconds(F.col("ts")) - F.pmod(epoch_seconds(F.col("ts")), F.lit(slide))
        inside = raw.where(epoch_seconds(F.col("ts")) - start < length)
        naive = inside.groupBy("protocol", from_epoch_seconds(start).alias("s")).agg(
            F.count("*").alias("n"), F.countDistinct("user_id").alias("d"), F.sum("value").alias("v")
        )
        assert rows_of(got.drop("window_end")) == rows_of(naive)


def test_several_distinct_counts(raw):
    got = window_features(raw, "w01h-s10m", distinct={"users": "user_id", "amounts": "value"}, sums={"v": "value"})
    naive = raw.groupBy("protocol", F.window("ts", "1 hour", "10 minutes")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"),
        F.countDistinct("value").alias("amounts"), F.sum("value").alias("v"),
    ).select("protocol", "window.start", "window.end", "n", "users", "amounts", "v")
    assert rows_of(got) == rows_of(naive)


@pytest.mark.parametrize("tag", ["w02h-s10m", "w12h-s01m", "w03d-s01h"])
def test_long_windows_reach_over_several_chunks(raw, tag):
    """Windows of more panes than a chunk has, and of chunks with a single sighting."""
    length, slide = parse_window_tag(tag)
    some = raw.where(F.pmod(F.hash("ts", "user_id"), F.lit(6)) == 0)
    got = window_features(some, tag, distinct={"d": "user_id"}, sums={"v": "value"})
    naive = some.groupBy("protocol", F.window("ts", f"{length} seconds", f"{slide} seconds")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("d"), F.sum("value").alias("v")
    ).select("protocol", "window.start", "window.end", "n", "d", "v")
    assert rows_of(got) == rows_of(naive)


def test_times_before_1970(spark):
    base = dt.datetime(1969, 12, 31, 20)
    rows = spark.createDataFrame([("p", base + dt.timedelta(minutes=7 * k), k % 3) for k in range(70)], "protocol string, ts timestamp_ntz, user_id long")
    got = window_features(rows, "w01h-s10m", distinct={"d": "user_id"})
    naive = rows.groupBy("protocol", F.window("ts", "1 hour", "10 minutes")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("d"))
    assert rows_of(got) == rows_of(naive.select("protocol", "window.start", "window.end", "n", "d"))


def test_one_shuffle_by_entity(raw):
    """Entities are shuffled once per distinct count, by chunk and after combining, and events are never exploded by count."""
    got = window_features(raw, "w01h-s10m", distinct={"users": "user_id", "amounts": "value"}, sums={"v": "value"})
    lines = plan_of(got).split("== Initial Plan ==")[-1].splitlines()
    exchanges = [line for line in lines if "Exchange hashpartitioning" in line]
    assert sum("_entity" in line for line in exchanges) == 2 and all("_chunk" in line for line in exchanges if "_entity" in line)
    assert not any("posexplode(array" in line for line in lines)


def test_counts_only(raw):
    got = window_features(raw, "w01h-s10m")
    assert got.columns == ["protocol", "window_start", "window_end", "n"]
    assert got.agg(F.sum("n")).head()[0] == 2500 * 6


def test_seconds_do_not_depend_on_the_session_zone(spark, raw):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        utc = rows_of(window_features(raw, "w01h-s10m", sums={"v": "value"}))
        spark.conf.set("spark.sql.session.timeZone", "Europe/Bratislava")
        assert rows_of(window_features(raw, "w01h-s10m", sums={"v": "value"})) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_window_tags():
    assert parse_window_tag("w01h-s10m") == (3600, 600)
    assert parse_window_tag("w10m-s01m") == (600, 60)
    with pytest.raises(ValueError):
        parse_window_tag("hourly")
