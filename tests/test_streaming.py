import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import rows_of
from tidegauge.operators.windows import window_features
from tidegauge.streaming.windows import run_to_table, stream_window_features

SCHEMA = "protocol string, ts timestamp_ntz, user_id long, value double"
OPTIONS = {"distinct": {"d": "user_id"}, "sums": {"v": "value"}}


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_closed_windows_equal_the_batch_result(spark, tmp_path):
    rng = random.Random(8)
    base = dt.datetime(2024, 1, 1)
    rows = [
        (rng.choice("ab"), base + dt.timedelta(seconds=rng.randint(0, 40_000)), rng.choice([None, 1, 1, 2, 3]), float(k))
        for k in range(600)
    ]
    source = str(tmp_path / "in")
    write(spark, source, rows)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    got = run_to_table(stream_window_features(stream, "w01h-s10m", **OPTIONS), str(tmp_path / "out"), str(tmp_path / "state"))
    latest = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    closed = window_features(spark.createDataFrame(rows, SCHEMA), "w01h-s10m", **OPTIONS).where(F.col("window_end") <= F.lit(latest))
    assert rows_of(got) == rows_of(closed) and got.count() > 50


def test_late_events_are_dropped_and_state_survives_restarts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return run_to_table(stream_window_features(stream, "w10m-s10m", **OPTIONS), out, state)

    write(spark, source, [("a", base + dt.timedelta(minutes=m), 1, 1.0) for m in (1, 2, 60)])
    first = run()
    assert rows_of(first, "window_start", "n", "d", "v") == [(base, 2, 1, 2.0)]
    # Minute 3 is behind the watermark (50 minutes); minute 61 joins the open window.
    write(spark, source, [("a", base + dt.timedelta(minutes=m), 2, 1.0) for m in (3, 61, 200)])
    second = run()
    assert rows_of(second, "window_start", "n", "d", "v") == [
        (base, 2, 1, 2.0), (base + dt.timedelta(hours=1), 2, 2, 2.0),
    ]


def test_entities_are_remembered_over_batches_and_forgotten_in_time(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    # Entity 1 comes back within an hour and later, entity 2 after exactly one hour, one is unknown.
    parts = [[(0, 1), (3, 2), (15, 1), (16, None)], [(40, 1), (63, 2), (75, None), (119, 3)], [(131, 1), (160, 3), (500, 4)]]
    rows = []
    for part in parts:
        new = [("a", base + dt.timedelta(minutes=m), who, 1.0) for m, who in part]
        write(spark, source, new)
        rows += new
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = run_to_table(stream_window_features(stream, "w01h-s10m", **OPTIONS), out, state)
    closed = window_features(spark.createDataFrame(rows, SCHEMA), "w01h-s10m", **OPTIONS).where(
        F.col("window_end") <= F.lit(base + dt.timedelta(minutes=490))
    )
    assert rows_of(got) == rows_of(closed) and got.count() > 15


def test_two_distinct_counts_and_none(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("a", base + dt.timedelta(minutes=7 * k), k % 3, float(k % 2)) for k in range(40)]
    source = str(tmp_path / "in")
    write(spark, source, rows)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    latest = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    for name, distinct in (("two", {"d": "user_id", "e": "value"}), ("none", {})):
        got = run_to_table(
            stream_window_features(stream, "w01h-s20m", distinct=distinct), str(tmp_path / name), str(tmp_path / f"state_{name}")
        )
        closed = window_features(spark.createDataFrame(rows, SCHEMA), "w01h-s20m", distinct=distinct)
        assert rows_of(got) == rows_of(closed.where(F.col("window_end") <= F.lit(latest)))
