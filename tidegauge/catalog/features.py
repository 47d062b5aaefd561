"""Queries for windowed feature extraction, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import (
    HOURLY, MINUTELY, TUMBLING, query, sql_windows, sql_with, table, windows,
)
from tidegauge.session import scratch_path
from tidegauge.streaming.windows import run_to_table, stream_window_features

SHOW = "SELECT protocol, window_start, window_end, n, d, round(v, 6) AS v FROM win"


def _features(spark, sf_dir, ws):
    return windows(spark, sf_dir, ws).withColumn("v", F.round("v", 6))


@query("window_features", sql_with(sql_windows(HOURLY)) + SHOW)
def hourly(spark, sf_dir):
    return _features(spark, sf_dir, HOURLY)


@query("window_features_tumbling", sql_with(sql_windows(TUMBLING)) + SHOW)
def tumbling(spark, sf_dir):
    return _features(spark, sf_dir, TUMBLING)


@query("window_features_minute_slide", sql_with(sql_windows(MINUTELY)) + SHOW)
def minute_slide(spark, sf_dir):
    return _features(spark, sf_dir, MINUTELY)


@query(
    "stream_window_features",
    sql_with(sql_windows(HOURLY))
    + SHOW
    + " WHERE window_end <= (SELECT date_trunc('second', max(ts)) - INTERVAL 10 MINUTE FROM events)",
)
def streamed(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    folder = sf_dir.rstrip("/")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    features = stream_window_features(
        stream.withColumnRenamed("event_type", "protocol"), HOURLY, distinct={"d": "user_id"}, sums={"v": "value"}
    )
    path = scratch_path(spark, "stream")
    return run_to_table(features, f"{path}/table", f"{path}/checkpoint").withColumn("v", F.round("v", 6))
