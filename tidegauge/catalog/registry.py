"""Query registry, shared input frames and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.times import parse_window_tag
from tidegauge.operators.position import with_position
from tidegauge.operators.repair import gap_fill, zero_fill
from tidegauge.operators.windows import window_features
from tidegauge.session import materialise, path_version, scratch_generation, scratch_path
from tidegauge.sources.datapool import datapool_scan, read_datapool, write_datapool

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOURLY = "w01h-s10m"
MINUTELY = "w10m-s01m"
TUMBLING = "w10m-s10m"
FEATURES = ["n", "d", "v"]

_made: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    """Result of ``make()``, built once per session and version of the events."""
    version = path_version(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    key = (spark.sparkContext.applicationId, scratch_generation(spark), version, what)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` with its oracle."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with their type standing in for the protocol."""
    return table(spark, sf_dir, "events").withColumnRenamed("event_type", "protocol")


def windows(spark: SparkSession, sf_dir: str, ws: str, by=("protocol",)) -> DataFrame:
    """Count, distinct users and sum of values per window."""
    return window_features(
        events(spark, sf_dir), ws, by=by, distinct={"d": "user_id"}, sums={"v": "value"}
    )


def _stored_pool(spark: SparkSession, sf_dir: str, ws: str) -> tuple[str, DataFrame]:
    def make():
        path = scratch_path(spark, "datapool")
        write_datapool(windows(spark, sf_dir, ws), path, ws)
        return path, read_datapool(spark, path)

    return once(spark, sf_dir, f"pool {ws}", make)


def pool_path(spark: SparkSession, sf_dir: str, ws: str) -> str:
    """Folder of the datapool, which is written once and read by many queries."""
    return _stored_pool(spark, sf_dir, ws)[0]


def pool(spark: SparkSession, sf_dir: str, ws: str = HOURLY) -> DataFrame:
    return _stored_pool(spark, sf_dir, ws)[1]


def series(spark: SparkSession, sf_dir: str, ws: str = HOURLY) -> DataFrame:
    """All protocols' windows with position ``t`` and length ``n_rows``, gaps left out."""
    rows = datapool_scan(pool(spark, sf_dir, ws), None, ws, FEATURES).drop("day")
    return with_position(rows, total="n_rows")


def filled(spark: SparkSession, sf_dir: str, ws: str = HOURLY) -> DataFrame:
    """All protocols on a complete grid, features of added windows NULL."""
    rows = datapool_scan(pool(spark, sf_dir, ws), None, ws, FEATURES).drop("day")
    return gap_fill(rows, parse_window_tag(ws)[1])


def complete(spark: SparkSession, sf_dir: str, ws: str) -> DataFrame:
    """Event counts of all protocols on a complete grid with zeros and positions,
    stored because the operators on top read it several times."""
    rows = zero_fill(filled(spark, sf_dir, ws).drop("d", "v"), ["n"])
    return materialise(with_position(rows), "complete")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in tumbling windows: mostly 0 or 1 at small scale."""
    return complete(spark, sf_dir, TUMBLING)


def r(name: str, digits: int = 6):
    """Rounded column under its own name, with -0.0 as 0.0."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


# ---- SQL fragments: common table expressions, joined by commas ----


def sql_windows(ws: str, name: str = "win", protocol: str = "event_type AS protocol,", group: str = "protocol, ") -> str:
    length, slide = parse_window_tag(ws)
    return f"""{name} AS (
  SELECT {group}s AS window_start, s + to_seconds({length}) AS window_end,
         count(*) AS n, count(DISTINCT user_id) AS d, sum(value) AS v
  FROM (SELECT {protocol} user_id, value,
               time_bucket(to_seconds({slide}), ts) - to_seconds({slide} * i) AS s
        FROM events, range({length // slide}) AS k(i))
  GROUP BY {group}s)"""


def sql_series(source: str = "win", name: str = "ser", by: str = "PARTITION BY protocol") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER ({by} ORDER BY window_start) - 1 AS t, count(*) OVER ({by}) AS n_rows
  FROM {source})"""


def sql_filled(source: str = "win", name: str = "filled", slide: int = 600, group: str = "protocol, ") -> str:
    on = "w.protocol = g.protocol AND " if group else ""
    shown = "g.protocol, " if group else ""
    return f"""{name}_gaps AS (
  SELECT *, CAST(window_start AS DATE) AS day, epoch_ms(window_start) // 1000 AS s, epoch_ms(window_end) // 1000 AS e,
         s - lag(s) OVER (PARTITION BY {group}CAST(window_start AS DATE) ORDER BY window_start) AS gap
  FROM {source}),
{name}_spec AS (
  SELECT {group}day, epoch_ms(CAST(day AS TIMESTAMP)) // 1000 AS midnight, arg_min(e - s, s) AS len,
         coalesce(min(gap), {slide}) AS slide, arg_max(e, s) AS last_e, max(s) AS last_s
  FROM {name}_gaps GROUP BY {group}day),
{name}_grid AS (
  SELECT {group}day, len, unnest(generate_series(midnight,
         CASE WHEN last_e < midnight + 86400 THEN midnight + 86400 - len ELSE last_s END, slide)) AS s
  FROM {name}_spec),
{name} AS (
  SELECT {shown}g.day, make_timestamp(g.s * 1000000) AS window_start,
         make_timestamp((g.s + g.len) * 1000000) AS window_end, w.n, w.d, w.v
  FROM {name}_grid g LEFT JOIN {source} w ON {on}w.window_start = make_timestamp(g.s * 1000000))"""


def sql_with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
