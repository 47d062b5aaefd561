import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from tidegauge.operators.joins import attach, hot_keys


@pytest.fixture(scope="module")
def rows(spark):
    """10 000 rows, nine tenths of one key, and keys without a summary."""
    key = F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 50)
    return spark.range(10_000).select(key.alias("k"), F.concat(F.lit("s"), key).alias("s"), F.col("id").alias("x"))


@pytest.fixture(scope="module")
def summary(rows):
    return rows.where("k <> 9").groupBy("k", "s").agg(F.max("x").alias("top"))


@pytest.mark.parametrize("limits", [{"broadcast_rows": 1}, {"broadcast_bytes": 10}, {"broadcast_rows": 1, "salts": 1}, {}])
def test_join_is_the_same_however_it_is_planned(rows, summary, limits):
    got = attach(rows, summary, ["k", "s"], **limits)
    assert got.columns == ["k", "s", "x", "top"]
    assert rows_of(got) == rows_of(rows.join(summary, ["k", "s"], "left"))


def test_wide_summary_is_not_broadcast(spark, rows):
    wide = spark.range(3).select(F.col("id").alias("k"), F.array_repeat(F.lit(0.5), 5_000).alias("cells"))

    def plan(limit):
        return attach(rows, wide, ["k"], broadcast_bytes=limit)._jdf.queryExecution().optimizedPlan().toString()

    assert "Explode" in plan(10_000).title() and "Explode" not in plan(1_000_000).title()


def test_hot_key_is_spread_in_proportion(rows):
    assert rows_of(hot_keys(rows, ["k", "s"], 40), "_salts") == [(36,)]
    placed = rows.select("k", F.pmod(F.xxhash64(*rows.columns), F.lit(36)).alias("salt")).where("k = 0").groupBy("salt").count()
    most, least = placed.agg(F.max("count"), F.min("count")).first()
    assert placed.count() == 36 and most < 2 * least


def test_empty_rows(spark, rows, summary):
    assert attach(rows.limit(0), summary, ["k", "s"], broadcast_rows=1).count() == 0
    assert rows_of(attach(rows, summary.limit(0), ["k", "s"], broadcast_rows=-1), "top") == [(None,)] * 10_000
