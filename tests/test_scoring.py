import math

import pytest

from helpers import rows_of
from tidegauge.operators.scoring import error_metrics, residual_anomalies, score_forecast

EVERY = ["rmse", "cosine", "r2", "mape", "smape", "mse", "mae"]


def score(spark, actual, forecast, **options):
    df = spark.createDataFrame(list(zip(actual, forecast)), "a double, f double")
    return {r["metric"]: r["value"] for r in error_metrics(df, {"x": ("a", "f")}, EVERY, **options).collect()}


def test_hand_computed(spark):
    got = score(spark, [1.0, 2.0, 4.0], [1.0, 3.0, 2.0])
    assert got["mse"] == pytest.approx(5 / 3) and got["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert got["mae"] == pytest.approx(1.0)
    assert got["cosine"] == pytest.approx(15 / (math.sqrt(21) * math.sqrt(14)))
    assert got["r2"] == pytest.approx(1 - 5 / (14 / 3))
    assert got["mape"] == pytest.approx(100 * (0 + 1 / 2 + 2 / 4) / 3)
    assert got["smape"] == pytest.approx(100 / 3 * (0 + 2 / 5 + 4 / 6))


def test_smape_examples(spark):
    assert score(spark, [1.0, 1.0], [1.0, 2.0])["smape"] == pytest.approx(100 / 3)
    assert score(spark, [0.0, 1.0], [0.0, 1.0])["smape"] is None
    assert score(spark, [0.0, 1.0], [0.0, 1.0], skip_undefined=True)["smape"] == 0
    assert score(spark, [0.0, 1.0], [2.0, 1.0])["smape"] == pytest.approx(100)


def test_undefined_values(spark):
    got = score(spark, [0.0, 1.0], [1.0, 1.0])
    assert got["mape"] is None
    zero = score(spark, [0.0, 0.0], [1.0, 1.0])
    assert zero["cosine"] is None and zero["r2"] == 0
    assert score(spark, [3.0, 3.0], [3.0, 3.0])["r2"] == 1


def test_incomplete_pairs_are_left_out(spark):
    got = score(spark, [1.0, None, 3.0, 9.0], [1.0, 5.0, 2.0, None])
    assert got["mse"] == pytest.approx(0.5) and got["smape"] == pytest.approx(20.0)
    assert score(spark, [1.0, None], [1.0, 2.0]) == {}


def test_scores_align_on_position(spark):
    actual = spark.createDataFrame([("s", t, float(t)) for t in range(5)], "protocol string, t long, x double")
    forecast = spark.createDataFrame([("s", t, float(t)) for t in range(2, 8)], "protocol string, t long, x double")
    got = score_forecast(actual, forecast, ["x"], ["protocol", "t"])
    assert {r["metric"]: r["value"] for r in got.collect()} == {"smape": 0.0, "r2": 1.0, "rmse": 0.0, "cosine": pytest.approx(1.0)}


def test_anomalies(spark):
    training = spark.createDataFrame([("s", 1.0, 0.0), ("s", -1.0, 0.0), ("s", 1.0, 0.0)], "protocol string, a double, f double")
    pairs = spark.createDataFrame([("s", 5.0, 0.0), ("s", 2.0, 0.0)], "protocol string, a double, f double")
    got = residual_anomalies(pairs, "a", "f", training, factor=2.0)
    assert rows_of(got, "residual", "is_anomaly") == [(2.0, False), (5.0, True)]
    assert got.head()["threshold"] == pytest.approx(2 * math.sqrt(4 / 3))
