import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from tidegauge.operators.autoregression import ar1_fit, ar1_forecast, with_previous
from tidegauge.plans.forecaster import Settings, predict, samples, train
from tidegauge.plans.linear import block_moments, sample_moments
from tidegauge.plans.runs import predict_run, score, train_run
from tidegauge.plans.store import list_models, load_model, save_model
from tidegauge.sources.datapool import store_partitions

BY = ["series"]


def frame(spark, columns, start=dt.datetime(2024, 1, 1)):
    rows = [
        ("main", t, start + dt.timedelta(minutes=10 * t), *map(float, cells)) for t, cells in enumerate(zip(*columns.values()))
    ]
    names = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(rows, f"series string, t long, window_start timestamp_ntz, {names}")


@pytest.fixture(scope="module")
def waves(spark):
    rng = random.Random(2)
    x = [20 + 10 * math.sin(t / 7) + rng.random() for t in range(400)]
    y = [5 + 0.5 * v + rng.random() for v in x]
    return frame(spark, {"x": x, "y": y}).cache()


@pytest.mark.parametrize("delta, steps, size", [(True, 1, 5), (True, 3, 100_000), (False, 1, 100_000), (False, 2, 4)])
def test_samples_are_keyed_by_target(spark, delta, steps, size):
    cells = [float(t * t) for t in range(9)]
    settings = Settings(sequence_len=3, steps_ahead=steps, delta=delta)
    got = {r["t"]: r for r in samples(frame(spark, {"x": cells}), ["x"], settings, BY, 600, block_rows=size).collect()}
    first = 3 if delta else 2
    # n - L forecasts with differences, n - L + 1 without, the last ones beyond the data.
    assert sorted(got) == [o + steps for o in range(first, 9)]
    for origin in range(first, 9):
        row = got[origin + steps]
        assert row["window_start"] == dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * (origin + steps))
        inputs = [row[f"_in_x_{i}"] for i in range(3)]
        known = origin + steps < 9
        if delta:
            assert inputs == [cells[origin - i] - cells[origin - i - 1] for i in range(3)]
            assert row["_out_x"] == (cells[origin + steps] - cells[origin] if known else None)
        else:
            assert inputs == [cells[origin - i] for i in range(3)]
            assert row["_out_x"] == (cells[origin + steps] if known else None)
        assert row["base_x"] == cells[origin]
        assert row["actual_x"] == (cells[origin + steps] if known else None)


def test_one_lag_equals_closed_form(spark, waves):
    settings = Settings(sequence_len=1, delta=False, bounded=False, reg_param=0.0)
    model = train(waves.select("series", "t", "window_start", "x"), ["x"], settings, BY, 600)
    made = predict(model, waves, 600).where("actual_x IS NOT NULL")
    pairs = with_previous(waves, "x", by=BY)
    closed = ar1_forecast(pairs, ar1_fit(pairs, "x", by=BY), "x", by=BY).select("t", F.col("forecast").alias("closed"))
    gap = made.join(closed, "t").agg(F.count("*"), F.max(F.abs(F.col("forecast_x") - F.col("closed")))).head()
    assert gap[0] == 399 and gap[1] < 1e-6


@pytest.mark.parametrize("delta, steps", [(True, 1), (True, 3), (False, 2)])
def test_one_pass_solves_what_the_iterative_solver_does(waves, delta, steps):
    settings = Settings(sequence_len=4, steps_ahead=steps, delta=delta, reg_param=1e-3)
    direct = train(waves, ["x", "y"], settings, BY, 600)
    other = train(waves, ["x", "y"], replace(settings, options={"solver": "normal"}), BY, 600)
    for c in ("x", "y"):
        assert direct.input_bounds[c] == pytest.approx(other.input_bounds[c])
        assert direct.target_bounds[c] == pytest.approx(other.target_bounds[c])
    one = predict(direct, waves, 600)
    two = predict(other, waves, 600).select("t", F.col("forecast_x").alias("x2"), F.col("forecast_y").alias("y2"))
    gap = one.join(two, "t").agg(F.count("*"), F.max(F.abs(F.expr("forecast_x - x2"))), F.max(F.abs(F.expr("forecast_y - y2")))).head()
    assert gap[0] == 400 - 4 + (0 if delta else 1) and max(gap[1], gap[2]) < 1e-6


@pytest.mark.parametrize("delta", [True, False])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_moments_do_not_depend_on_blocks(spark, waves, delta, size):
    rows = np.array([[r["x"], r["y"]] for r in waves.orderBy("t").collect()])
    whole = block_moments(rows, np.ones(len(rows), bool), 3, 2, delta)
    found = sample_moments(waves, ["x", "y"], 3, 2, delta, BY, block_rows=size)
    assert found.count == whole.count == 400 - 2 - (3 if delta else 2)
    for part in ("mean", "comoment", "low", "high"):
        assert np.allclose(getattr(found, part), getattr(whole, part), rtol=1e-9, atol=1e-9)


def test_linear_trend_is_learned(spark):
    # A constant change: the scaled range is one point, the forecast continues the line.
    line = frame(spark, {"x": [3.0 * t for t in range(60)]})
    model = train(line, ["x"], Settings(sequence_len=4), BY, 600)
    made = predict(model, line, 600).orderBy("t").collect()
    assert [r["forecast_x"] for r in made] == pytest.approx([3.0 * t for t in range(5, 61)])
    assert made[-1]["actual_x"] is None and made[-1]["t"] == 60


@pytest.mark.parametrize("regressor", ["linear", "gbt", "random_forest", "fm"])
def test_regressors(waves, regressor):
    settings = Settings(
        sequence_len=4, steps_ahead=2, regressor=regressor, passes=4, validation_share=0.2 if regressor == "gbt" else 0.0
    )
    model = train(waves, ["x", "y"], settings, BY, 600)
    made = predict(model, waves, 600)
    assert made.count() == 396
    outside = made.where("scaled_forecast_x < 0 OR scaled_forecast_x > 1").count()
    assert outside == 0
    scores = {(r["feature"], r["metric"]): r["value"] for r in score(made, ["x", "y"]).collect()}
    assert set(m for _, m in scores) == {"smape", "r2", "rmse", "cosine", "scaled_mse", "scaled_mae"}
    if regressor != "fm":
        assert scores[("x", "r2")] > 0.5
    with pytest.raises(ValueError):
        train(waves, ["x"], Settings(regressor="other"), BY, 600)


def test_missing_cells(waves):
    holes = waves.withColumn("x", F.when(F.col("t") % 10 == 5, None).otherwise(F.col("x")))
    plain = train(holes, ["x"], Settings(sequence_len=2, delta=False), BY, 600)
    assert plain.input_bounds["x"][0] == 0.0
    filled = train(holes, ["x"], Settings(sequence_len=2, delta=False, interpolate=True), BY, 600)
    assert filled.input_bounds["x"][0] > 5.0


def test_too_short(spark):
    with pytest.raises(ValueError):
        train(frame(spark, {"x": [1, 2, 3]}), ["x"], Settings(sequence_len=12), BY, 600)


def test_store(spark, waves, tmp_path):
    settings = Settings(sequence_len=3, steps_ahead=2)
    model = train(waves, ["x", "y"], settings, BY, 600)
    save_model(spark, model, str(tmp_path), "m", "spec", "w01h-s10m", "<2024-01-01,2024-01-02)", metrics=[("x", "r2", None)])
    loaded, meta = load_model(spark, str(tmp_path), "m")
    assert loaded.settings == settings and loaded.columns == ["x", "y"] and loaded.by == BY
    assert (loaded.input_bounds, loaded.target_bounds) == (model.input_bounds, model.target_bounds)
    assert meta["train_range"] == "<2024-01-01,2024-01-02)" and meta["metrics"][0]["value"] is None
    assert rows_of(predict(loaded, waves, 600)) == rows_of(predict(model, waves, 600))
    save_model(spark, model, str(tmp_path), "n")
    assert rows_of(list_models(spark, str(tmp_path)), "name") == [("m",), ("n",)]


def test_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for day in range(1, 6):
        for slot in range(144):
            start = dt.datetime(2024, 1, day) + dt.timedelta(minutes=10 * slot)
            for protocol in ("conn", "dns"):
                rows.append((protocol, "w01h-s10m", start.date(), start, start + dt.timedelta(hours=1), 50 + slot + rng.randint(0, 5)))
    pool_rows = spark.createDataFrame(
        rows, "protocol string, ws string, day date, window_start timestamp_ntz, window_end timestamp_ntz, n long"
    )
    store_partitions(pool_rows, str(tmp_path / "pool"))
    pool = spark.read.parquet(str(tmp_path / "pool"))
    spec = "conn|n~conn_n;dns|n~dns_n#window_start,window_end"
    root = str(tmp_path / "models")
    model, report = train_run(
        spark, pool, spec, "w01h-s10m", "<2024-01-01,2024-01-05)", "<2024-01-05,2024-01-06)", root, "m",
        Settings(sequence_len=6), train_excluded=["<2024-01-02,2024-01-03)"],
    )
    assert model.columns == ["conn_n", "dns_n"] and report.count() == 12
    assert report.where("training_seconds > 0").count() == 12
    forecasts, metrics = predict_run(spark, pool, root, "m", "<2024-01-05,2024-01-06)")
    assert forecasts.count() == 138 and forecasts.where("actual_conn_n IS NULL").count() == 1
    assert rows_of(metrics) == rows_of(report, "feature", "metric", "value")
    listed = list_models(spark, root).head()
    assert listed["spec"] == spec and listed["train_excluded"] == ["<2024-01-02,2024-01-03)"]
