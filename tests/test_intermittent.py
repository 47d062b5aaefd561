import numpy as np
import pandas as pd
import pytest

from helpers import rows_of
from tidegauge.operators import intermittent
from tidegauge.operators.intermittent import croston, croston_tsb
from tidegauge.operators.position import decay_block_rows


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    shapes = [(700, 0.3), (300, 0.02), (50, 0.0), (7, 1.0), (1, 0.0), (1, 1.0), (2200, 0.5)]
    return {
        f"s{k}": np.where(rng.random(n) < share, rng.integers(1, 9, n), 0).astype(float)
        for k, (n, share) in enumerate(shapes)
    }


@pytest.fixture(scope="module")
def frame(spark, series):
    pdf = pd.concat([pd.DataFrame({"protocol": k, "t": range(len(v)), "x": v}) for k, v in series.items()])
    return spark.createDataFrame(pdf).repartition(4).cache()


def direct(demand, alpha, beta, extra):
    """The recurrence row by row: state ahead of each row, then the future rows."""
    first = int(np.argmax(demand > 0))
    level = demand[first]
    second = 1.0 + first if beta is None else 1.0 / (1 + first)
    waited, states = 1, []
    for cell in demand:
        states.append((level, second))
        if cell > 0:
            level = alpha * cell + (1 - alpha) * level
            second = alpha * waited + (1 - alpha) * second if beta is None else beta + (1 - beta) * second
            waited = 1
        else:
            waited += 1
            second = second if beta is None else (1 - beta) * second
    return states + [(level, second)] * extra


@pytest.mark.parametrize("alpha, beta, block", [(0.4, 0.4, 37), (0.4, 0.4, None), (1.0, 1.0, 10), (0.01, 0.02, 50), (0.9, 0.95, None)])
@pytest.mark.parametrize("tsb", [False, True])
def test_equals_the_recurrence(frame, series, alpha, beta, block, tsb):
    if tsb:
        got = croston_tsb(frame, "x", alpha=alpha, beta=beta, extra_periods=3, block_rows=block)
    else:
        got = croston(frame, "x", alpha=alpha, extra_periods=3, block_rows=block)
    got = got.toPandas().sort_values(["protocol", "t"])
    for name, demand in series.items():
        expected = np.array(direct(demand, alpha, beta if tsb else None, 3))
        part = got[got.protocol == name]
        assert list(part.t) == list(range(len(demand) + 3))
        assert np.allclose(part.level, expected[:, 0], atol=1e-9)
        assert np.allclose(part.period, expected[:, 1], atol=1e-9)
        forecast = expected[:, 0] * expected[:, 1] if tsb else expected[:, 0] / expected[:, 1]
        assert np.allclose(part.forecast, forecast, atol=1e-9)
        assert np.allclose(part.error[: len(demand)].astype(float), demand - forecast[: len(demand)], atol=1e-9)
        assert part.demand[len(demand):].isna().all() and part.error[len(demand):].isna().all()


def test_blocks_fit_a_double():
    assert 0.6 ** -decay_block_rows(0.6) < 1e201
    assert decay_block_rows(0.0) == decay_block_rows(1.0) == 20_000
    assert decay_block_rows(1e-9) >= 1


def test_without_future_rows(frame):
    got = croston(frame, "x", extra_periods=0)
    assert rows_of(got.groupBy("protocol").count()) == rows_of(frame.groupBy("protocol").count())


def test_chain_over_all_levels(spark, monkeypatch):
    monkeypatch.setattr(intermittent, "FAN", 3)
    rng = np.random.default_rng(4)
    n, rows, expected = 200, [], {}
    for name, share in (("a", 0.9), ("b", 0.05), ("c", 0.0)):
        state = None
        for k in range(n):
            weight, update = (0.7, float(rng.integers(1, 9))) if rng.random() < share else (1.0, None)
            rows.append((name, k, weight, update))
            expected[name, k] = state
            if update is not None:
                state = update if state is None else weight * state + update
    steps = spark.createDataFrame(rows, "protocol string, _id long, _a_x double, _u_x double").repartition(5)
    got = {(r["protocol"], r["_id"]): r["_in_x"] for r in intermittent.state_before(steps, ["x"], ["protocol"]).collect()}
    assert got.keys() == expected.keys()
    for at, state in expected.items():
        assert got[at] is None if state is None else np.isclose(got[at], state, rtol=1e-12)


def test_nothing_small_is_cut_off(spark):
    """One demand, then so many updates that its weight is far below 1e-200 but not zero."""
    demand = np.array([1e150] + [0.0] * 900)
    df = spark.createDataFrame(pd.DataFrame({"protocol": "s", "t": range(len(demand)), "x": demand}))
    got = croston_tsb(df, "x", alpha=0.4, beta=0.5, extra_periods=0, block_rows=100).toPandas().sort_values("t")
    expected = np.array(direct(demand, 0.4, 0.5, 0))
    assert 0 < expected[-1, 1] < 1e-200
    assert np.allclose(got.period, expected[:, 1], rtol=1e-9, atol=0)


def test_no_window_over_a_whole_series(frame):
    plan = croston(frame, "x")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line.split("],")[-2] for line in windows)
