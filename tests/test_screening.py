import math

import numpy as np
import pandas as pd
import pytest

from helpers import plan_of, rows_of
from tidegauge.operators import screening
from tidegauge.operators.screening import (
    acf, adf, adf_critical_5, adf_lag0, adf_max_lag, adf_p_value, frequency_edges, gram_matrix,
    independent_columns, mutual_information, nonzero_levels, pacf,
)

RNG = np.random.default_rng(3)
NOISE = RNG.normal(size=400)
WALK = np.cumsum(RNG.choice([-1.0, 1.0], size=400))
AR = np.zeros(400)
for _t in range(1, 400):
    AR[_t] = 0.6 * AR[_t - 1] + NOISE[_t]


@pytest.fixture(scope="module")
def frame(spark):
    pdf = pd.concat(
        [
            pd.DataFrame({"protocol": "one", "t": range(400), "noise": NOISE, "walk": WALK, "ar": AR}),
            pd.DataFrame({"protocol": "two", "t": range(90), "noise": NOISE[:90], "walk": WALK[:90], "ar": AR[:90]}),
        ]
    )
    return spark.createDataFrame(pdf).repartition(5).cache()


def test_nonzero(spark):
    df = spark.createDataFrame([(0.0, 1), (2.0, 0), (None, 0)], "a double, b int")
    assert rows_of(nonzero_levels(df, ["a", "b"])) == [("a", 1), ("b", 1)]


def test_gram_and_independence(spark):
    a, b = RNG.normal(size=50), RNG.normal(size=50) * 1e6
    pdf = pd.DataFrame({"zero": 0.0, "a": a, "b": b, "c": a + b, "const": 3.0, "twice": 2 * a, "d": a * a})
    df = spark.createDataFrame(pdf)
    found = {(r["i"], r["j"]): r["gram"] for r in gram_matrix(df, list(pdf)).collect()}
    assert len(found) == 28 and found[("a", "c")] == pytest.approx(float(a @ (a + b)))
    kept = [r["feature"] for r in independent_columns(df, list(pdf)).where("independent").orderBy("position").collect()]
    assert kept == ["a", "b", "const", "d"]


@pytest.mark.parametrize("chunk", [100, 2_000_000])
def test_products_of_many_columns_are_matrices(spark, monkeypatch, chunk):
    monkeypatch.setattr(screening, "CHUNK_CELLS", chunk)
    x = RNG.normal(size=(300, 40)) * 10.0 ** RNG.integers(-3, 4, 40)
    x[:, 7], x[:, 20], x[:, 39] = 0.0, x[:, 3] - 2 * x[:, 5], x[:, 38] + x[:, 1]
    pdf = pd.DataFrame(x, columns=[f"c{k}" for k in range(40)])
    df = spark.createDataFrame(pdf.astype(object).where(RNG.random(x.shape) > 0.02, None), ", ".join(f"c{k} double" for k in range(40)))
    cells = df.toPandas().fillna(0.0).to_numpy()
    found = {(r["i"], r["j"]): r["gram"] for r in gram_matrix(df.repartition(7), list(pdf)).collect()}
    want = cells.T @ cells
    assert len(found) == 820 and all(found[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], rel=1e-9, abs=1e-12) for i in range(40) for j in range(i, 40))
    whole = spark.createDataFrame(pdf)
    kept = [r["feature"] for r in independent_columns(whole, list(pdf)).where("independent").orderBy("position").collect()]
    assert kept == [f"c{k}" for k in range(40) if k not in (7, 20, 39)]
    assert independent_columns(whole.limit(0), list(pdf)).where("independent").count() == 0


def test_five_hundred_columns_are_screened_in_one_aggregate(spark):
    x = RNG.normal(size=(700, 500))
    x[:, 250:260] = x[:, :10] + x[:, 10:20]
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{k}" for k in range(500)]))
    dropped = [r["position"] for r in independent_columns(df, df.columns).where("NOT independent").collect()]
    assert sorted(dropped) == list(range(250, 260))


def naive_acf(x, lags):
    x = x - x.mean()
    return [float(x[: len(x) - k] @ x[k:] / (x @ x)) for k in range(lags + 1)]


@pytest.mark.parametrize("size", [10, 100_000])
def test_acf(frame, size):
    got = acf(frame, ["noise", "ar"], 6, block_rows=size).where("protocol = 'one'").toPandas()
    for name, x in (("noise", NOISE), ("ar", AR)):
        found = got[got.feature == name].sort_values("lag").acf.to_numpy()
        assert np.allclose(found, naive_acf(x, 6), atol=1e-9)


def test_acf_of_a_constant(spark):
    df = spark.createDataFrame([("s", t, 2.0) for t in range(5)], "protocol string, t long, x double")
    assert [r["acf"] for r in acf(df, ["x"], 2).collect()] == [None] * 3
    assert sorted((r["lag"], r["pacf"]) for r in pacf(df, ["x"], 2).collect()) == [(0, 1.0), (1, None), (2, None)]


def test_pacf_equals_yule_walker(frame):
    got = pacf(frame, ["ar"], 5).where("protocol = 'one'").orderBy("lag").toPandas().pacf.to_numpy()
    x = AR - AR.mean()
    n = len(x)
    cov = np.array([x[: n - k] @ x[k:] / (n - k) for k in range(6)])
    expected = [1.0]
    for k in range(1, 6):
        matrix = np.array([[cov[abs(i - j)] for j in range(k)] for i in range(k)])
        expected.append(np.linalg.solve(matrix, cov[1 : k + 1])[-1])
    assert np.allclose(got, expected, atol=1e-9)


def regression(y, lag, drop):
    """Least squares of the change on level, lagged changes and a constant."""
    z = np.diff(y)
    rows = range(drop, len(z))
    design = np.array([[y[t]] + [z[t - j] for j in range(1, lag + 1)] + [1.0] for t in rows])
    target = z[drop:]
    beta = np.linalg.lstsq(design, target, rcond=None)[0]
    residual = float(((target - design @ beta) ** 2).sum())
    n, k = design.shape
    error = math.sqrt(residual / (n - k) * np.linalg.inv(design.T @ design)[0, 0])
    return beta[0] / error, n * math.log(residual / n) + 2 * k, n


def direct_adf(y):
    limit = adf_max_lag(len(y))
    best = min(range(limit + 1), key=lambda p: regression(y, p, limit)[1])
    statistic, _, n = regression(y, best, best)
    return statistic, best, n


@pytest.mark.parametrize("size", [60, 100_000])
def test_adf_equals_direct_regressions(frame, size):
    got = adf(frame, ["noise", "walk", "ar"], block_rows=size).toPandas()
    for _, row in got.iterrows():
        y = {"noise": NOISE, "walk": WALK, "ar": AR}[row.feature][: 400 if row.protocol == "one" else 90]
        statistic, lag, n = direct_adf(y)
        assert (row.used_lag, row.rows) == (lag, n)
        assert row.statistic == pytest.approx(statistic, abs=1e-6)
    one = got[got.protocol == "one"].set_index("feature")
    assert bool(one.stationary["noise"]) and bool(one.stationary["ar"]) and not bool(one.stationary["walk"])


def test_adf_without_lags(frame):
    got = {(r["protocol"], r["feature"]): r for r in adf_lag0(frame, ["ar"], block_rows=50).collect()}
    statistic, _, n = regression(AR, 0, 0)
    assert got[("one", "ar")]["rows"] == n
    assert got[("one", "ar")]["statistic"] == pytest.approx(statistic, abs=1e-9)
    fixed = adf(frame, ["ar"], max_lag=0).where("protocol = 'one'").head()
    assert fixed["statistic"] == pytest.approx(statistic, abs=1e-7)


def test_adf_of_short_and_constant_series(spark):
    rows = [("short", t, float(t * t % 3)) for t in range(3)] + [("flat", t, 1.0) for t in range(30)]
    df = spark.createDataFrame(rows, "protocol string, t long, x double")
    assert {r["protocol"]: r["statistic"] for r in adf(df, ["x"]).collect()} == {"short": None, "flat": None}


def test_dickey_fuller_tables():
    assert adf_p_value(-2.86) == pytest.approx(0.0502, abs=2e-4)
    assert adf_p_value(-3.43) == pytest.approx(0.0100, abs=2e-4)
    assert adf_p_value(3.0) == 1.0 and adf_p_value(-20.0) == 0.0
    assert adf_critical_5(10**9) == pytest.approx(-2.86154)
    # Published 5% critical value for 100 observations.
    assert adf_critical_5(100) == pytest.approx(-2.8909, abs=1e-3)


def test_bins_have_near_equal_counts(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": RNG.exponential(size=5000), "k": 1.0}))
    edges = frequency_edges(df, ["x", "k"], 10)
    assert len(edges["x"]) == 9 and edges["k"] == []


def test_order_statistics_and_edges_of_odd_columns(spark):
    n = 3000
    x = np.concatenate([RNG.normal(size=n - 8) * 10.0 ** RNG.integers(-300, 300, n - 8), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1e308, 0.0]])
    columns = {"x": x, "ties": np.round(RNG.normal(size=n)), "near": 1 + RNG.integers(0, 5, n) * 2.0**-52, "k": np.full(n, -7.5), "none": np.full(n, None), "few": [3.0, 1.0] + [None] * (n - 2)}
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in row) for row in zip(*columns.values())], ", ".join(f"{c} double" for c in columns)).repartition(5)
    ranks = [[0, 17, 1500, 2998, 2999], [0, 1, 1499, 2999], [5, 2000], [0, 2999], [], [0, 1]]
    for (name, v), r, found in zip(columns.items(), ranks, screening.order_statistics(df, list(columns), ranks)):
        assert found.tolist() == [np.sort(np.array([y for y in v if y is not None], float))[i] for i in r], name
    edges = frequency_edges(df, list(columns), 10)
    for name, v in columns.items():
        v = np.sort(np.array([y for y in v if y is not None], float))
        bins = {}
        for y in v:
            bins.setdefault(int(np.searchsorted(v, y)) * 10 // len(v), y)
        assert edges[name] == sorted(y for b, y in bins.items() if b), name


def test_mutual_information(spark):
    n = 4000
    x = RNG.normal(size=n)
    pdf = pd.DataFrame({"x": x, "same": 3 * x - 1, "other": RNG.normal(size=n), "noisy": x + 0.3 * RNG.normal(size=n), "k": 1.0})
    got = {(r["feature"], r["other"]): r for r in mutual_information(spark.createDataFrame(pdf), list(pdf)).collect()}
    assert got[("x", "x")]["mi"] == pytest.approx(math.log(10), abs=1e-2)
    assert got[("x", "same")]["relative"] == pytest.approx(1.0, abs=1e-2)
    assert got[("x", "noisy")]["mi"] > 10 * got[("x", "other")]["mi"]
    assert got[("x", "noisy")]["mi"] == pytest.approx(got[("noisy", "x")]["mi"])
    assert got[("k", "x")]["mi"] == pytest.approx(0.0, abs=1e-12) and got[("k", "k")]["relative"] is None


def test_pair_counts_are_those_of_the_bins(spark):
    """Twenty columns, some with few values, against counting every pair by itself."""
    x = RNG.normal(size=(1500, 20))
    x[:, 3], x[:, 4], x[:, 5] = 1.0, RNG.integers(0, 2, 1500), np.round(x[:, 5])
    pdf = pd.DataFrame(x, columns=[f"c{k}" for k in range(20)])
    df = spark.createDataFrame(pdf).repartition(6)
    edges = [np.array(v) for v in frequency_edges(df, list(pdf), 10).values()]
    found = screening.pair_counts(df, list(pdf), edges)
    assert plan_of(found).count("MapInArrow") == 1 and "Generate" not in plan_of(found)
    got = {(r["feature"], r["other"], r["x"], r["y"]): r["n"] for r in found.collect()}
    want = {}
    for a in range(20):
        for b in range(a, 20):
            codes = zip(np.searchsorted(edges[a], x[:, a], "right"), np.searchsorted(edges[b], x[:, b], "right"))
            for i, j in codes:
                want[f"c{a}", f"c{b}", i, j] = want.get((f"c{a}", f"c{b}", i, j), 0) + 1
    assert got == want
    assert mutual_information(df.limit(0), ["c0", "c1"]).count() == 0


def test_durbin_levinson_of_a_first_order_process():
    assert np.allclose(screening._durbin_levinson([0.5**k for k in range(4)]), [1.0, 0.5, 0.0, 0.0], atol=1e-12)


def test_mutual_information_of_skewed_columns(spark):
    x = np.append(np.exp(RNG.normal(size=2999) * 3), 1e12)
    got = mutual_information(spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + 1})), ["x", "y"]).collect()
    assert all(r["mi"] == pytest.approx(math.log(10), abs=1e-9) for r in got)


def test_dickey_fuller_of_an_incomplete_column_is_unknown(spark):
    rows = [("a", t, None if t == 100 else float(RNG.normal())) for t in range(400)]
    got = adf(spark.createDataFrame(rows, "protocol string, t long, x double"), ["x"], by=["protocol"]).head()
    assert got["statistic"] is None and got["stationary"] is None
