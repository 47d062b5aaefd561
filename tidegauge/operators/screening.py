"""Feature screening: independence, sparsity, autocorrelation, stationarity and
mutual information of the columns of a frame."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.joins import attach
from tidegauge.operators.position import BLOCK_ROWS, before, in_blocks, with_neighbours
from tidegauge.session import materialise

# MacKinnon (1994) p-value polynomials and (2010) 5% critical
# value for the Dickey-Fuller regression with a constant.
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_SPLIT = -1.61
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.04)

# Columns whose products are as many expressions in one aggregate; the products of more are matrices.
GRAM_EXPRESSIONS = 16
# Cells of a batch that are multiplied at a time.
CHUNK_CELLS = 2_000_000


def nonzero_levels(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-zero cells per column, ``(by..., feature, nonzero)``."""
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(c) != 0).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "feature", "nonzero")


def _as_matrix(batch: pa.RecordBatch, missing: float) -> np.ndarray:
    """The batch's columns of doubles as those of a matrix."""
    filled = [pc.fill_null(c, missing).to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.column_stack(filled) if filled else np.empty((0, 0))


def _added(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows ``i, row`` of one ``i`` added up, over all batches of a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[i] = total.get(i, 0.0) + np.asarray(row.values)
    if total:
        rows = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(list(total.values()))), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), rows], names=["i", "row"])


def block_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, row``: the rows of the matrix of sums of products of all columns.

    Every task multiplies its batches as matrices and hands on one matrix, the rows
    of which are added up by tasks for a share of them each.
    """
    width = len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width))
        for batch in batches:
            step = max(1, CHUNK_CELLS // width)
            for at in range(0, batch.num_rows, step):
                cells = _as_matrix(batch.slice(at, step), 0.0)
                gram += cells.T @ cells
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(gram), pa.list_(pa.float64()))], names=["i", "row"])

    tasks = min(width, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "i int, row array<double>"
    values = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return values.mapInArrow(products, schema).repartition(tasks, "i").mapInArrow(lambda batches: _added(batches, width), schema)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of products of every column pair, ``(i, j, gram)`` with ``i <= j``; missing cells count as 0."""
    if len(columns) > GRAM_EXPRESSIONS:
        names = F.array(*[F.lit(c) for c in columns])
        rows = block_products(df, columns).select("i", F.posexplode("row").alias("j", "gram")).where("i <= j")
        return rows.select(F.get(names, F.col("i")).alias("i"), F.get(names, F.col("j")).alias("j"), "gram")
    pairs = [(a, b) for x, a in enumerate(columns) for b in columns[x:]]
    values = {c: F.col(c).cast("double") for c in columns}
    wide = df.agg(
        *[
            F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.sum(values[a] * values[b]).alias("gram")).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    return wide.select(F.explode(F.array(*[F.col(f"`{a}|{b}`") for a, b in pairs])).alias("_g")).select("_g.*")


def independent_columns(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """Which columns are not a linear combination of earlier ones.

    ``(position, feature, independent)``. The Gram matrix has the same row space
    as the data, so reducing that small matrix gives the pivots of the data.
    """
    size = len(columns)
    gram = np.zeros((size, size))
    if size > GRAM_EXPRESSIONS:
        for i, row in block_products(df, columns).collect():  # a row per column
            gram[i] = row
    else:
        index = {c: k for k, c in enumerate(columns)}
        for row in gram_matrix(df, columns).collect():
            gram[index[row["i"]], index[row["j"]]] = gram[index[row["j"]], index[row["i"]]] = row["gram"] or 0.0
    norms = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    left = gram / np.outer(norms, norms)
    kept: list[int] = []
    for k in range(size):
        # What is left of a column's length after taking out the kept ones before it.
        if left[k, k] > tolerance:
            kept.append(k)
            left[k + 1:, k + 1:] -= np.outer(left[k + 1:, k], left[k, k + 1:]) / left[k, k]
    rows = [(k, c, k in kept) for k, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, independent boolean")


def _centred(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return attach(df, means, by).withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in columns}).drop(
        *[f"_mean_{c}" for c in columns]
    )


def _lag_products(
    df: DataFrame, columns: Sequence[str], lags: int, by: Sequence[str], position: str, block_rows: int
) -> DataFrame:
    """``(by..., feature, rows, products)``: sums of x_t * x_{t-k} for k = 0..lags."""
    by = list(by)
    centred = _centred(df.select(*by, position, *columns), columns, by)
    made = {f"{c}_{k}": before(c, k) for c in columns for k in range(1, lags + 1)}
    seen = with_neighbours(centred, made, back=lags, by=by, position=position, block_rows=block_rows)
    wide = seen.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("rows"),
                F.array(
                    F.sum(F.col(c) * F.col(c)),
                    *[F.coalesce(F.sum(F.col(c) * F.col(f"{c}_{k}")), F.lit(0.0)) for k in range(1, lags + 1)],
                ).alias("products"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(*by, F.explode(F.array(*[F.col(c) for c in columns])).alias("_s")).select(*by, "_s.*")


def acf(
    df: DataFrame,
    columns: Sequence[str],
    lags: int,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Autocorrelation per series and column, ``(by..., feature, lag, acf)``.

    A constant series has NULL autocorrelation.
    """
    sums = _lag_products(df, columns, lags, by, position, block_rows)
    return sums.select(*by, "feature", F.col("products")[0].alias("_zero"), F.posexplode("products").alias("lag", "_p")).select(
        *by, "feature", "lag", F.try_divide("_p", "_zero").alias("acf")
    )


def pacf(
    df: DataFrame,
    columns: Sequence[str],
    lags: int,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Partial autocorrelation per series and column, ``(by..., feature, lag, pacf)``.

    Yule-Walker with ``n - k`` denominators, solved by Durbin-Levinson on the
    ``lags + 1`` autocovariances of a series.
    """
    by = list(by)
    sums = _lag_products(df, columns, lags, by, position, block_rows)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for products, rows in zip(batch["products"], batch["rows"]):
                reach = min(lags, rows - 1)
                cov = [products[k] / (rows - k) for k in range(reach + 1)]
                results.append(_durbin_levinson(cov) + [None] * (lags - reach))
            yield batch[[*by, "feature"]].assign(pacf=results)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in by)
    prefix = f"{keys}, " if keys else ""
    solved = sums.mapInPandas(solve, f"{prefix}feature string, pacf array<double>")
    return solved.select(*by, "feature", F.posexplode("pacf").alias("lag", "pacf"))


def _durbin_levinson(cov: list[float]) -> list[float | None]:
    if not cov[0]:
        return [1.0] + [None] * (len(cov) - 1)
    result: list[float | None] = [1.0]
    phi = np.zeros(0)
    error = cov[0]
    for k in range(1, len(cov)):
        if error == 0:
            result.append(None)
            continue
        last = (cov[k] - phi @ np.array(cov[k - 1 : 0 : -1][: len(phi)])) / error
        phi = np.append(phi - last * phi[::-1], last)
        error *= 1 - last * last
        result.append(float(last))
    return result


def adf_lag0(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dickey-Fuller t-ratio without lagged differences, ``(by..., feature, rows, statistic)``.

    The regression of the change on the previous value has closed-form sums, so
    one aggregation serves all series and columns.
    """
    by = list(by)
    made = {f"{c}_was": before(c) for c in columns}
    seen = with_neighbours(df.select(*by, position, *columns), made, back=1, by=by, position=position, block_rows=block_rows)
    seen = seen.where(F.col(position) >= 1)
    parts = []
    for c in columns:
        x = F.col(f"{c}_was").cast("double")
        y = F.col(c) - x
        n, sxx, slope = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_slope(y, x)
        residual = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
        error = F.sqrt(F.try_divide(F.try_divide(residual, n - 2), sxx))
        parts.append(
            F.struct(
                F.lit(c).alias("feature"), n.alias("rows"), F.try_divide(slope, error).alias("statistic")
            ).alias(c)
        )
    wide = seen.groupBy(*by).agg(*parts)
    return wide.select(*by, F.explode(F.array(*[F.col(c) for c in columns])).alias("_s")).select(*by, "_s.*")


def adf_max_lag(rows: int) -> int:
    """Default largest lag, ``ceil(12 * (n / 100) ** 0.25)``, kept feasible for short series."""
    return max(0, min(math.ceil(12.0 * (rows / 100.0) ** 0.25), rows // 2 - 2))


def adf_p_value(statistic: float) -> float:
    if statistic > ADF_TAU_MAX:
        return 1.0
    if statistic < ADF_TAU_MIN:
        return 0.0
    terms = ADF_P_SMALL if statistic <= ADF_P_SPLIT else ADF_P_LARGE
    z = sum(c * statistic**k for k, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def adf_critical_5(rows: int) -> float:
    return sum(c / rows**k for k, c in enumerate(ADF_CRITICAL_5))


ADF_COLUMNS = ["statistic", "p_value", "used_lag", "rows", "critical_5", "stationary"]


def adf(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    max_lag: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC.

    ``(by..., feature, statistic, p_value, used_lag, rows, critical_5, stationary)``;
    stationary means p <= 0.05 and the statistic at most the 5% critical value.

    The normal equations of every lag order follow from the products of changes
    at each distance, so a block of rows is reduced to a few sums per lag. One
    task per series then sees those sums and the rows at both ends, never the
    series.
    """
    by = list(by)
    long = df.select(
        *by, position,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("y")) for c in columns])
        ).alias("_v"),
    ).select(*by, position, "_v.*")
    keys = [*by, "feature"]
    facts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.avg("y").alias("_mean"))
    # The test does not change when a constant is taken off; smaller numbers sum better.
    centred = attach(long, facts, keys).withColumn("y", F.col("y") - F.col("_mean")).drop("_mean")

    def lag_limit(total: int) -> int:
        return adf_max_lag(total) if max_lag is None else max(0, min(max_lag, total // 2 - 2))

    widest = lag_limit(df.groupBy(*by).count().agg(F.max("count")).head()[0] or 0)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in centred.schema.fields if f.name in keys)

    size = max(block_rows, widest + 1)
    blocked, _ = in_blocks(centred, back=widest + 1, position=position, block_rows=size)

    def block_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *names, block = key
        rows = rows.sort_values(position)
        sums = _change_products(
            rows["y"].to_numpy(), int(rows[position].iloc[0]), int(block) * size,
            lag_limit(int(rows["_total"].iloc[0])), widest,
        )
        return pd.DataFrame([(*names, sums.tolist())], columns=[*keys, "sums"])

    per_block = blocked.groupBy(*keys, "_block").applyInPandas(block_sums, f"{key_schema}, sums array<double>")
    sums = (
        per_block.select(*keys, F.posexplode("sums").alias("cell", "value"))
        .groupBy(*keys, "cell")
        .agg(F.sum("value").alias("value"))
        .select(*keys, F.lit("sum").alias("kind"), F.col("cell").cast("bigint").alias("at"), "value", F.lit(0).cast("bigint").alias("_total"))
    )
    at_ends = (F.col(position) <= widest + 1) | (F.col(position) >= F.col("_total") - widest - 2)
    ends = centred.where(at_ends).select(*keys, F.lit("row").alias("kind"), F.col(position).alias("at"), F.col("y").alias("value"), "_total")

    def solve(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        total = int(cells["_total"].max())
        summed = cells[cells["kind"] == "sum"].sort_values("at")["value"].to_numpy()
        rows = cells[cells["kind"] == "row"]
        found = _adf_from_sums(summed, dict(zip(rows["at"], rows["value"])), total, lag_limit(total), widest)
        return pd.DataFrame([(*key, *found)], columns=[*keys, *ADF_COLUMNS])

    return sums.unionByName(ends).groupBy(*keys).applyInPandas(
        solve,
        f"{key_schema}, statistic double, p_value double, used_lag int, rows int, critical_5 double, stationary boolean",
    )


def _change_products(y: np.ndarray, first: int, own_from: int, limit: int, widest: int) -> np.ndarray:
    """Sums over one block's own rows: products of changes at each distance, of
    the level with changes at each lag, and the level and its square.

    ``y`` holds consecutive positions from ``first``, copies included. Sums with
    the level skip the first ``limit`` changes, which have no full history.
    """
    change, level = np.diff(y), y[:-1]
    end = len(change)
    own = max(own_from - first - 1, 0)
    late = max(own, limit - first)
    apart, lagged = np.zeros(widest + 1), np.zeros(widest + 1)
    for k in range(limit + 1):
        begin = max(own, k)
        if begin < end:
            apart[k] = change[begin:] @ change[begin - k : end - k]
        if late < end:
            lagged[k] = level[late:] @ change[late - k : end - k]
    level = level[late:]
    return np.concatenate([apart, lagged, [level.sum(), level @ level]])


def _adf_from_sums(sums: np.ndarray, y: dict[int, float], total: int, limit: int, widest: int) -> tuple:
    rows = total - 1 - limit
    if rows < 1 or len(sums) == 0:
        return (None, None, 0, max(rows, 0), None, None)
    change = {t: y[t] - y[t - 1] for t in y if t - 1 in y}
    apart, lagged = sums[: widest + 1], sums[widest + 1 : 2 * widest + 2]
    # Products of change lag i with change lag j over the rows after the first
    # ``limit`` changes; going one step down the diagonal takes in one early
    # pair and gives up one at the end.
    products = np.zeros((limit + 1, limit + 1))
    for h in range(limit + 1):
        value = apart[h] - sum(change[s] * change[s - h] for s in range(h + 1, limit + 1))
        for i in range(limit + 1 - h):
            products[i, i + h] = products[i + h, i] = value
            if i + h < limit:
                early, late = limit - i, total - 1 - i
                value += change[early] * change[early - h] - change[late] * change[late - h]
    change_sums = np.array([y[total - 1 - j] - y[limit - j] for j in range(limit + 1)])
    # Order of columns: change, level, constant, lagged changes.
    size = limit + 3
    gram = np.zeros((size, size))
    at = [0, *range(3, size)]
    gram[np.ix_(at, at)] = products
    gram[1, at] = gram[at, 1] = lagged[: limit + 1]
    gram[2, at] = gram[at, 2] = change_sums
    gram[1, 1], gram[1, 2], gram[2, 1], gram[2, 2] = sums[-1], sums[-2], sums[-2], rows

    residuals = _nested_residuals(gram)
    best, best_score = 0, math.inf
    for lag in range(limit + 1):
        if rows > lag + 2 and residuals[lag] > 0:
            score = rows * math.log(residuals[lag] / rows) + 2 * (lag + 2)
            if score < best_score:
                best, best_score = lag, score
    # The chosen order is fitted on all rows with enough history.
    used = rows
    for t in range(best + 1, limit + 1):
        early = np.array([change[t], y[t - 1], 1.0, *[change.get(t - j, 0.0) for j in range(1, limit + 1)]])
        gram += np.outer(early, early)
        used += 1
    inner, moment = gram[1 : best + 3, 1 : best + 3], gram[1 : best + 3, 0]
    scale = np.sqrt(np.where(np.diag(inner) > 0, np.diag(inner), 1.0))
    inverse = np.linalg.pinv(inner / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    coefficients = inverse @ moment
    residual = float(gram[0, 0] - coefficients @ moment)
    if used <= best + 2 or residual <= 1e-12 * gram[0, 0] or inverse[0, 0] <= 0:
        return (None, None, best, used, None, None)
    statistic = float(coefficients[0] / math.sqrt(residual / (used - best - 2) * inverse[0, 0]))
    if not math.isfinite(statistic):  # a missing value is in some sum
        return (None, None, best, used, None, None)
    p_value, critical = adf_p_value(statistic), adf_critical_5(used)
    return (statistic, p_value, best, used, critical, bool(p_value <= 0.05 and statistic <= critical))


def _nested_residuals(gram: np.ndarray) -> np.ndarray:
    """Residual sums of squares of the regressions with 0, 1, 2... lagged changes.

    The models are nested, so one triangular factor serves them all.
    """
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))[1:]
    inner, moment = gram[1:, 1:] / np.outer(scale, scale), gram[1:, 0] / scale
    try:
        explained = np.cumsum(np.linalg.solve(np.linalg.cholesky(inner), moment) ** 2)
    except np.linalg.LinAlgError:
        explained = np.array(
            [moment[:k] @ np.linalg.pinv(inner[:k, :k], hermitian=True) @ moment[:k] for k in range(1, len(moment) + 1)]
        )
    return gram[0, 0] - explained[1:]


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order, both zeros as one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _present(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The cells of each column that are there."""
    return [pc.drop_null(c).to_numpy(zero_copy_only=False) for c in batch.columns]


def _per_column(df: DataFrame, columns: Sequence[str], reduce) -> list[pd.DataFrame]:
    """Cells of each column with the number of rows in them, their least and largest value, over all tasks.

    ``reduce`` takes the batches of a task and yields ``column, cells, n, low, high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, cell, *found in reduce(batches):
            own = [pa.array(np.full(len(cell), column, np.int32)), pa.array(cell.astype(np.int64)), *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(own, names=["c", "cell", "n", "low", "high"])

    made = df.select(*columns).mapInArrow(run, "c int, cell long, n long, low double, high double")
    found = made.groupBy("c", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.toPandas().sort_values(["c", "cell"])
    return [found[found["c"] == k] for k in range(len(columns))]


def order_statistics(df: DataFrame, columns: Sequence[str], ranks: Sequence[Sequence[int]]) -> list[np.ndarray]:
    """The values at some places, from 0, of each column in its order; nulls have no place.

    The values are found digit by digit: a pass over the rows counts, per task, the
    next bits of the cells that begin as a wanted value does, until those that begin
    alike are equal. No row is sorted or shuffled, and a task's counts don't grow
    with its rows.
    """
    widths = [16, 12, 12, 12, 12] if len(columns) <= 32 else [8] * 8
    known = [np.zeros(len(r), np.uint64) for r in ranks]
    left = [np.array(r, np.int64) for r in ranks]  # place among the cells that begin alike
    values = [np.full(len(r), np.nan) for r in ranks]
    for done, width in zip(np.cumsum([0, *widths]).tolist(), widths):
        begins = [np.unique(k[np.isnan(v)]) for k, v in zip(known, values)]
        if not any(map(len, begins)):
            break

        def digits(batches, begins=begins, done=done, width=width):
            tables = [(np.zeros(len(b) << width, np.int64), np.full(len(b) << width, np.inf), np.full(len(b) << width, -np.inf)) for b in begins]
            for batch in batches:
                for (count, low, high), begin, x in zip(tables, begins, _present(batch)):
                    if not len(begin):
                        continue
                    key = _sortable(x) >> np.uint64(64 - done - width)
                    above = key >> np.uint64(width)
                    place = np.minimum(np.searchsorted(begin, above), len(begin) - 1)
                    alike = begin[place] == above
                    cell = (place[alike] << width) + (key[alike] & np.uint64((1 << width) - 1)).astype(np.int64)
                    count += np.bincount(cell, minlength=len(count))
                    np.minimum.at(low, cell, x[alike])
                    np.maximum.at(high, cell, x[alike])
            for column, (count, low, high) in enumerate(tables):
                cell = np.flatnonzero(count)
                yield column, cell, count[cell], low[cell], high[cell]

        for c, found in enumerate(_per_column(df, columns, digits)):
            cell = found["cell"].to_numpy()
            for e in np.flatnonzero(np.isnan(values[c])):
                own = int(np.searchsorted(begins[c], known[c][e])) << width
                inside = found.iloc[slice(*np.searchsorted(cell, [own, own + (1 << width)]))]
                upto = inside["n"].cumsum().to_numpy()
                at = int(np.searchsorted(upto, left[c][e], "right"))
                left[c][e] -= upto[at - 1] if at else 0
                known[c][e] = (known[c][e] << np.uint64(width)) | np.uint64(inside["cell"].iloc[at] - own)
                if inside["low"].iloc[at] == inside["high"].iloc[at]:
                    values[c][e] = inside["low"].iloc[at]
    return values


def next_values(df: DataFrame, columns: Sequence[str], values: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The smallest value of each column above each of the given ones, which are sorted; NaN if there is none."""

    def least(batches):
        lowest = [np.full(len(v) + 1, np.inf) for v in values]
        count = [np.zeros(len(v) + 1, np.int64) for v in values]
        for batch in batches:
            for low, n, v, x in zip(lowest, count, values, _present(batch)):
                place = np.searchsorted(v, x, "left")
                np.minimum.at(low, place, x)
                n += np.bincount(place, minlength=len(n))
        for column, (low, n) in enumerate(zip(lowest, count)):
            cell = np.flatnonzero(n)
            yield column, cell, n[cell], low[cell], low[cell]

    out = []
    for v, found in zip(values, _per_column(df, columns, least)):
        place = np.searchsorted(found["cell"].to_numpy(), np.arange(1, len(v) + 1))
        out.append(np.append(found["low"].to_numpy(), np.nan)[place])
    return out


def frequency_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Values at which near-equal-frequency bins begin, per column, exactly.

    A value belongs to the bin of the share of rows below it, so a bin begins at the
    smallest value above that of the last row before the bin's share.
    """
    doubles = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    counts = doubles.agg(*[F.count(c) for c in columns]).head()
    ranks = [sorted({-(-b * n // bins) - 1 for b in range(1, bins)}) if n else [] for n in counts]
    last = [np.unique(v) for v in order_statistics(doubles, columns, ranks)]
    starts = next_values(doubles, columns, last)
    return {c: np.unique(s[~np.isnan(s)]).tolist() for c, s in zip(columns, starts)}


def pair_counts(df: DataFrame, columns: list[str], edges: list[np.ndarray]) -> DataFrame:
    """``feature, other, x, y, n``: rows per pair of bins of every column pair, a column's own included.

    ``edges`` are the values at which each column's bins after the first one begin.
    """
    bins = max(len(e) for e in edges) + 1
    pairs = list(combinations_with_replacement(range(len(columns)), 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((len(pairs), bins * bins), np.int64)
        for batch in batches:
            codes = [np.searchsorted(e, c.to_numpy(), "right") for e, c in zip(edges, batch.columns)]
            scaled = [c * bins for c in codes]
            for table, (a, b) in zip(tables, pairs):
                table += np.bincount(scaled[a] + codes[b], minlength=bins * bins)
        pair, cell = np.nonzero(tables)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (pair.astype(np.int32), cell.astype(np.int32), tables[pair, cell])], names=["pair", "cell", "n"]
        )

    found = df.select(*columns).mapInArrow(count, "pair int, cell int, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n"))
    first, second = (F.array(*[F.lit(columns[p[side]]) for p in pairs]) for side in (0, 1))
    return found.select(
        F.get(first, F.col("pair")).alias("feature"), F.get(second, F.col("pair")).alias("other"),
        (F.col("cell") / bins).cast("int").alias("x"), (F.col("cell") % bins).alias("y"), "n",
    )


def mutual_information(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information of every column pair over equal-frequency bins.

    ``(feature, other, mi, relative)``, ``relative`` being divided by the largest
    value of the feature. Rows with a missing value in any column are left out.

    The tables of all pairs are counted in one pass: a task keeps the bins of its
    rows as small numbers and adds each pair of columns to a table of its own, so
    it hands on no more than ``pairs * bins**2`` counts, whatever its rows.
    """
    # Stored once, as every pass reads these columns only.
    whole = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna(), "screened")
    edges = frequency_edges(whole, columns, bins)
    joint = pair_counts(whole, list(columns), [np.array(edges[c]) for c in columns])
    total = F.sum("n").over(Window.partitionBy("feature", "other"))
    in_x = F.sum("n").over(Window.partitionBy("feature", "other", "x"))
    in_y = F.sum("n").over(Window.partitionBy("feature", "other", "y"))
    terms = joint.select(
        "feature", "other", (F.col("n") / total * F.log(F.col("n") * total / (in_x * in_y).cast("double"))).alias("term")
    )
    half = terms.groupBy("feature", "other").agg(F.sum("term").alias("mi"))
    # The measure is symmetric: each pair is computed once and shown both ways.
    both = F.when(F.col("feature") == F.col("other"), F.array(F.struct("feature", "other"))).otherwise(
        F.array(
            F.struct("feature", "other"), F.struct(F.col("other").alias("feature"), F.col("feature").alias("other"))
        )
    )
    mi = half.select("mi", F.explode(both).alias("_p")).select("_p.feature", "_p.other", "mi")
    largest = F.max("mi").over(Window.partitionBy("feature"))
    return mi.select("feature", "other", "mi", F.when(largest > 0, F.col("mi") / largest).alias("relative"))
