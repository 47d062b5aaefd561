"""Queries for feature screening and intermittent demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.catalog.registry import (
    HOURLY, TUMBLING, demand, query, r, series, sql_filled, sql_series, sql_windows, sql_with, table,
)
from tidegauge.operators.intermittent import croston, croston_tsb
from tidegauge.operators.screening import (
    acf, adf, adf_lag0, gram_matrix, independent_columns, mutual_information, nonzero_levels, pacf,
)

SER = (sql_windows(HOURLY), sql_series())
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "nonzero_levels",
    """WITH long AS (
         UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
         ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x)
       SELECT feature, count(*) FILTER (x <> 0) AS nonzero FROM long GROUP BY feature""",
)
def levels(spark, sf_dir):
    return nonzero_levels(table(spark, sf_dir, "lineitem"), NUMERIC)


@query(
    "gram_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}) / count(*), 4) AS gram FROM lineitem"
        for k, a in enumerate(NUMERIC)
        for b in NUMERIC[k:]
    ),
)
def gram(spark, sf_dir):
    """Per row, so that the size of the table does not eat the digits compared."""
    rows = table(spark, sf_dir, "lineitem")
    total = rows.count()
    return gram_matrix(rows, NUMERIC).select("i", "j", F.round(F.col("gram") / total, 4).alias("gram"))


@query(
    "independent_columns",
    """SELECT position::INT AS position, feature, feature NOT IN ('gross', 'twice') AS independent
       FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'gross', 'rebate', 'twice']) AS feature,
                    unnest(range(7)) AS position)""",
)
def independent(spark, sf_dir):
    """``gross`` and ``twice`` depend on earlier columns and must be dropped."""
    rows = table(spark, sf_dir, "lineitem").select(
        *NUMERIC,
        (F.col("l_quantity") + F.col("l_tax")).alias("gross"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
        (F.col("l_discount") * 2).alias("twice"),
    )
    return independent_columns(rows, rows.columns)


_ACF_LAGS = 12


@query(
    "acf",
    sql_with(
        *SER,
        """long AS (SELECT protocol, t, unnest(['n', 'd']) AS feature, unnest([n::DOUBLE, d::DOUBLE]) AS x FROM ser)""",
        """centred AS (SELECT protocol, feature, t, x - avg(x) OVER (PARTITION BY protocol, feature) AS x FROM long)""",
        """zero AS (SELECT protocol, feature, sum(x * x) AS z FROM centred GROUP BY ALL)""",
        f"""lagged AS (SELECT protocol, feature, k AS lag, x * lag(x, k) OVER (PARTITION BY protocol, feature, k ORDER BY t) AS p
                       FROM centred, range({_ACF_LAGS + 1}) AS r(k))""",
    )
    + """SELECT protocol, feature, lag::INT AS lag, round(coalesce(sum(p), 0) / nullif(any_value(z), 0), 6) + 0.0::DOUBLE AS acf
         FROM lagged JOIN zero USING (protocol, feature) GROUP BY protocol, feature, lag""",
)
def autocorrelation(spark, sf_dir):
    return acf(series(spark, sf_dir), ["n", "d"], _ACF_LAGS).select("protocol", "feature", "lag", r("acf"))


@query(
    "pacf",
    "WITH RECURSIVE " + sql_with(
        *SER,
        """long AS (SELECT protocol, t, unnest(['n', 'd']) AS feature, unnest([n::DOUBLE, d::DOUBLE]) AS x FROM ser)""",
        """centred AS (SELECT protocol, feature, t, x - avg(x) OVER (PARTITION BY protocol, feature) AS x,
                              count(*) OVER (PARTITION BY protocol, feature) AS rows FROM long)""",
        f"""lagged AS (SELECT protocol, feature, rows, k, x * lag(x, k) OVER (PARTITION BY protocol, feature, k ORDER BY t) AS p
                       FROM centred, range({_ACF_LAGS + 1}) AS r(k))""",
        """covs AS (SELECT protocol, feature, rows, k, coalesce(sum(p), 0) / (rows - k) AS cov
                    FROM lagged WHERE k < rows GROUP BY protocol, feature, rows, k)""",
        """listed AS (SELECT protocol, feature, list(cov ORDER BY k) AS cov FROM covs GROUP BY protocol, feature)""",
        # Levinson's recursion: the newest coefficient is the partial autocorrelation.
        """steps AS (
             SELECT protocol, feature, cov, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS newest, cov[1] AS error FROM listed
             UNION ALL
             SELECT protocol, feature, cov, k, list_transform(range(1, k), lambda i: phi[i] - newest * phi[k - i]) || [newest],
                    newest, error * (1 - newest * newest)
             FROM (SELECT protocol, feature, cov, k + 1 AS k, phi, error,
                          (cov[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * cov[k - i + 2])), 0)) / error AS newest
                   FROM steps WHERE k + 1 < len(cov)))""",
    ).removeprefix("WITH ")
    + "SELECT protocol, feature, k::INT AS lag, round(newest, 6) + 0.0 AS pacf FROM steps",
)
def partial_autocorrelation(spark, sf_dir):
    return pacf(series(spark, sf_dir), ["n", "d"], _ACF_LAGS).select("protocol", "feature", "lag", r("pacf"))


@query(
    "adf_lag0",
    sql_with(
        *SER,
        "long AS (SELECT protocol, t, unnest(['n', 'd']) AS feature, unnest([n::DOUBLE, d::DOUBLE]) AS x FROM ser)",
        "pairs AS (SELECT *, lag(x) OVER (PARTITION BY protocol, feature ORDER BY t) AS was FROM long)",
        """sums AS (SELECT protocol, feature, regr_count(x - was, was) AS rows, regr_slope(x - was, was) AS slope,
                           regr_sxx(x - was, was) AS sxx, regr_syy(x - was, was) AS syy, regr_sxy(x - was, was) AS sxy
                    FROM pairs WHERE t >= 1 GROUP BY protocol, feature)""",
    )
    + """SELECT protocol, feature, rows::BIGINT AS rows,
                round(slope / nullif(sqrt((syy - slope * sxy) / nullif(rows - 2, 0) / nullif(sxx, 0)), 0), 5) AS statistic
         FROM sums""",
)
def unit_root_lag0(spark, sf_dir):
    return adf_lag0(series(spark, sf_dir), ["n", "d"]).select("protocol", "feature", "rows", r("statistic", 5))


@query(
    "adf_up_to_one_lag",
    sql_with(
        *SER,
        "long AS (SELECT protocol, t, unnest(['n', 'd']) AS feature, unnest([n::DOUBLE, d::DOUBLE]) AS x FROM ser)",
        "levels AS (SELECT *, lag(x) OVER w AS l, x - lag(x) OVER w AS y FROM long WINDOW w AS (PARTITION BY protocol, feature ORDER BY t))",
        "rows AS (SELECT *, lag(y) OVER (PARTITION BY protocol, feature ORDER BY t) AS d FROM levels)",
        # Sums about the mean of y on level and lagged change, over rows that have both.
        """sums AS (SELECT protocol, feature, count(*) AS n, regr_syy(y, l) AS yy, regr_sxx(y, l) AS ll, regr_sxx(y, d) AS dd,
                           regr_sxy(y, l) AS ly, regr_sxy(y, d) AS dy, regr_sxy(l, d) AS ld
                    FROM rows WHERE t >= 2 GROUP BY protocol, feature)""",
        """one AS (SELECT *, ll * dd - ld * ld AS det, (ly * dd - dy * ld) / det AS wl, (dy * ll - ly * ld) / det AS wd,
                          yy - wl * ly - wd * dy AS rest1, yy - ly * ly / ll AS rest0 FROM sums)""",
        """none AS (SELECT protocol, feature, count(*) AS n, regr_slope(y, l) AS wl, regr_sxx(y, l) AS ll,
                           regr_syy(y, l) - regr_slope(y, l) * regr_sxy(y, l) AS rest FROM rows WHERE t >= 1 GROUP BY protocol, feature)""",
    )
    + """SELECT protocol, feature, (n1 < n0)::INT AS used_lag, (CASE WHEN n1 < n0 THEN one.n ELSE none.n END)::INT AS rows,
                round(CASE WHEN n1 < n0 THEN one.wl / sqrt(rest1 / (one.n - 3) * dd / det)
                           ELSE none.wl / sqrt(none.rest / (none.n - 2) / none.ll) END, 5) AS statistic
         FROM (SELECT *, n * ln(rest1 / n) + 6 AS n1, n * ln(rest0 / n) + 4 AS n0 FROM one) AS one
         JOIN none USING (protocol, feature)""",
)
def unit_root_one_lag(spark, sf_dir):
    tested = adf(series(spark, sf_dir), ["n", "d"], max_lag=1)
    return tested.select("protocol", "feature", "used_lag", "rows", r("statistic", 5))


@query("adf")
def unit_root(spark, sf_dir):
    tested = adf(series(spark, sf_dir), ["n", "d"])
    return tested.select(
        "protocol", "feature", r("statistic", 5), r("p_value"), "used_lag", "rows", r("critical_5"), "stationary"
    )


_BINS = 10
# Skewed, with an outlier: equal-width cells would see one value in it.
_SKEWED = """CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN CAST(1e30 AS DOUBLE)
             ELSE l_extendedprice * l_extendedprice * l_extendedprice * l_extendedprice END"""


def _mi_sql() -> str:
    columns = [*NUMERIC, "skewed"]
    parts = [
        f"given AS (SELECT row_number() OVER () AS id, {', '.join(NUMERIC)}, {_SKEWED} AS skewed FROM lineitem)",
        "cells AS (SELECT id, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in columns) + " FROM given)",
        f"long AS (UNPIVOT cells ON {', '.join(columns)} INTO NAME feature VALUE cell)",
        "counts AS (SELECT feature, cell, count(*) AS n FROM long GROUP BY feature, cell)",
        f"""bins AS (SELECT feature, cell, floor({_BINS} * coalesce(sum(n) OVER (PARTITION BY feature ORDER BY cell
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY feature)) AS bin FROM counts)""",
        "binned AS (SELECT id, feature, bin FROM long JOIN bins USING (feature, cell))",
        """joint AS (SELECT a.feature, b.feature AS other, a.bin AS x, b.bin AS y, count(*)::DOUBLE AS n
              FROM binned a JOIN binned b USING (id) GROUP BY ALL)""",
        """terms AS (SELECT feature, other, n / sum(n) OVER p * ln(n * sum(n) OVER p /
              (sum(n) OVER (PARTITION BY feature, other, x) * sum(n) OVER (PARTITION BY feature, other, y))) AS term
              FROM joint WINDOW p AS (PARTITION BY feature, other))""",
        "mi AS (SELECT feature, other, sum(term) AS mi FROM terms GROUP BY feature, other)",
    ]
    return sql_with(*parts) + (
        "SELECT feature, other, round(mi, 6) AS mi, round(mi / max(mi) OVER (PARTITION BY feature), 6) AS relative FROM mi"
    )


@query("mutual_information", _mi_sql())
def shared_information(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("skewed", F.expr(_SKEWED))
    found = mutual_information(rows, [*NUMERIC, "skewed"], _BINS)
    return found.select("feature", "other", r("mi"), r("relative"))


def _croston_sql(first_second: str, on_demand: str, otherwise: str, forecast: str) -> str:
    """Row by row recurrence; ``q`` counts the rows since the last demand."""
    return (
        "WITH RECURSIVE "
        + ",\n".join(
            [
                sql_windows(TUMBLING),
                sql_filled(),
                "zeros AS (SELECT protocol, window_start, coalesce(n, 0)::DOUBLE AS n FROM filled)",
                sql_series("zeros"),
                """opening AS (SELECT protocol, coalesce(min(t) FILTER (n > 0), 0) AS t0,
                     coalesce(arg_min(n, t) FILTER (n > 0), arg_min(n, t)) AS a0 FROM ser GROUP BY protocol)""",
                f"""state AS (
  SELECT protocol, 0::BIGINT AS t, a0 AS level, {first_second} AS period, 1::BIGINT AS q FROM opening
  UNION ALL
  SELECT s.protocol, s.t + 1, CASE WHEN r.n > 0 THEN 0.4 * r.n + 0.6 * s.level ELSE s.level END,
         CASE WHEN r.n > 0 THEN {on_demand} ELSE {otherwise} END,
         CASE WHEN r.n > 0 THEN 1 ELSE s.q + 1 END
  FROM state s JOIN ser r ON r.protocol = s.protocol AND r.t = s.t)""",
            ]
        )
        + f"""
SELECT s.protocol, s.t, r.n AS demand, round({forecast}, 4) AS forecast, round(s.period, 4) AS period,
       round(s.level, 4) AS level, round(r.n - {forecast}, 4) + 0.0::DOUBLE AS error
FROM state s LEFT JOIN ser r ON r.protocol = s.protocol AND r.t = s.t"""
    )


@query(
    "croston",
    _croston_sql("(t0 + 1)::DOUBLE", "0.4 * s.q + 0.6 * s.period", "s.period", "s.level / s.period"),
)
def croston_forecast(spark, sf_dir):
    made = croston(demand(spark, sf_dir), "n", extra_periods=1)
    return made.select("protocol", "t", "demand", *[r(c, 4) for c in ("forecast", "period", "level", "error")])


@query(
    "croston_tsb",
    _croston_sql("1.0::DOUBLE / (t0 + 1)", "0.4 + 0.6 * s.period", "0.6 * s.period", "s.level * s.period"),
)
def croston_tsb_forecast(spark, sf_dir):
    made = croston_tsb(demand(spark, sf_dir), "n", extra_periods=1)
    return made.select("protocol", "t", "demand", *[r(c, 4) for c in ("forecast", "period", "level", "error")])
