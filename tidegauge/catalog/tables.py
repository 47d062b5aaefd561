"""Queries for scans, sources, sinks, selection and cleaning."""

from __future__ import annotations

import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.catalog.registry import (
    FEATURES, HOURLY, events, filled, pool, pool_path, query, r, series, sql_filled, sql_series,
    sql_windows, sql_with, table, windows,
)
from tidegauge.functions.times import partial_date_bounds
from tidegauge.operators.repair import coerce_numeric, estimate_window_spec, interpolate_linear, repair_numeric, zero_fill
from tidegauge.operators.position import with_position
from tidegauge.operators.series import first_difference, sorted_series
from tidegauge.session import materialise, qualified, scratch_path
from tidegauge.sources.archive import land_archives
from tidegauge.sources.datapool import (
    PARTITIONS, WINDOW_KEYS, cached_series, convert_units, datapool_scan, in_ranges, protocol_join, ranges_from_text,
    read_datapool, select_series, store_partitions, write_datapool,
)
from tidegauge.sources.stores import locate
from tidegauge.sources.delimited import load_numeric_tsv, read_delimited, write_tsv

SPEC = (
    "click|n~click_n|d~click_d; view|n~view_n; error|n~error_n|v~error_kb"
    "#window_start, window_end"
)
RANGE = "<2024-01-05,2024-01-20)"
EXCLUDED = ["<2024-01-10,2024-01-12)", "(2024-01-14,2024-01-15>"]
IN_RANGE = "day >= DATE '2024-01-05' AND day < DATE '2024-01-20'"
NOT_EXCLUDED = (
    "NOT (day >= DATE '2024-01-10' AND day < DATE '2024-01-12')"
    " AND NOT (day > DATE '2024-01-14' AND day <= DATE '2024-01-15')"
)
WIN = sql_windows(HOURLY)
DAYS = "days AS (SELECT *, CAST(window_start AS DATE) AS day FROM win)"


@query(
    "datapool_scan",
    sql_with(WIN, DAYS)
    + f"""SELECT protocol, day, window_start, window_end, n, d FROM days
          WHERE protocol IN ('click', 'view') AND {IN_RANGE} AND {NOT_EXCLUDED}""",
)
def scan(spark, sf_dir):
    return datapool_scan(pool(spark, sf_dir), ["click", "view"], HOURLY, ["n", "d"], RANGE, EXCLUDED)


@query(
    "time_range_filter",
    sql_with(WIN, DAYS)
    + f"SELECT protocol, day, window_start, n FROM days WHERE {IN_RANGE}",
)
def time_range(spark, sf_dir):
    rows = datapool_scan(pool(spark, sf_dir), None, HOURLY, ["n"], RANGE)
    return rows.select("protocol", "day", "window_start", "n")


@query(
    "time_range_exclude",
    sql_with(WIN, DAYS)
    + f"SELECT protocol, day, window_start, n FROM days WHERE {NOT_EXCLUDED}",
)
def time_range_exclude(spark, sf_dir):
    rows = datapool_scan(pool(spark, sf_dir), None, HOURLY, ["n"], excluded=EXCLUDED)
    return rows.select("protocol", "day", "window_start", "n")


@query(
    "numeric_tsv_load",
    """SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, 0.0::DOUBLE AS event_type,
              value, 0.0::DOUBLE AS props, CAST(trunc(floor(value * 1000000) / 1048576) AS BIGINT) AS in_sum_orig_bytes
       FROM events""",
)
def numeric_tsv(spark, sf_dir):
    path = scratch_path(spark, "features-tsv")
    raw = table(spark, sf_dir, "events")
    write_tsv(
        raw.select(
            "event_id", "user_id", "event_type", "value", "props",
            F.floor(F.col("value") * 1000000).alias("in_sum_orig_bytes"),
        ),
        path,
    )
    return load_numeric_tsv(spark, path)


TOTAL = sql_windows(HOURLY, protocol="", group="")


@query(
    "delimited_read",
    sql_with(TOTAL, sql_filled(group="")) + "SELECT window_start, window_end, n FROM filled",
)
def delimited(spark, sf_dir):
    path = scratch_path(spark, "windows-tsv")
    write_tsv(windows(spark, sf_dir, HOURLY, by=()), path)
    read = read_delimited(spark, path, columns="0, 1, n", gap_slide_seconds=600)
    return read.withColumn("n", F.col("n").cast("bigint"))


@query(
    "delimited_trimmed",
    sql_with(WIN)
    + """SELECT protocol, window_start, n FROM win
         QUALIFY row_number() OVER (PARTITION BY protocol, CAST(window_start AS DATE) ORDER BY window_start DESC) > 1""",
)
def delimited_trimmed(spark, sf_dir):
    """Files of a day with two lines above the header; the last row and a closing line are left out."""
    path = scratch_path(spark, "trimmed")
    rows = datapool_scan(pool(spark, sf_dir), None, HOURLY, ["n"])
    cells = [F.col("protocol"), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.col("n").cast("string")]
    days = rows.select("protocol", "day").distinct()
    around = [(0, "# export"), (1, "# of a day"), (2, "protocol\twindow_start\tn"), (4, "# end")]
    added = days.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(x).alias("line")) for k, x in around])).alias("a"))
    lines = rows.select("protocol", "day", F.lit(3).alias("part"), F.concat_ws("\t", *cells).alias("line")).unionByName(
        added.select("protocol", "day", "a.part", "a.line")
    )
    ordered = lines.repartition("protocol", "day").sortWithinPartitions("protocol", "day", "part", "line")
    ordered.select(
        F.col("protocol").alias("p"), F.col("day").alias("d"), "line"
    ).write.partitionBy("p", "d").text(path)
    read = read_delimited(spark, path, skip_rows=2, skip_footer=2)
    return read.select("protocol", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("n").cast("bigint").alias("n"))


@query("tsv_roundtrip", sql_with(WIN) + "SELECT protocol, window_start, window_end, n, d, round(v, 6) AS v FROM win")
def tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "pool-tsv")
    rows = datapool_scan(pool(spark, sf_dir), None, HOURLY, FEATURES).drop("day")
    write_tsv(rows, path)
    back = read_delimited(spark, path)
    return back.select(
        "protocol",
        *[F.col(k).cast("timestamp_ntz").alias(k) for k in WINDOW_KEYS],
        *[F.col(c).cast("bigint").alias(c) for c in ("n", "d")],
        F.round(F.col("v").cast("double"), 6).alias("v"),
    )


def _pack_day(key: tuple, rows: pd.DataFrame, root: str) -> pd.DataFrame:
    """Zip one protocol's day of windows, the input of the landing queries."""
    protocol, day = key
    target = f"{root}/{protocol}-{day:%Y-%m-%d}.zip"
    fs, inner = locate(target)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inner) as handle, zipfile.ZipFile(handle, "w", zipfile.ZIP_DEFLATED) as archive:
        for ws, part in rows.groupby("ws"):
            text = part.sort_values("window_start")[[*WINDOW_KEYS, *FEATURES]].to_csv(sep="\t", index=False)
            archive.writestr(f"{protocol}/{day:%Y/%m/%d}/{ws}.tsv", text)
    return pd.DataFrame({"archive": [target]})


def _packed(rows: DataFrame) -> str:
    """Folder of archives, one per protocol and day of ``rows``."""
    spark = rows.sparkSession
    root = qualified(spark, scratch_path(spark, "archives"))
    packed = rows.groupBy("protocol", "day").applyInPandas(lambda key, days: _pack_day(key, days, root), "archive string")
    packed.write.parquet(scratch_path(spark, "archive-list"))
    return root


@query(
    "archive_landing",
    sql_with(WIN, DAYS)
    + "SELECT protocol, 'w01h-s10m' AS ws, day, window_start, window_end, n, d, round(v, 6) AS v FROM days",
)
def archive_landing(spark, sf_dir):
    target = scratch_path(spark, "landed")
    root = _packed(pool(spark, sf_dir))
    # The second call finds everything landed and adds nothing.
    for _ in range(2):
        land_archives(spark, root, target)
    landed = read_datapool(spark, target)
    return landed.select(
        *PARTITIONS, *WINDOW_KEYS,
        *[F.col(c).cast("bigint").alias(c) for c in ("n", "d")],
        F.round(F.col("v").cast("double"), 6).alias("v"),
    )


@query(
    "archive_landing_beside_numbers",
    sql_with(WIN, DAYS)
    + """SELECT protocol, 'w01h-s10m' AS ws, day, window_start, window_end, n::DOUBLE AS n, d::DOUBLE AS d, round(v, 6) AS v
         FROM days, range(CASE WHEN protocol = 'click' THEN 1 ELSE 1 + n % 3 END)""",
)
def landing_beside_numbers(spark, sf_dir):
    """Members with repeated lines land, twice, in a pool that holds another protocol's numbers."""
    target = scratch_path(spark, "landed")
    rows = datapool_scan(pool(spark, sf_dir), None, HOURLY, FEATURES)
    write_datapool(rows.where("protocol = 'click'").drop("day"), target, HOURLY)
    lines = rows.where("protocol <> 'click'").withColumn("ws", F.lit(HOURLY))
    repeated = lines.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") % 3))).drop("copy")
    root = _packed(repeated)
    for _ in range(2):
        land_archives(spark, root, target)
    return read_datapool(spark, target).select(*PARTITIONS, *WINDOW_KEYS, "n", "d", F.round("v", 6).alias("v"))


def _spec_sql() -> str:
    side = "SELECT * FROM win WHERE protocol = '{p}' AND CAST(window_start AS DATE) IN (SELECT day FROM kept)"
    return (
        sql_with(
            WIN,
            f"kept AS (SELECT DISTINCT day FROM (SELECT CAST(window_start AS DATE) AS day FROM win) WHERE {IN_RANGE} AND {NOT_EXCLUDED})",
            *[
                part
                for p in ("click", "view", "error")
                for part in (f"{p}_raw AS ({side.format(p=p)})", sql_filled(f"{p}_raw", f"{p}_all"))
            ],
        )
        + """SELECT c.window_start, c.window_end, c.n AS click_n, c.d AS click_d, w.n AS view_n, e.n AS error_n,
                    CAST(trunc(e.v / 1024) AS BIGINT) AS error_kb
             FROM click_all c JOIN view_all w USING (window_start, window_end)
             JOIN error_all e USING (window_start, window_end)"""
    )


@query("spec_select", _spec_sql())
def spec_select(spark, sf_dir):
    return select_series(pool(spark, sf_dir), SPEC, HOURLY, RANGE, EXCLUDED)


@query("datapool_mixed_features", _spec_sql())
def mixed_features(spark, sf_dir):
    """The same series from a pool whose protocols were written apart, with their own features."""
    path = scratch_path(spark, "mixed")
    rows = pool(spark, sf_dir).where(F.col("ws") == HOURLY)
    for protocol, features in (("click", ["n", "d"]), ("view", ["n"]), ("error", ["v", "n"])):
        write_datapool(rows.where(F.col("protocol") == protocol).select("protocol", *WINDOW_KEYS, *features), path, HOURLY)
    return select_series(read_datapool(spark, path), SPEC, HOURLY, RANGE, EXCLUDED)


TEXT_SPEC = "click|n|v~click_kb;view|v~view_mb;error|n~error_n#window_start,window_end"


def _text_sql() -> str:
    """Cells as :func:`spec_select_text` lands them, cleaned by rule."""
    side = "SELECT * FROM win WHERE protocol = '{p}'"
    blank = "CASE WHEN hour({t}.window_start) IN (3, 4) THEN NULL ELSE {x} END"
    return (
        sql_with(
            WIN,
            *[
                part
                for p in ("click", "view", "error")
                for part in (f"{p}_raw AS ({side.format(p=p)})", sql_filled(f"{p}_raw", f"{p}_all"))
            ],
        )
        + f"""SELECT c.window_start, c.window_end, c.n::DOUBLE AS n,
                     CAST(trunc({blank.format(t="c", x="c.n * 512 + 0.5")} / 1024) AS BIGINT) AS click_kb,
                     CAST(trunc({blank.format(t="w", x="w.n * 512 + 0.5")} / 1048576) AS BIGINT) AS view_mb, e.n::DOUBLE AS error_n
              FROM click_all c JOIN view_all w USING (window_start, window_end) JOIN error_all e USING (window_start, window_end)"""
    )


@query("spec_select_text", _text_sql())
def spec_select_text(spark, sf_dir):
    """A series from cells of text: fractions, and blanks or ``None`` in two hours of the day."""
    path = scratch_path(spark, "text-pool")
    rows = pool(spark, sf_dir).where((F.col("ws") == HOURLY) & F.col("protocol").isin("click", "view", "error"))
    hour = F.hour("window_start")
    cell = F.when(hour == 3, "").when(hour == 4, "None").otherwise((F.col("n") * 512 + F.lit(0.5)).cast("string"))
    store_partitions(rows.select(*PARTITIONS, *WINDOW_KEYS, F.col("n").cast("string").alias("n"), cell.alias("v")), path)
    chosen = select_series(read_datapool(spark, path), TEXT_SPEC, HOURLY)
    return coerce_numeric(chosen, ["n", "error_n"])


@query("dataset_cache", _spec_sql())
def dataset_cache(spark, sf_dir):
    root = scratch_path(spark, "datasets")
    arguments = (spark, pool_path(spark, sf_dir, HOURLY), SPEC, HOURLY, root, RANGE, EXCLUDED)
    cached_series(*arguments)
    return cached_series(*arguments)


@query(
    "protocol_join",
    sql_with(WIN)
    + """SELECT window_start, window_end, c.n AS click_n, w.n AS view_n, e.n AS error_n
         FROM (SELECT * FROM win WHERE protocol = 'click') c
         JOIN (SELECT * FROM win WHERE protocol = 'view') w USING (window_start, window_end)
         JOIN (SELECT * FROM win WHERE protocol = 'error') e USING (window_start, window_end)""",
)
def joined(spark, sf_dir):
    base = pool(spark, sf_dir)
    return protocol_join(
        [
            datapool_scan(base, [p], HOURLY, ["n"]).select(*WINDOW_KEYS, F.col("n").alias(f"{p}_n"))
            for p in ("click", "view", "error")
        ]
    )


@query(
    "partial_date_ranges",
    """WITH texts AS (
         SELECT DISTINCT unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y-%m-%d')]) AS text
         FROM orders
         UNION SELECT DISTINCT strftime(o_orderdate, '%Y-%m') || '--' || strftime(o_orderdate + INTERVAL 1 YEAR, '%Y') FROM orders),
       parts AS (
         SELECT text, split_part(text, '--', 1) AS a, CASE WHEN text LIKE '%--%' THEN split_part(text, '--', 2) ELSE text END AS b,
                text LIKE '%--%' AS pair FROM texts),
       days AS (
         SELECT text, pair, length(b) AS unit,
                CAST(CASE length(a) WHEN 4 THEN a || '-01-01' WHEN 7 THEN a || '-01' ELSE a END AS DATE) AS first_day,
                CAST(CASE length(b) WHEN 4 THEN b || '-01-01' WHEN 7 THEN b || '-01' ELSE b END AS DATE) AS end_first
         FROM parts),
       ends AS (
         SELECT *, CAST(end_first + CASE unit WHEN 4 THEN INTERVAL 1 YEAR WHEN 7 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END AS DATE) AS after_end
         FROM days)
       SELECT text, first_day, CAST(after_end - INTERVAL 1 DAY AS DATE) AS last_day,
              CASE WHEN pair THEN end_first ELSE after_end END AS open_end
       FROM ends""",
)
def partial_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    texts = table(spark, sf_dir, "orders").select(
        F.explode(
            F.array(
                F.date_format(day, "yyyy"),
                F.date_format(day, "yyyy-MM"),
                F.date_format(day, "yyyy-MM-dd"),
                F.concat(F.date_format(day, "yyyy-MM"), F.lit("--"), F.date_format(F.add_months(day, 12), "yyyy")),
            )
        ).alias("text")
    ).distinct()
    first, last = partial_date_bounds(F.col("text"))
    _, open_end = partial_date_bounds(F.col("text"), inclusive_end=False)
    return texts.select("text", first.alias("first_day"), last.alias("last_day"), open_end.alias("open_end"))


PARTIAL_RANGES = "2024-01-03--2024-01-08, 2024-01-15, 2023, 20240120--2024-01"


@query(
    "partial_date_filter",
    sql_with(
        WIN,
        DAYS,
        """marked AS (SELECT *, day BETWEEN DATE '2024-01-03' AND DATE '2024-01-08' OR day = DATE '2024-01-15'
              OR day <= DATE '2023-12-31' OR day BETWEEN DATE '2024-01-20' AND DATE '2024-01-31' AS inside FROM days)""",
    )
    + "SELECT protocol, day, window_start, n, inside FROM marked",
)
def partial_date_filter(spark, sf_dir):
    rows = datapool_scan(pool(spark, sf_dir), None, HOURLY, ["n"]).select("protocol", "day", "window_start", "n")
    ranges = ranges_from_text(spark, PARTIAL_RANGES)
    inside = in_ranges(rows, ranges).withColumn("inside", F.lit(True))
    return inside.unionByName(in_ranges(rows, ranges, keep=False).withColumn("inside", F.lit(False)))


@query(
    "unit_conversion",
    """SELECT event_id, CAST(trunc(floor(value * 1000000) / 1024) AS BIGINT) AS sent_kB,
              CAST(trunc(floor(value * 1000000) / 1048576) AS BIGINT) AS received_MB,
              CAST(trunc(nullif(floor(value * 1000000000), 0) / 1073741824) AS BIGINT) AS total_gb
       FROM events""",
)
def units(spark, sf_dir):
    value = F.col("value")
    sized = events(spark, sf_dir).select(
        "event_id",
        F.floor(value * 1000000).alias("sent_kB"),
        F.floor(value * 1000000).alias("received_MB"),
        F.nullif(F.floor(value * 1000000000), F.lit(0)).alias("total_gb"),
    )
    return convert_units(sized)


def _raw_text(spark, sf_dir) -> DataFrame:
    """Event values as the text a monitoring file may hold, bad cells included."""
    kind = F.col("protocol")
    return events(spark, sf_dir).select(
        "event_id",
        F.when(kind == "error", "None").when(kind == "signup", "NaN").when(kind == "purchase", " ")
        .otherwise(F.col("value").cast("string")).alias("value"),
        F.when(kind == "error", "inf").when(kind == "view", "-inf").otherwise(F.col("user_id").cast("string")).alias("user"),
        kind.alias("kind"),
    )


CLEAN_VALUE = "CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN NULL ELSE value END"
CLEAN_USER = "CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE CAST(user_id AS DOUBLE) END"


@query(
    "coerce_numeric",
    f"SELECT event_id, {CLEAN_VALUE} AS value, {CLEAN_USER} AS user, CAST(NULL AS DOUBLE) AS kind FROM events",
)
def coerce(spark, sf_dir):
    return coerce_numeric(_raw_text(spark, sf_dir), ["value", "user", "kind"])


@query(
    "zero_fill",
    f"SELECT event_id, coalesce({CLEAN_VALUE}, 0) AS value, coalesce({CLEAN_USER}, 0) AS user, event_type AS kind FROM events",
)
def zeros(spark, sf_dir):
    return zero_fill(_raw_text(spark, sf_dir), ["value", "user"])


@query(
    "repair_numeric",
    f"""SELECT event_id, coalesce({CLEAN_VALUE}, 0) AS value, coalesce({CLEAN_USER}, 0) AS user, CAST(0 AS DOUBLE) AS kind
        FROM events""",
)
def repaired(spark, sf_dir):
    return repair_numeric(_raw_text(spark, sf_dir), keep=["event_id"])


@query(
    "estimate_window_spec",
    sql_with(WIN, sql_filled(slide=0))
    + "SELECT protocol, day, len AS window_seconds, nullif(slide, 0) AS slide_seconds FROM filled_spec",
)
def window_spec(spark, sf_dir):
    return estimate_window_spec(datapool_scan(pool(spark, sf_dir), None, HOURLY, []))


@query(
    "gap_fill",
    sql_with(WIN, sql_filled())
    + "SELECT protocol, day, window_start, window_end, n, d, round(v, 6) AS v FROM filled",
)
def gaps(spark, sf_dir):
    return filled(spark, sf_dir).select("protocol", "day", *WINDOW_KEYS, "n", "d", F.round("v", 6).alias("v"))


@query(
    "interpolate_linear",
    sql_with(
        WIN,
        sql_filled(),
        sql_series("filled"),
        """near AS (
  SELECT *,
    last_value(n IGNORE NULLS) OVER past AS n0, last_value(CASE WHEN n IS NOT NULL THEN t END IGNORE NULLS) OVER past AS t0,
    first_value(n IGNORE NULLS) OVER rest AS n1, first_value(CASE WHEN n IS NOT NULL THEN t END IGNORE NULLS) OVER rest AS t1,
    last_value(d IGNORE NULLS) OVER past AS d0, first_value(d IGNORE NULLS) OVER rest AS d1
  FROM ser
  WINDOW past AS (PARTITION BY protocol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         rest AS (PARTITION BY protocol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    )
    + """SELECT protocol, t, window_start,
           round(CASE WHEN n IS NOT NULL THEN n WHEN n0 IS NULL THEN NULL WHEN n1 IS NULL THEN n0
                      ELSE n0 + (n1 - n0) * ((t - t0)::DOUBLE / (t1 - t0)) END::DOUBLE, 6) AS n,
           round(CASE WHEN d IS NOT NULL THEN d WHEN d0 IS NULL THEN NULL WHEN d1 IS NULL THEN d0
                      ELSE d0 + (d1 - d0) * ((t - t0)::DOUBLE / (t1 - t0)) END::DOUBLE, 6) AS d
         FROM near""",
)
def interpolated(spark, sf_dir):
    placed = materialise(with_position(filled(spark, sf_dir).select("protocol", "window_start", "n", "d")), "placed")
    return interpolate_linear(placed, ["n", "d"]).select("protocol", "t", "window_start", r("n"), r("d"))


@query("sorted_series", sql_with(WIN, sql_series()) + "SELECT protocol, window_start, t, n FROM ser ORDER BY protocol, window_start")
def sorted_rows(spark, sf_dir):
    return sorted_series(series(spark, sf_dir).select("protocol", "window_start", "t", "n"))


CHANGES_SPEC = "click|n~click_n|d~click_d;view|n~view_n;error|n~error_n|v~error_v#window_start,window_end"


@query(
    "spec_changes",
    sql_with(
        WIN,
        """joined AS (
  SELECT window_start, c.n AS click_n, c.d AS click_d, w.n AS view_n, e.n AS error_n, e.v AS error_v
  FROM (SELECT * FROM win WHERE protocol = 'click') c
  JOIN (SELECT * FROM win WHERE protocol = 'view') w USING (window_start, window_end)
  JOIN (SELECT * FROM win WHERE protocol = 'error') e USING (window_start, window_end))""",
        sql_series("joined", by=""),
    )
    + """SELECT * FROM (SELECT t, window_start, """
    + ", ".join(
        f"round(({c} - lag({c}) OVER (ORDER BY t))::DOUBLE, 4) + 0.0::DOUBLE AS {c}"
        for c in ("click_n", "click_d", "view_n", "error_n", "error_v")
    )
    + " FROM ser) WHERE t >= 1",
)
def spec_changes(spark, sf_dir):
    """Flagship: windows of three protocols joined, repaired, numbered, differenced."""
    chosen = select_series(pool(spark, sf_dir), CHANGES_SPEC, HOURLY, fill_gaps=False)
    columns = [c for c in chosen.columns if c not in WINDOW_KEYS]
    clean = repair_numeric(chosen, keep=WINDOW_KEYS).withColumn("series", F.lit("main"))
    changed = first_difference(with_position(clean, by=["series"]), columns, by=["series"])
    return changed.select("t", "window_start", *[r(c, 4) for c in columns])
