"""The datapool: windowed features of all protocols, partitioned by
protocol, window tag and day."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.numeric import suffix_divisor, truncated_units
from tidegauge.functions.times import DayRange, covered_by_any, parse_window_tag, partial_date_bounds
from tidegauge.operators.repair import gap_fill
from tidegauge.session import materialise, path_exists, path_version
from tidegauge.sources.manifest import (
    PARTITIONS, add_entries, lacking, logical, read_manifest, stored_names, stored_schema,
)

WINDOW_KEYS = ["window_start", "window_end"]


def store_partitions(rows: DataFrame, path: str) -> None:
    """Write rows that carry the partition columns into the datapool at ``path``.

    Only the (protocol, ws, day) partitions present in ``rows`` are replaced, so
    repeating a write gives the same table. The manifest learns the columns first;
    rows are stored once, as it needs their groups and placing them samples them.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "pool_rows")
    entries = read_manifest(spark, path)
    columns = {f.name: f.dataType for f in rows.schema if f.name not in PARTITIONS}
    names = stored_names(entries, columns)
    groups = rows.select("protocol", "ws").distinct().collect()  # a row per protocol and tag
    add_entries(spark, path, entries, [(p, ws, c, t.simpleString(), names[c]) for p, ws in groups for c, t in columns.items()])
    place_partitions(rows.withColumnsRenamed(names), path)


def place_partitions(rows: DataFrame, path: str) -> None:
    """Write rows under their names in the files.

    Rows are placed by sampled ranges of partition and time: a partition of any
    size is split over as many tasks as it needs, small ones share a task, and
    files come out sorted by time.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.repartitionByRange(tasks, *PARTITIONS, "window_start")
        .sortWithinPartitions(*PARTITIONS, "window_start")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def write_datapool(features: DataFrame, path: str, ws: str) -> None:
    """Write windowed features of one window tag into the datapool at ``path``."""
    store_partitions(
        features.withColumns({"ws": F.lit(ws), "day": F.col("window_start").cast("date")}), path
    )


def read_stored(spark: SparkSession, path: str, entries) -> DataFrame:
    """The pool's rows as its files keep them, with where landed ones come from."""
    return spark.read.schema(stored_schema(entries)).parquet(path)


def read_datapool(spark: SparkSession, path: str) -> DataFrame:
    """The datapool at ``path`` with the features of all its protocols.

    The schema is that of the manifest, so no file is opened to find it. A feature is
    NULL in the rows of protocols without it; one that was written in several types is
    read in a type for all of them.
    """
    entries = read_manifest(spark, path)
    if not entries:
        return spark.read.parquet(path)
    return logical(read_stored(spark, path, entries), entries)


def datapool_scan(
    pool: DataFrame,
    protocols: Sequence[str] | None,
    ws: str,
    columns: Sequence[str] | None = None,
    time_range: str | DayRange | None = None,
    excluded: Sequence[str | DayRange] = (),
) -> DataFrame:
    """Rows of the given protocols (None: all), window tag and days, with the given
    features.

    All filters are on partition columns, so they prune folders, and the column
    list prunes the Parquet read. A column that one of the protocols does not have under
    this tag is an error, even if others have it; a protocol the pool does not have gives
    no rows. A frame that was not read by `read_datapool` does not know its protocols:
    there a column that no file has is an error unless nothing is selected at all.
    """
    kept = pool.where(F.col("ws") == ws)
    if protocols is not None:
        kept = kept.where(F.col("protocol").isin(*protocols))
    if time_range is not None:
        kept = kept.where(time_range_filter(time_range))
    if excluded:
        kept = kept.where(~covered_by_any(F.col("day"), list(excluded)))
    if columns is None:
        return kept
    names = list(dict.fromkeys(["protocol", "day", *WINDOW_KEYS, *columns]))
    unknown = [c for c in names if c not in kept.columns]
    missing = lacking(pool, protocols, ws, columns)
    if missing:
        raise ValueError("; ".join(f"{protocol} ({ws}) has no columns {names}" for protocol, names in missing.items()))
    if missing is None and unknown and kept.select("day").head(1):
        raise ValueError(f"the datapool has no columns {unknown}; read it with read_datapool to have those of all protocols")
    return kept.select(*[c if c not in unknown else F.lit(None).cast("double").alias(c) for c in names])


def time_range_filter(time_range: str | DayRange, day: str = "day"):
    """Predicate for ``<a,b)`` style ranges, evaluated on the day."""
    return DayRange.of(time_range).covers(F.col(day))


def ranges_from_text(spark: SparkSession, texts: Sequence[str] | str, inclusive_end: bool = True) -> DataFrame:
    """Partial-date ranges (``2019``, ``2019-01--2019-03-05``, comma lists) as a
    table ``(begin, end)``; the exclusive form leaves its end day out."""
    items = texts.split(",") if isinstance(texts, str) else texts
    begin, end = partial_date_bounds(F.col("text"), inclusive_end)
    given = spark.createDataFrame([(t,) for t in items], "text string")
    last = end if inclusive_end else F.date_sub(end, 1)
    return given.select(begin.alias("begin"), last.alias("end")).dropna()


def in_ranges(df: DataFrame, ranges: DataFrame, day: str = "day", keep: bool = True) -> DataFrame:
    """Rows whose day lies in any of the ranges ``(begin, end)``, or in none.

    The ranges are turned into the days they cover, so this is an equi-join with
    a table no longer than the calendar they span, however many ranges there are.
    """
    days = ranges.where("begin <= end").select(F.explode(F.sequence("begin", "end")).alias(day)).distinct()
    return df.join(days, day, "left_semi" if keep else "left_anti")


def parse_spec(spec: str | Sequence[dict]) -> tuple[list[dict], list[str]]:
    """Split ``p1|c1|c2~new;p2|c3#k1,k2`` into protocol entries and merge keys.

    Each entry is ``{"protocol": name, "columns": {source: output}}``. A list of
    such entries is a spec, too; its merge keys are the window's, or those of a
    last entry ``{"keys": [...]}``.
    """
    if not isinstance(spec, str):
        entries = list(spec)
        keys = entries.pop()["keys"] if entries and "keys" in entries[-1] else WINDOW_KEYS
        return entries, list(keys)
    *head, last = spec.strip().split(";")
    last, _, keys = last.partition("#")
    entries = []
    for text in [*head, last]:
        protocol, *columns = [part.strip() for part in text.split("|")]
        renames = (re.split(r"\s*~\s*", c, maxsplit=1) for c in columns)
        entries.append({"protocol": protocol, "columns": {r[0]: r[-1] for r in renames}})
    return entries, [k.strip() for k in keys.split(",") if k.strip()]


def convert_units(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Divide columns named ``*_kb``, ``*_mb``, ``*_gb`` down from bytes, truncating."""
    names = df.columns if columns is None else columns
    divisors = {c: suffix_divisor(c) for c in names if suffix_divisor(c)}
    return df.withColumns({c: truncated_units(F.col(c), d) for c, d in divisors.items()})


def protocol_join(frames: Sequence[DataFrame], keys: Sequence[str] = WINDOW_KEYS) -> DataFrame:
    """Inner-join protocol frames on the merge keys, left to right."""
    return reduce(lambda left, right: left.join(right, list(keys), "inner"), frames)


def select_series(
    pool: DataFrame,
    spec: str | Sequence[dict],
    ws: str,
    time_range: str | DayRange | None = None,
    excluded: Sequence[str | DayRange] = (),
    fill_gaps: bool = True,
) -> DataFrame:
    """The multivariate series a spec describes: scan, fill gaps, rename, convert
    units, join. Columns are the merge keys followed by the selected features."""
    entries, keys = parse_spec(spec)
    if len(entries) > 1 and not keys:
        raise ValueError("a spec with several protocols needs merge keys after '#'")
    outputs = [name for e in entries for name in e["columns"].values()]
    repeated = {c for c in outputs if outputs.count(c) > 1 or c in keys}
    if repeated:
        raise ValueError(f"column names must be distinct, rename with '~': {sorted(repeated)}")
    frames = []
    for entry in entries:
        sources = list(entry["columns"])
        frame = datapool_scan(pool, [entry["protocol"]], ws, sources, time_range, excluded)
        if fill_gaps:
            frame = gap_fill(frame, parse_window_tag(ws)[1])
        renamed = frame.select(
            *(keys or ["window_start"]), *[F.col(s).alias(o) for s, o in entry["columns"].items()]
        )
        frames.append(convert_units(renamed, list(entry["columns"].values())))
    return protocol_join(frames, keys)


def spec_key(
    source: str,
    spec: str | Sequence[dict],
    ws: str,
    time_range: str | DayRange | None,
    excluded: Sequence[str | DayRange],
    fill_gaps: bool = True,
) -> str:
    """Hash that names a selected dataset. Source and column order are part of it."""
    entries, keys = parse_spec(spec)
    ranges = [str(DayRange.of(r)) for r in ([time_range] if time_range else [])]
    parts = [source, entries, keys, ws, ranges, sorted(str(DayRange.of(r)) for r in excluded), fill_gaps]
    return hashlib.md5(repr(parts).encode("utf-8")).hexdigest()


def cached_series(
    spark: SparkSession,
    pool_path: str,
    spec: str | Sequence[dict],
    ws: str,
    cache_root: str,
    time_range: str | DayRange | None = None,
    excluded: Sequence[str | DayRange] = (),
    fill_gaps: bool = True,
) -> DataFrame:
    """:func:`select_series` stored as Parquet under the hash of its spec.

    A second call with the same arguments and an unchanged pool reads the
    stored table.
    """
    version = path_version(spark, pool_path)
    target = f"{cache_root.rstrip('/')}/{spec_key(version, spec, ws, time_range, excluded, fill_gaps)}"
    if not path_exists(spark, f"{target}/_SUCCESS"):
        pool = read_datapool(spark, pool_path)
        select_series(pool, spec, ws, time_range, excluded, fill_gaps).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
