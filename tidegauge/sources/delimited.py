"""Tab-separated and other delimited text."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.numeric import BYTES_DIVISOR, BYTES_MARK, truncated_units, zero_if_missing
from tidegauge.operators.repair import gap_fill
from tidegauge.session import materialise


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    header: bool | int = True,
    columns: str | Sequence[str | int] | None = None,
    schema: T.StructType | None = None,
    gap_slide_seconds: int | None = None,
    skip_rows: int = 0,
    skip_footer: int = 0,
) -> DataFrame:
    """Read delimited text as strings, optionally keeping only some columns.

    In every file the first ``skip_rows`` and the last ``skip_footer`` lines are
    left out; ``header`` may be the number (from 0) of the line after those
    that names the columns, with the lines above it left out, too. Files must
    then have one row per line.

    ``columns`` mixes names and 0-based positions, as a list or as comma
    separated text, and is returned in file order. With ``gap_slide_seconds``
    the rows (which then need ``window_start`` and ``window_end``) are completed
    to a regular grid per day.
    """
    if skip_rows or skip_footer or (not isinstance(header, bool) and header > 0):
        df = _read_trimmed(spark, path, sep, header, schema, skip_rows, skip_footer)
    else:
        # Line number 0 names the columns, too.
        reader = spark.read.option("sep", sep).option("header", header is not False).option("escape", '"')
        df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if columns is not None:
        wanted = columns.split(",") if isinstance(columns, str) else list(columns)
        wanted = [c.strip() if isinstance(c, str) else c for c in wanted]
        names = {df.columns[int(c)] if str(c).lstrip("-").isdigit() else c for c in wanted}
        missing = names - set(df.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        df = df.select(*[c for c in df.columns if c in names])
    if gap_slide_seconds is not None:
        if not {"window_start", "window_end"} <= set(df.columns):
            raise ValueError("gap filling needs window_start and window_end")
        keys = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
        df = gap_fill(df.withColumns(keys), gap_slide_seconds, by=()).drop("day")
    return df


def _read_trimmed(
    spark: SparkSession, path: str, sep: str, header: bool | int, schema: T.StructType | None, skip_rows: int, skip_footer: int
) -> DataFrame:
    """Rows between the leading and trailing lines of every file.

    A line's number is its rank in the piece of the file one task reads, plus
    the lines of the pieces before: only a row per piece is counted and joined.
    Lines are stored with their piece and rank first, so a later scan that Spark
    splits in other places can't number them differently.
    """
    named = header is not False
    first = skip_rows + (int(header) if not isinstance(header, bool) else 0)
    piece = ["_file", "_from"]
    scanned = spark.read.text(path).select(
        F.col("value").alias("_line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_id"),
    )
    lines = materialise(scanned, "lines")
    pieces = lines.groupBy(*piece).agg(F.min("_id").alias("_first_id"), F.count(F.lit(1)).alias("_lines"))
    in_file = Window.partitionBy("_file")
    placed = pieces.withColumns(
        {
            "_before": F.sum("_lines").over(in_file.orderBy("_from")) - F.col("_lines"),
            "_total": F.sum("_lines").over(in_file),
        }
    )
    number = F.col("_id") - F.col("_first_id") + F.col("_before")
    numbered = lines.join(placed, piece).select("_file", "_line", number.alias("_number"), "_total")
    top = numbered.where(F.col("_number") == first).orderBy("_file").select("_line").head()
    options = {"sep": sep, "escape": '"'}
    if schema is None:
        cells = next(csv.reader([top["_line"]], delimiter=sep)) if top else []
        names = cells if named else [f"_c{k}" for k in range(len(cells))]
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    kept = numbered.where(
        (F.col("_number") >= first + (1 if named else 0))
        & (F.col("_number") < F.col("_total") - skip_footer)
        & (F.trim("_line") != "")
    )
    if not schema.fields:
        return kept.select()
    return kept.select(F.from_csv("_line", _ddl(schema), options).alias("_r")).select("_r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def load_numeric_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a feature TSV as numbers: cells that are not finite numbers become
    0 and columns with ``_bytes`` in their name become whole MiB."""
    text = read_delimited(spark, path, schema=schema)
    return text.select(
        *[
            (
                truncated_units(zero_if_missing(F.col(c)), BYTES_DIVISOR)
                if BYTES_MARK in c
                else zero_if_missing(F.col(c))
            ).alias(c)
            for c in text.columns
        ]
    )


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a frame as TSV with a header line in every part file."""
    (
        df.write.mode(mode)
        .option("sep", "\t")
        .option("header", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )
