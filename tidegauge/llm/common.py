"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegauge.session import materialise, scratch_path, shared_dir  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of fixed-size records that one task sorts or probes in memory.
ROWS_PER_TASK = 1_000_000


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame``, with its DuckDB SQL if there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Partitions for so many rows, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


#: Rows of an Arrow batch: whole texts are in them, and tasks share an executor's memory.
TEXTS_PER_BATCH = "1000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's batches for Python are made small enough for texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(TEXTS_PER_BATCH):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return df


def text_of(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows, never more, chosen by a hash of ``key``; all if there are fewer.

    Rows are counted first, so tasks pass on only those below a cutoff.
    """
    total = rows.count()
    if total <= bound:
        return rows
    cutoff = int(2**32 * bound / total * 0.95)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(2**32)) < cutoff).limit(bound)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """Apply ``rows`` to every Arrow batch; it returns the columns of ``schema``."""
    kinds = StructType.fromDDL(schema)
    names = kinds.names
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch)
            if made is not None:
                yield pa.RecordBatch.from_arrays([_column(made[f.name], f.type) for f in arrow], names=names)

    return small_batches(df).mapInArrow(run, schema)


def whole_partition(batches: Iterator, columns: list[str]) -> dict[str, np.ndarray]:
    """All rows of one partition as arrays; partitions are sized by `tasks_for`."""
    parts = [[batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns] for batch in batches if batch.num_rows]
    if not parts:
        return {}
    return {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(columns)}
