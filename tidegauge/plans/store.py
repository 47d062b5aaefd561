"""Model store: a folder per model with the fitted pipeline and one row of metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans.forecaster import Forecaster, Settings

METADATA_SCHEMA = """
    name string, created_at timestamp, spec string, ws string,
    train_range string, train_excluded array<string>,
    test_range string, test_excluded array<string>,
    settings string, series_keys array<string>,
    bounds array<struct<feature: string, input_lo: double, input_hi: double,
                        target_lo: double, target_hi: double>>,
    metrics array<struct<feature: string, metric: string, value: double>>,
    training_seconds double
"""


def save_model(
    spark: SparkSession,
    forecaster: Forecaster,
    root: str,
    name: str,
    spec: str = "",
    ws: str = "",
    train_range: str | None = None,
    train_excluded: Sequence[str] = (),
    test_range: str | None = None,
    test_excluded: Sequence[str] = (),
    metrics: Sequence[tuple[str, str, float | None]] = (),
    training_seconds: float | None = None,
) -> str:
    """Write a forecaster with its scaling bounds, ranges and metrics under ``root/name``."""
    path = f"{root.rstrip('/')}/{name}"
    forecaster.model.write().overwrite().save(f"{path}/pipeline")
    bounds = [(c, *forecaster.input_bounds[c], *forecaster.target_bounds[c]) for c in forecaster.columns]
    row = (
        name, None, spec, ws, train_range, list(train_excluded), test_range, list(test_excluded),
        json.dumps(asdict(forecaster.settings)), forecaster.by, bounds, list(metrics), training_seconds,
    )
    described = spark.createDataFrame([row], METADATA_SCHEMA).withColumn("created_at", F.current_timestamp())
    described.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, root: str, name: str) -> tuple[Forecaster, dict]:
    """The stored forecaster and its metadata row as a dictionary."""
    path = f"{root.rstrip('/')}/{name}"
    meta = spark.read.parquet(f"{path}/metadata").head().asDict(recursive=True)
    bounds = meta["bounds"]
    forecaster = Forecaster(
        settings=Settings(**json.loads(meta["settings"])),
        columns=[b["feature"] for b in bounds],
        by=list(meta["series_keys"]),
        input_bounds={b["feature"]: (b["input_lo"], b["input_hi"]) for b in bounds},
        target_bounds={b["feature"]: (b["target_lo"], b["target_hi"]) for b in bounds},
        model=PipelineModel.load(f"{path}/pipeline"),
    )
    return forecaster, meta


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every model stored under ``root``."""
    return spark.read.schema(METADATA_SCHEMA).parquet(f"{root.rstrip('/')}/*/metadata")
