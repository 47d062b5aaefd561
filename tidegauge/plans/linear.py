"""Linear regressions on lag sequences, all outputs from one pass over the series.

A block of rows is reduced to count, means, co-moments and extents of its inputs
and targets; only the series' own columns are shuffled, never the lags.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.position import BLOCK_ROWS, in_blocks

#: Doubles held at a time while a block is reduced.
CHUNK_CELLS = 4_000_000
#: Tasks that add up what the blocks' tasks have added up.
FINAL_TASKS = 8


@dataclass
class Moments:
    """Count, means and co-moments of rows with a known target, and extents:
    of the inputs over all rows, of the targets over known ones."""

    count: float
    mean: np.ndarray
    comoment: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0.0, np.zeros(width), np.zeros((width, width)), np.full(width, np.inf), np.full(width, -np.inf))

    @classmethod
    def unpack(cls, flat: Sequence[float], width: int) -> Moments:
        cells = np.asarray(flat, float)
        mean, comoment, low, high = np.split(cells[1:], np.cumsum([width, width * width, width]))
        return cls(cells[0], mean, comoment.reshape(width, width), low, high)

    def pack(self) -> np.ndarray:
        return np.concatenate([[self.count], self.mean, self.comoment.ravel(), self.low, self.high])

    def add(self, other: Moments) -> None:
        self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        if not other.count:
            return
        total = self.count + other.count
        apart = other.mean - self.mean
        self.comoment = self.comoment + other.comoment + np.outer(apart, apart) * (self.count * other.count / total)
        self.mean = self.mean + apart * (other.count / total)
        self.count = total


def block_moments(x: np.ndarray, own: np.ndarray, length: int, ahead: int, delta: bool) -> Moments:
    """Moments of the samples whose origin is an own row of a block.

    ``x`` has the block's consecutive rows, copies included. The inputs are the
    ``length`` latest values (or changes) of each column, latest first; targets
    follow them, one per column.
    """
    series = x.shape[1]
    back = length if delta else length - 1
    values = np.diff(x, axis=0, prepend=np.nan) if delta else x
    origins = np.flatnonzero(own & (np.arange(len(x)) >= back))
    width = series * (length + 1)
    found = Moments.none(width)
    for part in np.array_split(origins, max(1, -(-len(origins) * width // CHUNK_CELLS))):
        if not len(part):
            continue
        inputs = np.stack([values[part - i] for i in range(length)], axis=2).reshape(len(part), series * length)
        known = part + ahead < len(x)
        targets = x[part[known] + ahead] - (x[part[known]] if delta else 0.0)
        rows = np.hstack([inputs[known], targets])
        mean = rows.mean(axis=0) if len(rows) else np.zeros(width)
        centred = rows - mean
        found.add(
            Moments(
                float(len(rows)), mean, centred.T @ centred,
                np.concatenate([inputs.min(axis=0), targets.min(axis=0, initial=np.inf)]),
                np.concatenate([inputs.max(axis=0), targets.max(axis=0, initial=-np.inf)]),
            )
        )
    return found


def sample_moments(
    series: DataFrame,
    columns: Sequence[str],
    length: int,
    ahead: int,
    delta: bool,
    by: Sequence[str],
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> Moments:
    """Moments of all samples of all series; one shuffle of the plain columns.

    Blocks are added up in the tasks that make them, then in a few more, so the
    driver gets at most :data:`FINAL_TASKS` matrices.
    """
    columns, by = list(columns), list(by)
    back = length if delta else length - 1
    width = len(columns) * (length + 1)
    kept = series.select(*by, position, *[F.col(c).cast("double").alias(c) for c in columns])
    blocked, own = in_blocks(kept, back, ahead, position, block_rows)

    def reduce_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position)
        made = block_moments(rows[columns].to_numpy(), rows["_own"].to_numpy(bool), length, ahead, delta)
        return pd.DataFrame({"moments": [made.pack()]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = summed((flat for batch in batches for flat in batch["moments"]), width)
        yield pd.DataFrame({"moments": [total.pack()]})

    schema = "moments array<double>"
    per_block = blocked.withColumn("_own", own).groupBy(*by, "_block").applyInPandas(reduce_block, schema)
    per_task = per_block.mapInPandas(add_up, schema)
    return summed((r["moments"] for r in per_task.repartition(FINAL_TASKS).mapInPandas(add_up, schema).toLocalIterator()), width)


def summed(flats: Iterable[Sequence[float]], width: int) -> Moments:
    total = Moments.none(width)
    for flat in flats:
        total.add(Moments.unpack(flat, width))
    return total


def ridge(moments: Moments, inputs: int, penalty: float, input_span: np.ndarray, target_span: np.ndarray) -> np.ndarray:
    """Weights per target on inputs scaled by ``input_span``, for targets scaled by
    ``target_span``. The penalty is on standardised inputs, relative to the
    target's deviation. Inputs and targets that do not vary get weight 0."""
    deviation = np.sqrt(np.diag(moments.comoment) / moments.count)
    # Rounding alone must not pass for variation.
    flat = deviation <= 1e-12 * np.maximum(np.abs(moments.low), np.abs(moments.high))
    unit = np.where(flat, 1.0, deviation)
    correlation = moments.comoment / moments.count / np.outer(unit, unit)
    correlation[flat, :] = correlation[:, flat] = 0.0
    weights = []
    for k, target_unit in enumerate(target_span):
        at = inputs + k
        if flat[at]:
            weights.append(np.zeros(inputs))
            continue
        gram = correlation[:inputs, :inputs] + penalty / (deviation[at] / target_unit) * np.eye(inputs)
        solved = np.linalg.lstsq(gram, correlation[:inputs, at], rcond=None)[0]
        weights.append(np.where(flat[:inputs], 0.0, solved * (deviation[at] / target_unit) / (unit[:inputs] / input_span)))
    return np.array(weights)
