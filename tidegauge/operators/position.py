"""Order without a single partition: dense positions, neighbours and scans.

A window ordered over a whole series would sort that series in one task. The
helpers here give every row a dense position ``t`` from per-bucket counts, and
then work on blocks of consecutive positions, so the largest group any task
sees is one bucket or one block no matter how long a series is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 20_000


def with_position(
    df: DataFrame,
    by: Sequence[str] = ("protocol",),
    order: str = "window_start",
    bucket: Column | None = None,
    position: str = "t",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by ``order``.

    Rows are numbered inside ``(series, bucket)`` and shifted by the number of
    rows in earlier buckets. The bucket defaults to the day of ``order``, which
    for one row per window holds at most a day's worth of slides; pass a finer
    column for denser data (it must grow with ``order``). ``total`` names an
    optional column for the length of the series. ``df`` is read twice, for the counts and
    for the rows.
    """
    by = list(by)
    bucketed = df.withColumn("_bucket", F.col(order).cast("date") if bucket is None else bucket)
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per series and bucket from here: the prefix sum is over counts only.
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        *([F.sum("_rows").over(Window.partitionBy(*by)).alias(total)] if total else []),
    )
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(order)
    return (
        bucketed.withColumn("_in_bucket", F.row_number().over(in_bucket))
        .join(offsets, [*by, "_bucket"])
        .withColumn(position, (F.col("_offset") + F.col("_in_bucket") - 1).cast("bigint"))
        .drop("_bucket", "_in_bucket", "_offset")
    )


def with_neighbours(
    df: DataFrame,
    columns: dict[str, Column],
    back: int,
    ahead: int = 0,
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Evaluate lag/lead expressions over blocks of positions.

    ``columns`` maps names to functions of a window specification built with
    :func:`before` and :func:`after`, reaching at most ``back`` rows behind and
    ``ahead`` rows forward. Thanks to the copies made by :func:`in_blocks` the
    result equals a window over the whole series; the copies are dropped.
    """
    blocked, own = in_blocks(df, back, ahead, position, block_rows)
    spec = Window.partitionBy(*by, "_block").orderBy(position)
    return blocked.withColumns({name: make(spec) for name, make in columns.items()}).where(own).drop("_block")


def in_blocks(
    df: DataFrame, back: int, ahead: int = 0, position: str = "t", block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, Column]:
    """Assign rows to blocks of consecutive positions, in column ``_block``.

    Each block also receives copies of the ``back`` rows ahead of it and the
    ``ahead`` rows behind it, ``(back + ahead)`` extra rows per block. The
    second result is true for a block's own rows.
    """
    size = max(block_rows, back + ahead, 1)
    home = F.floor(F.col(position) / size).cast("bigint")
    offset = F.pmod(F.col(position), F.lit(size))
    homes = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - back, home + 1),
            F.when((offset < ahead) & (home > 0), home - 1),
        )
    )
    return df.withColumn("_block", F.explode(homes)), home == F.col("_block")


def before(column: str | Column, steps: int = 1):
    """Value ``steps`` rows earlier, for :func:`with_neighbours`."""
    return lambda spec: F.lag(column, steps).over(spec)


def after(column: str | Column, steps: int = 1):
    """Value ``steps`` rows later, for :func:`with_neighbours`."""
    return lambda spec: F.lead(column, steps).over(spec)


def with_nearest(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("protocol",),
    position: str = "t",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each column add the last non-NULL cell at or before the row and the
    first one at or after it, as structs ``(at, value)`` named ``_prev_<c>``
    and ``_next_<c>``.

    Inside a block this is an ordinary window. What a block needs from outside
    is one cell per side, taken from a table with one row per block.
    """
    by = list(by)
    block = F.floor(F.col(position) / block_rows).cast("bigint")
    cells = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("at"), F.col(c).alias("value"))) for c in columns}
    blocked = df.withColumn("_block", block)
    ends = blocked.groupBy(*by, "_block").agg(
        *[F.max_by(cells[c], F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_tail_{c}") for c in columns],
        *[F.min_by(cells[c], F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_head_{c}") for c in columns],
    )
    blocks_before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks_after = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *by,
        "_block",
        *[F.last(f"_tail_{c}", ignorenulls=True).over(blocks_before).alias(f"_tail_{c}") for c in columns],
        *[F.last(f"_head_{c}", ignorenulls=True).over(blocks_after).alias(f"_head_{c}") for c in columns],
    )
    so_far = Window.partitionBy(*by, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, because a frame that grows at its far end is recomputed for every row.
    to_come = Window.partitionBy(*by, "_block").orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumns(
        {f"_prev_{c}": F.last(cells[c], ignorenulls=True).over(so_far) for c in columns}
        | {f"_next_{c}": F.last(cells[c], ignorenulls=True).over(to_come) for c in columns}
    )
    return (
        inside.join(carried, [*by, "_block"])
        .withColumns(
            {f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_tail_{c}") for c in columns}
            | {f"_next_{c}": F.coalesce(f"_next_{c}", f"_head_{c}") for c in columns}
        )
        .drop("_block", *[f"_tail_{c}" for c in columns], *[f"_head_{c}" for c in columns])
    )


def decay_block_rows(*decays: float, limit: int = BLOCK_ROWS) -> int:
    """Largest block in which ``decay ** -rows`` stays well inside a double."""
    rows = limit
    for decay in decays:
        if 0 < decay < 1:
            rows = min(rows, int(200 * math.log(10) / -math.log(decay)))
    return max(rows, 1)
