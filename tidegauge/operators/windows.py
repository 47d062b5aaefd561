"""Windowed feature extraction: raw events to counts, distinct counts and sums
per series and sliding or tumbling window."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.times import epoch_seconds, from_epoch_seconds, parse_window_tag


def window_features(
    events: DataFrame,
    tag: str,
    ts: str = "ts",
    by: Sequence[str] = ("protocol",),
    count: str = "n",
    distinct: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Aggregate events into the windows named by ``tag`` (``w01h-s10m``).

    ``distinct`` and ``sums`` map output columns to source columns. Windows are
    aligned to the epoch.

    Sliding windows overlap, so expanding every event into all its windows
    would multiply the raw data. Instead events are first combined into panes
    (the common divisor of length and slide), and only pane summaries are
    spread over windows. Counts and sums need no entity and are combined by pane.
    For a distinct count each pane of an entity knows how far back the entity was
    last seen: it is new to exactly those windows that start after the previous
    sighting, so per-window distinct counts become a plain sum and no (window,
    entity) pairs are ever shuffled. Every distinct count reads its own column.
    """
    length, slide = parse_window_tag(tag)
    pane = gcd(length, slide)
    by, distinct, sums = list(by), distinct or {}, sums or {}
    totals = [f"_sum_{name}" for name in sums]

    seconds = epoch_seconds(F.col(ts))
    timed = events.where(F.col(ts).isNotNull()).withColumn("_at", (seconds - F.pmod(seconds, F.lit(pane))) / F.lit(pane))
    timed = timed.withColumn("_at", F.col("_at").cast("bigint"))
    panes = timed.groupBy(*by, "_at").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(source).alias(total) for total, source in zip(totals, sums.values())]
    )
    for which, source in enumerate(distinct.values()):
        seen = new_sightings(timed.select(*by, "_at", F.col(source).alias("_entity")), by, length // pane)
        panes = panes.unionByName(seen.withColumn("_which", F.lit(which)), allowMissingColumns=True)
    panes = panes.withColumn("_pane", F.col("_at") * pane)

    # Window starts are the multiples of the slide in (pane - length, pane].
    before = F.col("_pane") - length
    first = before - F.pmod(before, F.lit(slide)) + slide
    last = F.col("_pane") - F.pmod(F.col("_pane"), F.lit(slide))
    spread = (
        panes.withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("_start", F.explode(F.sequence("_first", "_last", F.lit(slide).cast("bigint"))))
    )
    is_new = F.col("_pane") - F.col("_start") < F.col("_reach") * pane if distinct else None
    result = spread.groupBy(*by, "_start").agg(
        F.sum("_n").alias(count),
        *[
            F.sum(F.when((F.col("_which") == k) & is_new, F.col("_new")).otherwise(0)).alias(name)
            for k, name in enumerate(distinct)
        ],
        *[F.sum(total).alias(name) for name, total in zip(sums, totals)],
    )
    return result.select(
        *by,
        from_epoch_seconds(F.col("_start")).alias("window_start"),
        from_epoch_seconds(F.col("_start") + length).alias("window_end"),
        count,
        *distinct,
        *sums,
    )


#: Panes of one chunk: a bit each in a long.
CHUNK = 64


def new_sightings(rows: DataFrame, by: Sequence[str], length: int) -> DataFrame:
    """How many entities a pane has that were last seen ``_reach`` panes before, or not
    within ``length`` panes: ``_at, _reach, _new`` per series.

    ``rows`` have the series, the number of the pane and the entity. The panes in which
    an entity is seen become bits of a chunk of time, combined on the map side, so one
    shuffle moves a row per entity and chunk, however often it is seen, and no group
    grows with an entity. Sightings near the end of a chunk also go to those after it
    that they reach, where only the last one before the chunk is kept.
    """
    by = list(by)
    at, chunk = F.col("_at"), F.col("_chunk")
    own = ((at - F.pmod(at, F.lit(CHUNK))) / CHUNK).cast("bigint")
    upto = at + (length - 1)
    last = ((upto - F.pmod(upto, F.lit(CHUNK))) / CHUNK).cast("bigint")
    reached = F.when(last == F.col("_own"), F.array("_own")).otherwise(F.sequence("_own", last))
    reached = rows.where(F.col("_entity").isNotNull()).withColumn("_own", own).withColumn("_chunk", F.explode(reached))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(_at, {CHUNK}) AS INT))")
    inside = chunk == F.col("_own")
    chunks = reached.groupBy(*by, "_entity", "_chunk").agg(
        F.bit_or(F.when(inside, bit)).alias("_bits"), F.max(F.when(~inside, at)).alias("_before")
    )
    first = chunk * CHUNK
    bits = F.col("_bits")
    each = F.filter(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.call_function("bit_get", bits, i) == 1)
    # Most entities are seen in one pane of a chunk: its number is that of the highest bit.
    seen = F.when(F.bit_count(bits) == 1, F.array(F.length(F.bin(bits)) - 1)).otherwise(each)
    placed = chunks.where(bits.isNotNull()).withColumn("_seen", seen)
    before = F.coalesce(F.col("_before") - first, F.lit(-length).cast("bigint"))
    found = placed.select(*by, first.alias("_first"), before.alias("_last_before"), "_seen", F.posexplode("_seen").alias("_k", "_i"))
    gap = F.col("_i") - F.when(F.col("_k") == 0, F.col("_last_before")).otherwise(F.get("_seen", F.col("_k") - 1))
    sightings = found.select(*by, (F.col("_first") + F.col("_i")).alias("_at"), F.least(gap, F.lit(length)).alias("_reach"))
    return sightings.groupBy(*by, "_at", "_reach").agg(F.count(F.lit(1)).alias("_new"))


def entity_columns(distinct: dict[str, str]) -> list[Column]:
    """``_which`` and ``_entity``: one row per event and distinct count."""
    if len(distinct) > 1:
        return [F.posexplode(F.array(*[F.col(c).cast("string") for c in distinct.values()])).alias("_which", "_entity")]
    entity = F.col(*distinct.values()) if distinct else F.lit(None).cast("string")
    return [F.lit(0).alias("_which"), entity.alias("_entity")]
