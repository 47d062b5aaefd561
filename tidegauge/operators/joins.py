"""Joining a per-series summary back onto its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import materialise

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Keys the sketch follows. One with more than about this share of all rows is always found.
TRACKED = 10_000


def attach(
    rows: DataFrame,
    summary: DataFrame,
    by: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Left-join a summary with one row per key onto ``rows``.

    The summary is written first, so its size is known before the join is
    planned: up to ``broadcast_rows`` and ``broadcast_bytes`` (its cells as text) it is
    broadcast and ``rows`` does not move.

    For a larger one a sketch of the rows per key finds the hot keys, in one more pass
    over ``rows``. A key with a share of the rows is spread over that share of ``salts``
    (by default the shuffle partitions), by a hash of the row, and its summary is
    repeated as often; other keys are joined as they are. Without keys the summary is
    a single row for all.
    """
    by = list(by)
    written = materialise(summary, "summary")
    if not by:  # one row for all
        return rows.withColumn("_all", F.lit(1)).join(F.broadcast(written.limit(1).withColumn("_all", F.lit(1))), "_all", "left").drop("_all")
    held = written.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    if held["n"] <= broadcast_rows and (held["bytes"] or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(written), by, "left")
    if salts is None:
        salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(rows, by, salts)
    key = F.xxhash64(*by)
    spread = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    salted_rows = rows.withColumn("_key", key).join(F.broadcast(hot), "_key", "left").withColumn("_salt", spread).drop("_key", "_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    salted_summary = written.withColumn("_key", key).join(F.broadcast(hot), "_key", "left").withColumn("_salt", each).drop("_key", "_salts")
    return salted_rows.join(salted_summary, [*by, "_salt"], "left").drop("_salt")


def hot_keys(rows: DataFrame, by: Sequence[str], salts: int) -> DataFrame:
    """``_key, _salts`` of the keys that hold more than one of ``salts`` equal parts of the rows.

    ``_key`` is a hash of the columns ``by``. Keys are followed by a sketch of bounded
    size that is combined on the map side; its counts may be short by the share of
    an untracked key, which changes how far a key is spread and never the join. At
    most ``salts`` keys can be that hot.
    """
    sketch = rows.select(F.xxhash64(*by).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {min(salts, TRACKED)}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_rows")
    )
    top = sketch.select("_rows", F.explode("_top").alias("_of"))
    share = F.ceil(F.col("_of.count") * salts / F.col("_rows")).cast("int")
    return materialise(top.select(F.col("_of.item").alias("_key"), share.alias("_salts")).where("_salts > 1"), "hot_keys")
