"""Windowed feature extraction on a stream of events.

Three stateful steps, none of which holds an overlapping window per entity: events
are combined by (pane, series, entity); an arbitrary stateful step keeps the last
pane of each (series, entity) and says to how many windows a sighting is new; windows
add these numbers up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import gcd

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from tidegauge.functions.times import epoch_seconds, from_epoch_seconds, parse_window_tag
from tidegauge.operators.windows import entity_columns

#: State off the heap, and batches that upload what changed instead of whole snapshots.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Sightings(StatefulProcessor):
    """Adds to each pane of an entity how many panes ago it was last seen.

    The state is the number of that pane, one long per entity, and one timer clears
    it when no window can hold both it and a later pane. Panes of a key come in the
    order of time: a batch closes all panes up to its watermark, and rows of one batch
    are sorted here.
    """

    def __init__(self, columns: Sequence[str], length: int, pane: int):
        self.columns, self.length, self.pane = list(columns), length, pane

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _forgotten_at(self, at: int) -> int:
        return (at + self.length) * self.pane * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        last = None if known is None else known[0]
        for row in sorted(rows, key=lambda r: r["_at"]):
            reach = self.length if last is None else min(row["_at"] - last, self.length)
            last = row["_at"]
            yield Row(**{c: row[c] for c in self.columns}, _reach=reach)
        due = self._forgotten_at(last)
        # What no open window holds is not stored; when catching up that is most of it.
        if due > timerValues.getCurrentWatermarkInMs():
            self.last.update((last,))
            if known is None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known is not None:
            due = self._forgotten_at(known[0])
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
            else:
                self.handle.registerTimer(due)
        return iter(())

    def close(self) -> None:
        pass


def stream_window_features(
    events: DataFrame,
    tag: str,
    ts: str = "ts",
    by: Sequence[str] = ("protocol",),
    count: str = "n",
    distinct: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """The features of :func:`~tidegauge.operators.windows.window_features` for a
    streaming frame; append mode emits a window once the watermark passed it.

    Events are first combined by (pane, series, entity), so state does not grow with
    the overlap of windows and a busy series or entity is spread over all tasks. A
    closed pane of an entity is new to the windows that start after the entity was last
    seen (:class:`Sightings`), so the exact distinct count of a window is a sum and
    its state a few numbers per (window, series). With distinct counts the stream needs
    the RocksDB state store; :func:`run_to_table` sees to it.
    """
    length, slide = parse_window_tag(tag)
    pane = gcd(length, slide)
    by, distinct, sums = list(by), distinct or {}, sums or {}
    totals = [f"_sum_{name}" for name in sums]
    # Event time has to be an instant; going through seconds keeps the zone out of it.
    timed = events.withColumn(ts, F.timestamp_seconds(epoch_seconds(F.col(ts)))).withWatermark(ts, delay)
    rows = timed.select(
        ts, *by, *entity_columns(distinct), *[F.col(source).alias(total) for total, source in zip(totals, sums.values())]
    )
    panes = rows.groupBy(F.window(ts, f"{pane} seconds"), *by, "_which", "_entity").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(total).alias(total) for total in totals]
    )
    at = (F.unix_seconds("window.start") / pane).cast("bigint")
    panes = panes.select(
        F.window_time("window").alias("_time"), at.alias("_at"), *by, "_which", F.col("_entity").isNotNull().alias("_known"),
        "_n", *totals, *(["_entity"] if distinct else []),
    )
    if distinct:
        columns = [c for c in panes.columns if c != "_entity"]
        fields = [StructField(f.name, f.dataType) for f in panes.select(*columns).schema]
        panes = panes.groupBy(*by, "_which", "_entity").transformWithState(
            Sightings(columns, length // pane, pane), StructType([*fields, StructField("_reach", LongType())]),
            "append", "eventTime", eventTimeColumnName="_time",
        )
    window = F.window("_time", f"{length} seconds", f"{slide} seconds")
    spread = panes.withColumn("window", window)
    once = F.col("_which") == 0
    is_new = F.col("_known") & (F.col("_at") - (F.unix_seconds("window.start") / pane).cast("bigint") < F.col("_reach")) if distinct else None
    result = spread.groupBy("window", *by).agg(
        F.sum(F.when(once, F.col("_n"))).alias(count),
        *[F.count_if((F.col("_which") == k) & is_new).alias(name) for k, name in enumerate(distinct)],
        *[F.sum(F.when(once, F.col(total))).alias(name) for name, total in zip(sums, totals)],
    )
    return result.select(
        *by,
        from_epoch_seconds(F.unix_seconds("window.start")).alias("window_start"),
        from_epoch_seconds(F.unix_seconds("window.end")).alias("window_end"),
        count,
        *distinct,
        *sums,
    )


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session is left as it was."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_to_table(features: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available, append closed windows to a Parquet table and read it."""
    with _state_in_rocksdb(features.sparkSession):
        query = (
            features.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return features.sparkSession.read.schema(features.schema).parquet(path)
