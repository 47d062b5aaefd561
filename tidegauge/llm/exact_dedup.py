"""Exact duplicates against an immutable snapshot screened by binary fuse filters.

A snapshot is a stored table of exact buckets (one row per distinct text) with a
static three-way binary fuse filter per shard of its digests. Incoming rows are
grouped among themselves first; each distinct incoming digest then meets the
filter of its shard. Negatives are groups of their own at once. Only positives are
joined with the snapshot's buckets, where the bytes of one representative of each
side are compared; a match makes one group of the bucket and the incoming rows.

A null text counts as empty. Of equal texts the row with the largest doc_id
stays; if that very row is repeated, one of the repetitions does. Rows without a
doc_id stay only if their whole group has none. An empty table gives an empty
result, extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import query, table, text_of
from tidegauge.session import materialise

#: Digests of one filter; a snapshot gets as many shards as it needs.
SHARD_KEYS = 50_000
FILTER_SCHEMA = "shard long, seed long, segment_length long, segment_count long, slots binary"


def _places(keys: np.ndarray, seed: int, length: int, count: int):
    """The three slots of each key, in consecutive segments, and its eight-bit mark."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(33)
    first = ((h >> np.uint64(32)) * np.uint64(length * count)) >> np.uint64(32)
    within = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & within)
    third = (first + np.uint64(2 * length)) ^ (h & within)
    mark = ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), mark


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, number of segments and slots for distinct uint64 keys.

    All slots with a single key are peeled at once, round by round; marks are
    then set in the opposite order.
    """
    n = max(2, len(keys))
    length = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
    capacity = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    count = max(1, -(-capacity // length) - 2)
    size = (count + 2) * length
    for seed in range(1, 200):
        slots3, mark = _places(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64), length, count)
        used = np.bincount(slots3.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        for s in slots3:
            np.bitwise_xor.at(who, s, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(used == 1)
            key, at = np.unique(who[single], return_index=True)
            if not len(key):
                break
            rounds.append((key, single[at]))
            left -= len(key)
            for s in slots3[:, key]:
                np.subtract.at(used, s, 1)
                np.bitwise_xor.at(who, s, key)
        if not left:
            slots = np.zeros(size, np.uint8)
            for key, own in reversed(rounds):
                slots[own] = 0
                slots[own] = mark[key] ^ slots[slots3[0, key]] ^ slots[slots3[1, key]] ^ slots[slots3[2, key]]
            return seed * 0x9E3779B97F4A7C15 % (1 << 64), length, count, slots.tobytes()
    raise RuntimeError("no seed peels these keys; are they distinct?")


def may_contain(keys: np.ndarray, seed: int, length: int, count: int, slots: bytes) -> np.ndarray:
    """False only for keys that are certainly not in the filter."""
    places, mark = _places(keys, seed, length, count)
    held = np.frombuffer(slots, np.uint8)
    return mark == held[places[0]] ^ held[places[1]] ^ held[places[2]]


def with_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_bytes`` and whatever else the frame has; digest is the SHA-256 of the text."""
    data = F.encode(text_of(), "UTF-8")
    return docs.withColumns({"digest": F.unhex(F.sha2(data, 256)), "n_bytes": F.octet_length(data).cast("long")})


def _grouped(marked: DataFrame) -> DataFrame:
    return marked.groupBy("digest", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumns({"key": key, "shard": F.pmod(F.xxhash64(key), F.lit(shards))})


@dataclass
class Snapshot:
    """Immutable: exact buckets, their filters, the number of shards, and the rows' texts."""

    buckets: DataFrame
    filters: DataFrame
    shards: int
    docs: DataFrame


def build_snapshot(marked: DataFrame, docs: DataFrame) -> Snapshot:
    """Store buckets and filters of ``marked`` (rows with digests); ``docs`` has their texts."""
    buckets = materialise(_grouped(marked), "buckets")
    shards = max(1, -(-buckets.count() // SHARD_KEYS))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(group["key"].to_numpy(np.int64).view(np.uint64))
        seed, length, count, slots = build_filter(keys)
        signed = seed - (1 << 64) if seed >= 1 << 63 else seed
        return pd.DataFrame([(group["shard"].iloc[0], signed, length, count, slots)], columns=["shard", "seed", "segment_length", "segment_count", "slots"])

    filters = _sharded(buckets, shards).groupBy("shard").applyInPandas(make, FILTER_SCHEMA)
    return Snapshot(buckets, materialise(filters, "filters"), shards, docs)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``groups`` with ``maybe``: whether the digest may be in the snapshot."""

    def test(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(maybe=False)
        for f in filters.itertuples():
            keys = own["key"].to_numpy(np.int64).view(np.uint64)
            own["maybe"] = may_contain(keys, f.seed % (1 << 64), f.segment_length, f.segment_count, f.slots)
        return own

    keyed = _sharded(groups, snapshot.shards)
    schema = f"{', '.join(f'{n} {t}' for n, t in keyed.dtypes)}, maybe boolean"
    return keyed.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInPandas(test, schema).drop("key", "shard")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Text of the row that stands for each digest."""
    rows = with_digests(docs.select("doc_id", "text")).select("doc_id", "digest", text_of().alias("text"))
    wanted = rows.join(ids.select(F.col("keep_id").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    return wanted.groupBy("digest").agg(F.first("text").alias("text"))


def matched(positives: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Incoming groups next to the bucket of their digest, false positives left out."""
    old = snapshot.buckets.select("digest", "n_bytes", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    new = positives.select("digest", "n_bytes", F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    return new.join(old, ["digest", "n_bytes"])


def differing(incoming: DataFrame, pairs: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Digests of matched groups whose bytes differ from the bucket of the same digest."""
    new = _texts(incoming, pairs.select("digest", F.col("new_id").alias("keep_id")))
    old = _texts(snapshot.docs, pairs.select("digest", F.col("old_id").alias("keep_id")))
    both = new.join(old.withColumnRenamed("text", "old_text"), "digest")
    return both.where("text <> old_text").select("digest")


def exact_duplicates(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Group ``incoming`` rows with those ``held`` in an immutable snapshot.

    Both need ``doc_id, text``. Returns a row per row of either: ``doc_id, digest,
    keep_id, group_size, kept``.
    """
    old_rows = materialise(with_digests(held).select("doc_id", "digest", "n_bytes"), "held")
    new_rows = materialise(with_digests(incoming).select("doc_id", "digest", "n_bytes"), "incoming")
    snapshot = build_snapshot(old_rows, held)
    new = materialise(screen(_grouped(new_rows), snapshot), "screened")
    positives, negatives = (new.where(c).drop("maybe") for c in ("maybe", "NOT maybe"))
    pairs = materialise(matched(positives, snapshot), "pairs")
    # A digest collision, should there ever be one, keeps the two sides' groups apart.
    apart = materialise(differing(incoming, pairs, snapshot), "apart")
    old_stays = F.col("old_id").eqNullSafe(F.greatest("old_id", "new_id"))
    joint = pairs.join(apart, "digest", "left_anti").select(
        "digest", "n_bytes", F.greatest("old_id", "new_id").alias("joint_id"), (F.col("old_size") + F.col("new_size")).alias("joint_size"), old_stays.alias("old_stays")
    )

    def together(groups: DataFrame, side: int) -> DataFrame:
        """Groups of one side, those of a match as one with the other side's."""
        is_joint = F.col("joint_size").isNotNull()
        return groups.join(joint, ["digest", "n_bytes"], "left").select(
            "digest", "n_bytes", F.lit(side).alias("side"),
            F.when(is_joint, F.col("joint_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("joint_size", "group_size").alias("group_size"),
            # The side that the row that stays belongs to, should both have that doc_id.
            (~is_joint | (F.col("old_stays") == F.lit(side == 0))).alias("owner"),
        )

    alone = negatives.select("digest", "n_bytes", F.lit(1).alias("side"), "keep_id", "group_size", F.lit(True).alias("owner"))
    groups = together(snapshot.buckets, 0).unionByName(together(positives, 1)).unionByName(alone)
    rows = old_rows.withColumn("side", F.lit(0)).unionByName(new_rows.withColumn("side", F.lit(1)))
    # Repeated rows are counted first and told apart by their number.
    counted = rows.groupBy("doc_id", "digest", "n_bytes", "side").agg(F.count(F.lit(1)).alias("copies"))
    numbered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1) & F.col("owner")
    return numbered.join(groups, ["digest", "n_bytes", "side"]).select("doc_id", "digest", "keep_id", "group_size", stays.alias("kept"))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a table into a snapshot and a batch that comes in after it."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return docs.where(~held), docs.where(held)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_duplicates(*halves(docs)).where("kept").select("doc_id", "digest")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))
    marked = with_digests(rows).select("row", "doc_id", "digest")
    same = marked["doc_id"].eqNullSafe(kept["doc_id"]) & (marked["digest"] == kept["digest"])
    found = marked.join(kept, same, "left_semi")
    # Repeated rows are the only ones left to choose from here.
    first = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.lit(1)))
    return found.withColumn("copy", first).where("copy = 1").select("row.*")


@query(
    "op5_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
       SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
              doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
       FROM d""",
)
def op5(spark, sf_dir):
    found = exact_duplicates(*halves(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
