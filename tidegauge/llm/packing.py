"""Best-fit packing of documents into sequences of a fixed length.

Pieces are sorted by length, longest first, and gaps by size, both distributed.
Each superstep takes the pieces of one length to the smallest gaps they fit,
their successors in gap order; where many pieces want the same gap, the rank of a
piece among those of its length decides which gap it gets and at which place.
The gaps shrink, and the next length follows.

A sweep needs only how many pieces and gaps there are of each size, so it works
on run lengths: at most ``capacity`` lengths and the runs of gaps, whatever the
number of documents. Ranks, and the place of every piece, come from the whole
distributed tables.

A null or empty text is a document of its end id alone. Repeated rows are packed
each on its own, ties go by doc_id and piece. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.bpe import text_encoder
from tidegauge.llm.common import query, small_batches, table, text_of
from tidegauge.llm.tokens import public_path
from tidegauge.session import materialise

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts encoded at a time in a task.
BATCH = 256


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole ones, after a first one that takes the rest."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def pieces_of(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Ids of every text and its end id, cut into pieces of at most ``capacity``.

    With ``ids`` the piece's ids come along as little-endian 32-bit integers.
    """

    def run(batches):
        encoder = text_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = []
                for doc, found in zip(part.column(0).to_pylist(), encoder.texts(part.column(1).to_pylist())):
                    data = np.append(found, np.uint32(end_id)).astype("<u4").tobytes()
                    start = 0
                    for k, length in enumerate(cut_lengths(len(data) // 4, capacity)):
                        own = data[4 * start:4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(own), own))
                        start += length
                columns = list(zip(*rows))[: 6 if ids else 5]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return small_batches(rows).mapInArrow(run, PIECES + (", ids binary" if ids else ""))


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Sweep lengths from long to short over the gaps.

    Returns ``(length, first_rank, per_sequence, first_sequence, place)`` per run
    of equal matches, ordered by length and rank, and the number of sequences. A
    run gives the pieces from ``first_rank`` on, ``per_sequence`` at a time, to
    consecutive sequences, the first of them at ``place``.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs of (first sequence, how many)
    matches, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        sizes = sorted(g for g, runs in gaps.items() if g >= length and runs)
        heap: list[int] = []
        for g in sizes:
            heappush(heap, g)
        while left:
            if heap:
                gap = heappop(heap)
                first, free = gaps[gap].pop()
                if gaps[gap]:
                    heappush(heap, gap)
            else:
                gap, first, free = capacity, sequences, -(-left // (capacity // length))
                sequences += free
            fit = gap // length
            used = min(free, -(-left // fit))
            placed = min(left, used * fit)
            matches.append((length, rank, fit, first, capacity - gap))
            whole = placed // fit
            if whole and gap - fit * length:
                gaps[gap - fit * length].append((first, whole))
            if placed % fit:  # the last sequence took fewer than fit
                gaps[gap - placed % fit * length].append((first + whole, 1))
            if free > used:
                gaps[gap].append((first + used, free - used))
            rank, left = rank + placed, left - placed
    return sorted(matches), sequences


def ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, by doc_id and piece.

    A length may be that of most pieces, so ranks are taken in ranges of doc_id
    and shifted by the sizes of the ranges before.
    """
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    spread = pieces.repartitionByRange(parts, "length", *order).withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "sorted_pieces")
    sizes = spread.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = spread.withColumn("place", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)))
    return within.join(shifts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("before", "place", "part")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    matches, _ = best_fit(counts, capacity)
    plan = np.array(matches, np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(plan)
    numbered = ranked(pieces)
    columns = [c for c in numbered.columns if c != "rank"]

    def place(batches):
        runs = held.value
        starts = {length: np.searchsorted(runs[:, 0], [length, length + 1]) for length in counts}
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(rank), np.int64)
            for own in np.unique(length):
                low, high = starts[int(own)]
                mine = length == own
                at[mine] = low + np.searchsorted(runs[low:high, 1], rank[mine], "right") - 1
            _, first_rank, fit, first, offset = runs[at].T
            step = rank - first_rank
            made = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array(first + step // fit), pa.array(offset + step % fit * length)], names=[*columns, "sequence_id", "offset"]
            )

    kinds = dict(numbered.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "sequence_id long", "offset long"])
    return numbered.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece of each document, with the sequence and the place it is packed at."""
    pieces = materialise(pieces_of(docs, path or public_path(VOCABULARY), end_id, capacity, ids), "pieces")
    return pack(pieces, capacity)


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
