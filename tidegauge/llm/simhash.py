"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments, each with a radius, so that the radii plus
one add up to ``r + 1``. Two fingerprints beyond every radius would differ in
more than ``r`` bits, so each looks up the small Hamming ball around each of its
segments in a table of segment values, and every match is verified over all 64
bits. Fewer, wider segments need larger balls but share a value among fewer
fingerprints; their number follows from that of the fingerprints.

Nulls and empty texts have fingerprint zero and link like any other. Repeated
rows share one fingerprint, which is looked up once. A component's id is null only
if none of its rows has a doc_id. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, query, table, tasks_for, text_of, whole_partition
from tidegauge.llm.components import components
from tidegauge.session import materialise

BITS = 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Table rows of one segment value in a task; a hotter value is cut into blocks.
BLOCK = 20_000
#: A look-up in the shuffle costs about as much as so many verified candidates.
LOOKUP_COST = 60
#: Candidate pairs verified at a time.
CHUNK = 2_000_000


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle; a shorter text is one shingle, without words it has none."""
    words = data.translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)


def fingerprint(data: bytes, shingle: int) -> int:
    """Majority of the bits of all shingles' hashes, as an unsigned int."""
    hashes = shingle_hashes(data, shingle)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0  # one shingle: its own majority
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) for every row."""

    def rows(batch):
        values = [fingerprint(t.encode(), shingle) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "fp": np.array(values, np.uint64).view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), rows, "doc_id long, fp long")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of so many bits with at most ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)], np.uint64)


def radii(max_distance: int, segments: int) -> list[int]:
    """Radius per segment; with one added to each they sum up to ``max_distance + 1``."""
    share, more = divmod(max_distance + 1, segments)
    return [share - (0 if i < more else 1) for i in range(segments)]


def lookups(max_distance: int, segments: int) -> list[int]:
    """Table values that a fingerprint looks up, per segment."""
    return [sum(comb(w, k) for k in range(r + 1)) for (_, w), r in zip(segment_bounds(segments), radii(max_distance, segments))]


def segments_for(n_fps: int, max_distance: int) -> int:
    """Number of segments with the least work for so many fingerprints.

    A look-up costs a row in the shuffle and the candidates that share its value,
    ``n_fps / 2**width`` of them if values are spread evenly.
    """

    def work(segments: int) -> float:
        widths = (w for _, w in segment_bounds(segments))
        return sum(n * (LOOKUP_COST + n_fps / 2**w) for n, w in zip(lookups(max_distance, segments), widths))

    # With more segments most balls would be single values.
    return min(range(2, max(2, (max_distance + 2) // 2) + 1), key=work)


def _segment_rows(fps: DataFrame, segments: int, max_distance: int, probes: bool) -> DataFrame:
    """``key, fp``: a segment value per fingerprint, or the ball around it."""
    bounds = segment_bounds(segments)
    balls = [ball(w, r if probes else 0) for (_, w), r in zip(bounds, radii(max_distance, segments))]

    widest = max(w for _, w in bounds)

    def rows(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for s, ((low, width), masks) in enumerate(zip(bounds, balls)):
                value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                for part in range(0, len(masks), 64):
                    some = masks[part:part + 64]
                    key = (value[:, None] ^ some[None, :]) | np.uint64(s << widest)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(some)).view(np.int64))], names=["key", "fp"]
                    )

    return fps.select("fp").mapInArrow(rows, "key long, fp long")


def local_roots(size: int, pairs) -> np.ndarray:
    """Label of each of ``size`` nodes: the smallest node it is linked to by ``pairs``."""
    label = np.arange(size)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                higher = label[label]
                if (higher == label).all():
                    break
                label = higher
    return label


def _verified(rows: dict[str, np.ndarray], max_distance: int):
    """Pairs of places in the sorted table and the probes, verified in full."""
    is_table = rows["side"] == 0
    order = np.argsort(rows["cell"][is_table], kind="stable")
    cells, values = rows["cell"][is_table][order], rows["fp"][is_table][order].view(np.uint64)
    probe_cells, probes = rows["cell"][~is_table], rows["fp"][~is_table].view(np.uint64)
    low, high = np.searchsorted(cells, probe_cells, "left"), np.searchsorted(cells, probe_cells, "right")
    some = high > low
    low, high, probes = low[some], high[some], probes[some]
    at = 0
    upto = np.cumsum(high - low)
    while at < len(low):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
        length = (high - low)[at:end]
        first = np.repeat(np.arange(at, end), length)
        place = np.arange(length.sum()) - np.repeat(upto[at:end] - length - done, length) + low[first]
        x, y = probes[first], values[place]
        near = (x < y) & (np.bitwise_count(x ^ y) <= max_distance)
        yield x[near], y[near]
        at = end


def near_links(fps: DataFrame, max_distance: int, segments: int, n_fps: int) -> DataFrame:
    """``a, b``: links that connect what lies within ``max_distance``.

    Each task verifies all candidates of its segment values and returns a
    spanning star of every group it finds, never the pairs of a group. A value
    shared by more than `BLOCK` fingerprints is cut into blocks of probes and
    table rows, and each pair of blocks is a separate cell.
    """
    spark = fps.sparkSession
    stored = _segment_rows(fps, segments, max_distance, False)
    hot = stored.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    probed = _segment_rows(fps, segments, max_distance, True)
    both = stored.withColumn("side", F.lit(0).cast("byte")).union(probed.withColumn("side", F.lit(1).cast("byte")))
    split = both.join(materialise(hot, "hot_values"), "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks)
    cells = split.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        # value and segment in the upper 34 bits, two block numbers of 15 bits below
        F.shiftleft("key", 30)
        .bitwiseOR(F.shiftleft(F.when(F.col("side") == 0, own).otherwise(F.col("other")).cast("long"), 15))
        .bitwiseOR(F.when(F.col("side") == 0, F.col("other")).otherwise(own).cast("long"))
        .alias("cell"),
        "fp",
        "side",
    )
    dealt = cells.repartition(tasks_for(spark, n_fps * (segments + sum(lookups(max_distance, segments)))), "cell")

    def links(batches):
        rows = whole_partition(batches, ["cell", "fp", "side"])
        if not rows:
            return
        nodes = np.unique(rows["fp"].view(np.uint64))
        pairs = ((np.searchsorted(nodes, x), np.searchsorted(nodes, y)) for x, y in _verified(rows, max_distance))
        root = nodes[local_roots(len(nodes), pairs)]
        linked = root != nodes
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[linked].view(np.int64)), pa.array(root[linked].view(np.int64))], names=["a", "b"]
        )

    return dealt.mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, segments: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest doc_id reachable over links of fingerprints
    that differ in at most ``max_distance`` bits.
    """
    marked = materialise(with_fingerprints(docs, shingle), "fingerprints")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    n_fps = fps.count()
    links = near_links(fps, max_distance, segments or segments_for(n_fps, max_distance), n_fps)
    roots = components(links)
    # Only linked fingerprints are in `roots`; the others are their own component.
    linked = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    labels = materialise(linked.join(least, "root").select("fp", "least"), "labels")
    alone = fps.select("fp", F.col("first").alias("own"))
    by_fp = alone.join(labels, "fp", "left").select("fp", F.coalesce("least", "own").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int, max_distance: int, segments: int | None = None) -> DataFrame:
    """The document with the smallest doc_id of every component, with all its columns."""
    found = near_duplicates(docs, shingle, max_distance, segments)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["kept_id"]), "left_semi")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
