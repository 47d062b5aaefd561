"""Repeated byte strings by sorting sampled suffixes.

Which bytes are covered by a string of ``length`` bytes that starts anywhere
else, too? Sorting every suffix of a corpus would move each byte hundreds of
times. Suffixes are sampled by content instead: of the hashes of all ``GRAM``-byte
strings within a window of ``length`` bytes, the leftmost smallest is the
window's anchor. Equal windows have equal anchors at equal places, so every
repeated window is found by comparing suffixes that start at anchors.

1. Consecutive windows with the same anchor form a run. A run's key is the head of
   the suffix at its anchor (leading bytes, and a hash of ``GRAM`` bytes) and a
   hash of all bytes of its windows.
2. Spark samples splitters and range-partitions runs by these keys. Each bucket is
   sorted by multikey quicksort: by the first key, then only the ties by the next.
   Neighbours are compared, also across the boundaries of buckets. Runs equal to a
   neighbour are repeated in all their windows.
3. Runs that share only the anchor with others (the edges of repeated passages)
   are compared window by window with those others.

Documents are UTF-8 bytes, null is empty; matches never cross documents. Texts
shorter than ``length`` lose nothing. Repeated rows are separate documents: they
repeat each other. An empty table gives an empty result; extra columns are
ignored here (the pipeline keeps those of documents).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ROWS_PER_TASK, map_arrow, query, small_batches, table, tasks_for, text_of, whole_partition
from tidegauge.session import materialise

LENGTH = 200
GRAM = 40
#: Bytes hashed at a time, a power of two; windows that cross the end are hashed with the next part.
PART = 1 << 18
#: Runs of one anchor compared in one task; more are dealt out and compared in two steps.
GROUP = 50_000

_BASE = 0x9E3779B97F4A7C15
RUNS = "head long, whole long, doc long, first long, size int, anchor int"


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, made once per worker."""
    return tuple(np.cumprod(np.array([1] + [x] * PART, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums that `_hash` makes polynomial hashes of any substring from."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[0][: len(data)], out=sums[1:])
    return sums


def _hash(sums: np.ndarray, start, end) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _powers()[1][start])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of its leftmost smallest.

    Minima run forwards and backwards in blocks of the window's width, so each
    window is the lesser of two.
    """
    keys = (hashes & ~np.uint64(PART * 2 - 1)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.concatenate([keys, np.full(-len(keys) % width + width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(hashes) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & np.uint64(PART * 2 - 1)).astype(np.int64)


def runs_of(data: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """``head, whole, first, size, anchor`` of the runs of windows in one text."""
    found = []
    step = PART - length
    for low in range(0, max(0, len(data) - length + 1), step):
        part = data[low:low + step + length - 1]
        sums = _sums(part)
        places = np.arange(len(part) - gram + 1)
        at = anchors(_hash(sums, places, places + gram), length - gram + 1)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        first, size = edge[:-1], np.diff(edge)
        anchor = at[first]
        lead = (part[anchor].astype(np.uint64) << np.uint64(24)) | (part[anchor + 1].astype(np.uint64) << np.uint64(16))
        lead |= (part[anchor + 2].astype(np.uint64) << np.uint64(8)) | part[anchor + 3].astype(np.uint64)
        head = (lead << np.uint64(32)) | (_hash(sums, anchor, anchor + gram) >> np.uint64(32))
        whole = mixed(_hash(sums, first, first + size - 1 + length) + (anchor - first).astype(np.uint64) * np.uint64(_BASE) + size.astype(np.uint64))
        found.append((head.view(np.int64), whole.view(np.int64), first + low, size, anchor - first))
    return found


def numbered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text`` and ``doc``, a number that tells repeated rows apart.

    Scans are split by the cores there are when a job is planned, so the number is that
    of the file and of the row in it, and texts of a stored table are not copied for it.
    Any other frame is stored first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialise(docs, "documents")
    file = docs.metadataColumn("_metadata")
    paths = [r[0] for r in docs.select(file["file_path"].alias("file")).distinct().orderBy("file").collect()]  # one row a file
    files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), "file string, number long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("text"), file["file_path"].alias("file"), file["row_index"].alias("place"))
    doc = F.shiftleft("number", 40).bitwiseOR(F.col("place")).alias("doc")  # up to 2**40 rows a file
    return small_batches(rows).join(F.broadcast(files), "file").select("row", "text", doc)


def all_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                out += [(h, w, np.full(len(h), doc), f, s, a) for h, w, f, s, a in runs_of(data, length, gram)]
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                columns[4:] = [c.astype(np.int32) for c in columns[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["head", "whole", "doc", "first", "size", "anchor"])

    return texts.select("doc", "text").mapInArrow(run, RUNS)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by the first key; ties, and only they, by the next one, and so on."""
    order = np.argsort(keys[0], kind="stable")
    if len(keys) == 1 or len(order) < 2:
        return order
    own = keys[0][order]
    group = np.cumsum(np.concatenate([[True], own[1:] != own[:-1]]))
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(tied):
        rest = multikey_order([k[order[tied]] for k in keys[1:]])
        order[tied] = order[tied[rest]][np.argsort(group[tied[rest]], kind="stable")]
    return order


def _flagged(rows: dict[str, np.ndarray], bucket: int) -> pd.DataFrame:
    """Sorted rows with, per key prefix, whether the one before and after is equal."""
    order = multikey_order([rows["head"], rows["whole"]])
    frame = pd.DataFrame({c: v[order] for c, v in rows.items()})
    for name, keys in (("head", ["head"]), ("whole", ["head", "whole"])):
        same = np.ones(max(0, len(frame) - 1), bool)
        for k in keys:
            same &= frame[k].to_numpy()[1:] == frame[k].to_numpy()[:-1]
        frame[f"{name}_before"] = np.concatenate([[False], same])
        frame[f"{name}_after"] = np.concatenate([same, [False]])
    edge = np.zeros(len(frame), np.int8)
    edge[0] |= 1
    edge[-1] |= 2
    return frame.assign(bucket=np.int32(bucket), edge=edge)


FLAGS = ["head_before", "head_after", "whole_before", "whole_after"]


def neighbours(runs: DataFrame, tasks: int) -> DataFrame:
    """Runs that share their head with a neighbour, with flags for the row before and after.

    The first and last row of each bucket are compared with the nearest rows of
    the buckets beside it; that table has two rows a bucket.
    """
    names = ["head", "whole", "doc", "first", "size", "anchor"]
    # Equal keys are spread by doc, so one very frequent string fills many buckets.
    dealt = runs.repartitionByRange(tasks, "head", "whole", "doc", "first").withColumn("bucket", F.spark_partition_id())

    def run(batches):
        rows = whole_partition(batches, [*names, "bucket"])
        if rows:
            bucket = int(rows.pop("bucket")[0])
            frame = _flagged(rows, bucket)
            some = frame["head_before"] | frame["head_after"] | (frame["edge"] > 0)
            yield pa.RecordBatch.from_pandas(frame[some], preserve_index=False)

    schema = RUNS + "".join(f", {f} boolean" for f in FLAGS) + ", bucket int, edge byte"
    marked = materialise(dealt.mapInArrow(run, schema), "neighbours")
    ends = marked.where("edge > 0").select("bucket", "edge", "head", "whole").orderBy("bucket", "edge").collect()  # two rows a bucket
    firsts = [r for r in ends if r["edge"] & 1]
    lasts = [r for r in ends if r["edge"] & 2]
    fixed = []
    for last, first in zip(lasts, firsts[1:]):
        if last["head"] == first["head"]:
            same = last["whole"] == first["whole"]
            fixed += [(last["bucket"], 2, True, same), (first["bucket"], 1, True, same)]
    joined = marked.sparkSession.createDataFrame(fixed, "bucket int, side int, heads boolean, wholes boolean")
    left = F.broadcast(joined.where("side = 1").select("bucket", F.col("heads").alias("h1"), F.col("wholes").alias("w1")))
    right = F.broadcast(joined.where("side = 2").select("bucket", F.col("heads").alias("h2"), F.col("wholes").alias("w2")))
    both = marked.join(left, "bucket", "left").join(right, "bucket", "left")
    is_first, is_last = F.col("edge").bitwiseAND(1) > 0, F.col("edge").bitwiseAND(2) > 0

    def with_edge(flag, at, found):
        return (F.col(flag) | (at & F.coalesce(F.col(found), F.lit(False)))).alias(flag)

    flags = [
        with_edge("head_before", is_first, "h1"), with_edge("head_after", is_last, "h2"),
        with_edge("whole_before", is_first, "w1"), with_edge("whole_after", is_last, "w2"),
    ]
    return both.select(*names, *flags).where("head_before OR head_after")


def _edge_windows(texts: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """``head, doc, first, size, anchor, bytes`` of runs to be compared window by window."""
    per_doc = edges.groupBy("doc").agg(F.collect_list(F.struct("head", "first", "size", "anchor")).alias("runs"))
    rows = texts.select("doc", "text").join(per_doc, "doc").select("doc", "text", "runs")

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode()
                out += [(r["head"], doc, r["first"], r["size"], r["anchor"], data[r["first"]:r["first"] + r["size"] - 1 + length]) for r in runs]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                names = ["head", "doc", "first", "size", "anchor", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, "head long, doc long, first long, size int, anchor int, bytes binary")


def _window_keys(frame: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every window of the runs; the key has head, place and bytes."""
    sizes = frame["size"].to_numpy(np.int64)
    owner = np.repeat(np.arange(len(frame)), sizes)
    keys = []
    for head, size, anchor, data in zip(frame["head"].to_numpy().view(np.uint64), sizes, frame["anchor"], frame["bytes"]):
        sums = _sums(np.frombuffer(data, np.uint8))
        start = np.arange(size)
        place = (anchor - start).astype(np.uint64)
        keys.append(mixed(_hash(sums, start, start + length) + place * np.uint64(_BASE) + head))
    return owner, np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _repeated(frame: pd.DataFrame, owner: np.ndarray, twice: np.ndarray) -> pd.DataFrame:
    """Runs of consecutive repeated windows as ``doc, first, size``."""
    at = np.arange(len(owner)) - np.repeat(np.cumsum(frame["size"]) - frame["size"], frame["size"]).to_numpy()
    place = frame["first"].to_numpy()[owner] + at
    hit = np.flatnonzero(twice)
    if not len(hit):
        return pd.DataFrame({"doc": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "size": np.zeros(0, np.int32)})
    new = np.concatenate([[True], (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1])])
    start = np.flatnonzero(new)
    return pd.DataFrame({
        "doc": frame["doc"].to_numpy()[owner[hit[start]]], "first": place[hit[start]],
        "size": np.diff(np.concatenate([start, [len(hit)]])).astype(np.int32),
    })


def _frames(batches):
    parts = [b.to_pandas() for b in batches if b.num_rows]
    return pd.concat(parts, ignore_index=True) if parts else None


def edge_matches(texts: DataFrame, edges: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """``doc, first, size``: repeated windows of runs that share a head with different runs.

    All runs of a head meet in one task, unless they are more than ``group``:
    these are dealt out, every task sends each distinct window once, and the
    windows found in several tasks return to the tasks that hold them.
    """
    spark = texts.sparkSession
    many = edges.groupBy("head").count().where(F.col("count") > group)
    many = materialise(many.select("head", F.ceil(F.col("count") / group).alias("parts")), "frequent_heads")
    windows = _edge_windows(texts, edges, length)
    dealt = windows.join(many, "head", "left").withColumn("share", F.pmod(F.xxhash64("doc", "first"), F.coalesce("parts", F.lit(1))))
    found = "doc long, first long, size int"

    def alone(batches):
        frame = _frames(batches)
        if frame is not None:
            owner, keys = _window_keys(frame, length)
            _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_pandas(_repeated(frame, owner, n[at] > 1), preserve_index=False)

    tasks = tasks_for(spark, edges.count(), ROWS_PER_TASK // 20)
    few = dealt.where("parts IS NULL").repartition(tasks, "head").mapInArrow(alone, found)
    if not many.head(1):
        return few
    spread = materialise(dealt.where("parts IS NOT NULL").repartition(tasks, "head", "share").withColumn("task", F.spark_partition_id()), "frequent_runs")

    def distinct_windows(batches):
        frame = _frames(batches)
        if frame is not None:
            for task, own in frame.groupby("task"):
                _, keys = _window_keys(own, length)
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(n > 1), pa.array(np.full(len(key), task, np.int32))], names=["window", "own", "task"]
                )

    sent = materialise(spread.repartition(tasks, "task").mapInArrow(distinct_windows, "window long, own boolean, task int"), "windows")
    common = sent.groupBy("window").agg(F.count(F.lit(1)).alias("tasks"), F.max("own").alias("own")).where("tasks > 1 OR own")
    back = sent.join(common.select("window"), "window", "left_semi").select("task", "window")

    def marked(own: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        owner, keys = _window_keys(own, length)
        return _repeated(own, owner, np.isin(keys.view(np.int64), hits["window"].to_numpy()))

    frequent = spread.groupBy("task").cogroup(back.groupBy("task")).applyInPandas(marked, found)
    return few.union(frequent)


def covers(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc, first, size``: consecutive windows that all occur elsewhere, too."""
    spark = texts.sparkSession
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # About two anchors in so many bytes are expected on random text.
    tasks = tasks_for(spark, 2 * n_bytes // (length - gram + 1))
    near = neighbours(all_runs(texts, length, gram), tasks)
    whole = "(whole_before OR whole_after)"
    # Of equal runs, the first and last stand for them among runs with the same head.
    other = "((head_before AND NOT whole_before) OR (head_after AND NOT whole_after))"
    near = materialise(near, "repeated_heads")
    inside = near.where(whole).select("doc", "first", "size")
    return inside.union(edge_matches(texts, near.where(other), length, group))


def removed_spans(starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of covered bytes, as rows of start and end, from runs of windows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    low, high = starts[order], np.maximum.accumulate(starts[order] + sizes[order] - 1 + length)
    new = np.concatenate([[True], low[1:] > high[:-1]])
    start = np.flatnonzero(new)
    return np.stack([low[start], high[np.concatenate([start[1:] - 1, [len(low) - 1]])]], 1)


def cut_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per document: ``row`` (its columns), ``n_bytes, spans`` (start and end, flat) and ``kept``, the bytes left."""
    texts = numbered(docs)
    found = covers(texts.select("text", "doc"), length, gram, group)
    # Windows of one document only, at most as many as it has bytes.
    per_doc = found.groupBy("doc").agg(F.collect_list("first").alias("first"), F.collect_list("size").alias("size"))
    rows = texts.withColumn("row", F.col("row").withField("text", F.lit(None).cast("string")))
    rows = rows.join(per_doc, "doc", "left").select("row", "text", "first", "size")

    def run(batches):
        for batch in batches:
            out = []
            for text, first, size in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                data = text.encode()
                spans = removed_spans(np.array(first or [], np.int64), np.array(size or [], np.int64), length)
                ends = [0, *spans.ravel().tolist(), len(data)]
                out.append((len(data), spans.ravel().tolist(), b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))))
            if out:
                made = [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.list_(pa.int64()), pa.binary()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, spans array<long>, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of their texts, and the other columns as they were.

    A cut inside a character takes the rest of that character with it. ``n_chars``,
    where there is one, counts the new text. A text that is cut away whole is empty.
    """

    def decoded(batch):
        return {"row": batch.column(0), "left": [k.decode("utf-8", "ignore") for k in batch.column(1).to_pylist()]}

    cut = cut_documents(docs).select("row", "kept")
    rows = map_arrow(cut, decoded, f"row {cut.schema['row'].dataType.simpleString()}, left string")
    changed = {"text": F.col("left"), "n_chars": F.char_length("left").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


@query("op2_suffix_array_dedup")
def op2(spark, sf_dir):
    cut = cut_documents(table(spark, sf_dir, "documents"))
    return cut.select(
        "row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
