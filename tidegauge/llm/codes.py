"""Product codes of vectors: Lloyd rounds over cover trees that are built once per block of rows.

Vectors become whole numbers and are cut into parts. A task arranges the parts of a
block of rows in cover trees: a node's children are chosen farthest first until every
point is within half the node's radius of one of them, and a subtree is a range of the
points, so prefix sums give its cumulative sum. The trees are stored; a round only
reads them. By the triangle inequality a whole subtree belongs to the entry nearest to
its centre if the next one is farther by more than two radii; such a subtree adds its
cumulative sum. Other nodes descend, and points of undecided leaves are compared
exactly, in whole numbers, a tie going to the lower index. The tasks' sums are added up
by Spark; a codebook is all that reaches the driver.

Results don't depend on how rows are dealt. Rows with a null vector, or one without
entries or with null or non-finite ones, are dropped. Repeated rows, and a null id or
label, count like any other; null ids are not among the smallest while others are left,
and rows of one id are ordered by their vectors. With fewer vectors than entries there
are as many entries as vectors. An empty table gives an empty result. Vectors of
different lengths, lengths that the parts don't divide, and entries of 4096 and more are
errors. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tidegauge.llm.common import map_arrow, query, table
from tidegauge.llm.vectors import kept_vectors, whole
from tidegauge.operators.joins import attach
from tidegauge.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers stay below this, so that float distances between them are exact enough to rule entries out.
LARGEST = 2**24
#: Rows of one block, and points of a node that is not split further.
BLOCK, LEAF = 2048, 16


@dataclass
class Tree:
    """Points in the order of the tree; node 0 is the root, a node's children follow each other."""

    points: np.ndarray  # in tree order
    place: np.ndarray  # where each point stood in its block
    centre: np.ndarray  # per node, a point
    radius: np.ndarray  # largest distance of a point of the subtree from the centre
    low: np.ndarray  # the subtree's points are low to high
    high: np.ndarray
    child_low: np.ndarray  # its children are the nodes child_low to child_high
    child_high: np.ndarray

    def to_bytes(self) -> bytes:
        own = [getattr(self, f.name) for f in fields(self)]
        head = np.array([self.points.shape[1], len(self.points), len(self.centre)])
        return b"".join(a.tobytes() for a in (head, *own))

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        numbers = np.frombuffer(data, np.int64)
        width, points, nodes = numbers[:3].tolist()
        sizes = np.cumsum([3, width * points, points, *[nodes] * 6])
        own = [numbers[a:b] for a, b in zip(sizes, sizes[1:])]
        own[0], own[3] = own[0].reshape(points, width), own[3].view(np.float64)
        return cls(*own)


def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of a block of whole-number points."""
    exact = points.astype(np.float64)
    order = np.arange(len(points))
    centre, low, high, radius, child_low, child_high = [0], [0], [len(points)], [], [], []
    while len(radius) < len(centre):
        node = len(radius)
        start, end = low[node], high[node]
        own = order[start:end]
        away = _distance(exact[own], exact[centre[node]])
        radius.append(float(away.max()))
        child_low.append(len(centre))
        if end - start > leaf and radius[node] > 0:
            nearest, chosen = np.zeros(len(own), np.int64), [centre[node]]
            while away.max() > radius[node] / 2:
                chosen.append(int(own[away.argmax()]))
                new = _distance(exact[own], exact[chosen[-1]])
                nearest[new < away] = len(chosen) - 1
                away = np.minimum(away, new)
            order[start:end] = own[np.argsort(nearest, kind="stable")]
            ends = start + np.cumsum(np.bincount(nearest, minlength=len(chosen)))
            centre += chosen
            low += [start, *ends[:-1].tolist()]
            high += ends.tolist()
        child_high.append(len(centre))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Tree(points[order], order, rank[centre], np.array(radius), *(np.array(a, np.int64) for a in (low, high, child_low, child_high)))


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every entry, in whole numbers."""
    apart = points[:, None, :] - book[None]
    return np.einsum("pkd,pkd->pk", apart, apart)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges."""
    size = high - low
    return np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())


def regions(tree: Tree, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``entry, low, high``: ranges of points with the entry they belong to; together they hold each point once."""
    front = np.zeros(1, np.int64)
    while len(front):
        away = squares(tree.points[tree.centre[front]], book)
        best = away.argmin(1)
        away = np.sqrt(away.astype(np.float64))
        first = np.take_along_axis(away, best[:, None], 1)[:, 0]
        np.put_along_axis(away, best[:, None], np.inf, 1)
        # The margin is far above what rounding does to these distances.
        sure = away.min(1) - first > 2 * tree.radius[front] * (1 + 1e-9) + 1e-4
        yield best[sure], tree.low[front[sure]], tree.high[front[sure]]
        front = front[~sure]
        leaf = tree.child_low[front] == tree.child_high[front]
        open_points = _spread(tree.low[front[leaf]], tree.high[front[leaf]])
        yield squares(tree.points[open_points], book).argmin(1), open_points, open_points + 1
        front = _spread(tree.child_low[front[~leaf]], tree.child_high[front[~leaf]])


def sums_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the sum and the number of its points."""
    upto = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), tree.points.cumsum(0)])
    total, count = np.zeros_like(book), np.zeros(len(book), np.int64)
    for entry, low, high in regions(tree, book):
        np.add.at(total, entry, upto[high] - upto[low])
        np.add.at(count, entry, high - low)
    return total, count


def codes_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the block's own order."""
    code = np.empty(len(tree.points), np.int64)
    for entry, low, high in regions(tree, book):
        code[_spread(low, high)] = np.repeat(entry, high - low)
    apart = tree.points - book[code]
    back = np.argsort(tree.place)
    return code[back], np.einsum("ij,ij->i", apart, apart)[back]


def with_trees(vectors: DataFrame, parts: int, length: int) -> DataFrame:
    """Blocks of rows as ``ids, labels`` and the trees of their parts."""
    kind = vectors.schema["label"].dataType
    schema = StructType([StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(kind)), StructField("trees", ArrayType(BinaryType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                x = rows.column(2)
                if not (np.diff(x.offsets.to_numpy()) == length).all():
                    raise ValueError(f"all vectors must have {length} entries")
                points = x.flatten().to_numpy().reshape(rows.num_rows, parts, length // parts)
                trees = [cover_tree(np.ascontiguousarray(points[:, p])).to_bytes() for p in range(parts)]
                ends = pa.array([0, rows.num_rows], pa.int32())
                ids, labels = (pa.ListArray.from_arrays(ends, pa.concat_arrays([c])) for c in rows.columns[:2])
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([trees], pa.list_(pa.binary()))], names=schema.names)

    return vectors.select("id", "label", "x").mapInArrow(run, schema)


def round_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, place, total, n``: what the points of each entry add up to."""
    shape = books.shape

    def run(batches):
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, data in enumerate(trees):
                    more, n = sums_of(Tree.from_bytes(data.as_py()), books[p])
                    total[p] += more
                    count[p] += n
        part, entry, place = np.nonzero(np.repeat(count[:, :, None], shape[2], 2))
        own = [part, entry, place, total[part, entry, place], count[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=["part", "entry", "place", "total", "n"])

    found = blocks.select("trees").mapInArrow(run, "part long, entry long, place long, total long, n long")
    return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds; an entry without points stays."""
    for _ in range(rounds):
        books = books.copy()
        for part, entry, place, total, n in round_sums(blocks, books).collect():  # a row per number of the codebooks
            books[part, entry, place] = total // n
    return books


def coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """``id, label, code, error`` of every row."""

    def rows(batch):
        codes, errors = [], []
        for trees in batch.column(2):
            found = [codes_of(Tree.from_bytes(data.as_py()), book) for data, book in zip(trees, books)]
            codes += [r.tobytes().hex() for r in np.stack([c for c, _ in found], 1).astype(np.uint8)]
            errors.append(sum(e for _, e in found))
        return {"id": batch.column(0).flatten(), "label": batch.column(1).flatten(), "code": codes, "error": np.concatenate(errors) if errors else []}

    return map_arrow(blocks.select("ids", "labels", "trees"), rows, f"id long, label {label}, code string, error long")


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_column: str = "vec_id", column: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row per vector that counts: ``vec_id, code, error, label_error, codebooks_sha256``."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    numbers = F.transform(column, lambda x: whole(x, scale, LARGEST))
    kept = kept_vectors(vectors, column).select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), numbers.alias("x"))
    first = [r.x for r in kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    if not first:
        books = np.zeros((parts, 0, 0), np.int64)
        return kept.select(F.col("id").alias(id_column), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(_digest(books)).alias("codebooks_sha256")).limit(0)
    length = len(first[0])
    if any(len(x) != length for x in first):
        raise ValueError(f"all vectors must have {length} entries")
    if length % parts:
        raise ValueError(f"{length} entries can't be cut into {parts} equal parts")
    blocks = materialise(with_trees(kept, parts, length), "cover_trees")
    books = trained(blocks, np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy(), rounds)
    found = materialise(coded(blocks, books, kept.schema["label"].dataType.simpleString()), "codes")
    # Null labels are equal to each other here.
    keyed = found.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    by_label = keyed.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    return attach(keyed, by_label, ["_none", "_label"]).select(
        F.col("id").alias(id_column), "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256")
    )


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _sql() -> str:
    """The same in SQL, every vector against every entry in every round."""
    width = 64 // PARTS
    away = " + ".join(f"(c.x[{i}] - b.x[{i}]) * (c.x[{i}] - b.x[{i}])" for i in range(1, width + 1))
    down = ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
          SELECT c.rid, c.p, any_value(c.x) AS x, min(CAST({away} AS HUGEINT) * {ENTRIES} + b.e) AS best
          FROM cells c JOIN b{k} b ON c.p = b.p GROUP BY c.rid, c.p)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
          SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (
            SELECT p, CAST(best % {ENTRIES} AS BIGINT) AS e, [{down}]::BIGINT[] AS x FROM a{k} GROUP BY p, best % {ENTRIES}) n
          ON b.p = n.p AND b.e = n.e)""")
    return f"""
    WITH kept AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    rows AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM kept),
    cells AS MATERIALIZED (
      SELECT rid, p, v[p * {width} + 1:p * {width} + {width}] AS x FROM rows, (SELECT unnest(range({PARTS})) AS p)),
    b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM cells WHERE rid <= {ENTRIES}),
    {", ".join(steps)},
    coded AS (
      SELECT rid, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INT)), '' ORDER BY p) AS code,
             CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
    numbers AS (SELECT p, e, unnest(x) AS x, unnest(range(1, {width} + 1)) AS i FROM b{ROUNDS}),
    digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM numbers)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM rows JOIN coded USING (rid) CROSS JOIN digest"""


@query("op12_vector_codes", _sql())
def op12(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))
