"""Principal components and whitening of vectors, with Spark's distributed block matrices.

Vectors become whole numbers, so sums are exact, and are centred. Rows are numbered by
the place they were stored at and packed into blocks; the last block is filled up with
zero rows, which change no product. Two products of block matrices do the work:

- Scatter: block ``g``, transposed, stands at ``(g // side, g)`` of the left matrix and
  as it is at ``(g, g % side)`` of the right one. Their product has the block's own
  scatter at ``(g // side, g % side)``, so blocks are multiplied on a whole grid of
  tasks and not in the one task that holds a result of a few rows; a tree of additions
  gives the total.
- Projection: block ``g`` stands at ``(g // side, g % side)`` and is multiplied by a
  block diagonal of the whitening matrix.

The eigenvectors of the scatter matrix, which has a row per dimension, are found on the
driver. Whitened rows are centred and multiplied in the same way to measure how far
their covariance is from the identity.

Rows with a null vector, or one without entries or with null or non-finite ones, are
dropped. Repeated rows and rows with a null id count like any other. Components beyond
the number of dimensions are not returned. A component without variance (one vector,
equal vectors, fewer vectors than dimensions) has a null ``whitened`` and takes no part
in ``identity_error``, which is null if there is no other; ``explained`` is null if
nothing varies. An empty table gives an empty result. Vectors of different lengths and
entries of 2**24 and more are errors. Other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import query, table
from tidegauge.llm.vectors import kept_vectors, whole
from tidegauge.session import materialise

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = 2**30
#: Rows of a block: few for small tables, so that tasks have work, and more where the driver, which lists blocks, would hold many.
BLOCK, LARGEST_BLOCK, BLOCKS = 1024, 32_768, 20_000
#: Share of the largest eigenvalue below which a component counts as without variance: rounding of the scatter.
FLAT = 1e-12
#: Rows of an Arrow batch of the result.
SLICE = 20_000


def block_size(n: int) -> int:
    return min(LARGEST_BLOCK, max(BLOCK, n // BLOCKS))


def numbered(rows: DataFrame) -> DataFrame:
    """Stored rows with ``number``, without gaps from 0, by the place they were stored at."""
    stored = materialise(rows.withColumn("_place", F.monotonically_increasing_id()), "vectors")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(2**33 - 1)
    sizes = sorted(stored.groupBy(part.alias("part")).count().collect())  # a row per partition written
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])[:-1].tolist()
    starts = stored.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    return stored.join(F.broadcast(starts), part == F.col("_part")).withColumn("number", F.col("_before") + place).drop("_place", "_part", "_before")


def in_blocks(rows: DataFrame, size: int, columns: int) -> DataFrame:
    """``block, ids, deviations, data``: ``size`` rows at a time, the last block filled up with zero rows."""

    def pack(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("number")
        data = np.zeros((size, columns))
        data[:len(found)] = np.stack(found["x"].to_numpy())
        ids = [None if pd.isna(i) else int(i) for i in found["id"]]
        return pd.DataFrame({"block": [key[0]], "ids": [ids], "deviations": [found["deviation"].tolist()], "data": [data.tobytes()]})

    # Ids go as text: a null would make pandas' longs floats.
    dealt = rows.select(F.expr(f"number div {size}").alias("block"), "number", F.col("id").cast("string").alias("id"), "deviation", "x")
    return dealt.groupBy("block").applyInPandas(pack, "block long, ids array<long>, deviations array<long>, data binary")


def laid_out(blocks: DataFrame, place, shape: tuple[int, int], transposed: bool = False) -> RDD:
    """``((row, column), matrix)`` with every block where ``place`` puts it."""
    rows, columns = shape

    def made(row):
        # Column by column, as dense matrices are kept.
        values = np.frombuffer(row.data).reshape(rows, columns)
        held = values.ravel() if transposed else values.T.ravel()
        return place(row.block), DenseMatrix(*((columns, rows) if transposed else (rows, columns)), held)

    return blocks.select("block", "data").rdd.map(made)


def scatter(blocks: DataFrame, count: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of each row's products with itself."""
    rows, columns = shape
    side = isqrt(count - 1) + 1
    left = BlockMatrix(laid_out(blocks, lambda g: (g // side, g), shape, True), columns, rows, columns * side, rows * count)
    right = BlockMatrix(laid_out(blocks, lambda g: (g, g % side), shape), rows, columns, rows * count, columns * side)
    return left.multiply(right).blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def projected(blocks: DataFrame, count: int, shape: tuple[int, int], matrix: np.ndarray) -> DataFrame:
    """``block, data``: the rows of each block times ``matrix``."""
    rows, columns = shape
    side = isqrt(count - 1) + 1
    own = DenseMatrix(*matrix.shape, matrix.T.ravel())
    left = BlockMatrix(laid_out(blocks, lambda g: (g // side, g % side), shape), rows, columns, rows * side, columns * side)
    diagonal = blocks.sparkSession.sparkContext.range(side).map(lambda j: ((j, j), own))
    right = BlockMatrix(diagonal, columns, matrix.shape[1], columns * side, matrix.shape[1] * side)
    found = left.multiply(right).blocks.map(lambda b: (b[0][0] * side + b[0][1], bytearray(b[1].toArray().tobytes())))
    # Where the grid has no block the product has none either, or zeros.
    return blocks.sparkSession.createDataFrame(found, "block long, data binary").where(F.col("block") < count)


def centred(blocks: DataFrame, sizes: DataFrame, columns: int, means: np.ndarray) -> DataFrame:
    """``data`` without its means, but for the rows that only fill a block."""

    def rows(batches):
        for batch in batches:
            made = []
            for data, size in zip(batch.column(1), batch.column(2)):
                values = np.frombuffer(data.as_py()).reshape(-1, columns).copy()
                values[:size.as_py()] -= means
                made.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["block", "data"])

    return blocks.join(sizes, "block").select("block", "data", "size").mapInArrow(rows, "block long, data binary")


def column_sums(blocks: DataFrame, columns: int) -> np.ndarray:
    """Sum of each column over all rows."""

    def sums(batches):
        total = np.zeros(columns)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_py()).reshape(-1, columns).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns)), pa.array(total)], names=["place", "total"])

    found = blocks.select("data").mapInArrow(sums, "place long, total double").groupBy("place").agg(F.sum("total")).collect()
    return np.array([total for _, total in sorted(found)])


def listed(blocks: DataFrame, columns: int, explained: list[float | None], identity_error: float | None, n: int) -> DataFrame:
    """A row per vector and component."""
    flat = np.array([e is None or e <= 0 for e in explained])

    def rows(batches):
        for batch in batches:
            for ids, deviations, data in zip(*batch.columns):
                ids, deviations, values = ids.values, deviations.values, np.frombuffer(data.as_py()).reshape(-1, columns)
                for at in range(0, len(ids), max(1, SLICE // columns)):
                    some = slice(at, min(len(ids), at + max(1, SLICE // columns)))
                    k = some.stop - some.start
                    place = np.tile(np.arange(columns), k)
                    again = pa.array(np.repeat(np.arange(some.start, some.stop), columns))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(again), pa.array((place + 1).astype(np.int32)), pa.array(np.full(k * columns, n)), deviations.take(again),
                         pa.array(values[some].ravel(), mask=flat[place]), pa.array([explained[p] for p in place], pa.float64()),
                         pa.array([identity_error] * (k * columns), pa.float64())],
                        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return blocks.select("ids", "deviations", "data").mapInArrow(rows, schema)


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_column: str = "vec_id", column: str = "embedding",
    block: int | None = None,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector that counts."""
    numbers = F.transform(column, lambda x: whole(x, scale, LARGEST) + shift)
    kept = numbered(kept_vectors(vectors, column).select(F.col(id_column).cast("long").alias("id"), numbers.alias("x")))
    shown = kept.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).head()
    n, columns, most = shown
    if not n:
        return kept.select(
            F.col("id").alias(id_column), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *(F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")),
        ).limit(0)
    if columns != most:
        raise ValueError(f"vectors have {columns} to {most} entries")
    sums = list(kept.agg(*(F.sum(F.element_at("x", i + 1)) for i in range(columns))).head())
    away = F.zip_with("x", F.array(*(F.lit(int(s)).cast("long") for s in sums)), lambda x, s: x * F.lit(n) - s)
    # A sum over the dimensions in longs: exact, and an error if it does not fit.
    rows = kept.withColumn("deviation", F.aggregate(F.transform(away, lambda d: d * d), F.lit(0).cast("long"), lambda a, d: a + d))
    rows = rows.withColumn("x", F.transform(away, lambda d: d.cast("double") / F.lit(float(n))))
    size = block or block_size(n)
    count, shape = -(-n // size), (size, columns)
    blocks = materialise(in_blocks(rows, size, columns), "centred_blocks")
    values, axes = np.linalg.eigh(scatter(blocks, count, shape) / n)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(values.sum())
    used = min(components, columns)
    varies = values[:used] > FLAT * max(values[0], 0)
    matrix = np.where(varies, axes[:, :used] / np.sqrt(np.where(varies, values[:used], 1)), 0)
    result = materialise(projected(blocks, count, shape, matrix), "whitened_blocks")
    sizes = blocks.select("block", F.size("ids").alias("size"))
    middle = materialise(centred(result, sizes, used, column_sums(result, used) / n), "centred_result")
    covariance = scatter(middle, count, (size, used)) / n
    error = np.abs(covariance - np.eye(used))[np.ix_(varies, varies)]
    # A share of nothing is unknown; a component without variance explains nothing.
    explained = [None if trace <= 0 else float(v) / trace if good else 0.0 for v, good in zip(values, varies)]
    found = listed(blocks.drop("data").join(result, "block"), used, explained, float(error.max()) if error.size else None, n)
    return found.withColumnRenamed("id", id_column)


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
