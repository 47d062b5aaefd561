"""Tables of vectors: which rows count, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only; one without entries goes like a null one."""
    good = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & good, F.lit(False)))


def whole(x: Column, factor: int, most: int) -> Column:
    """``floor(factor * x)`` as a long; an error beyond ``most``, where sums and squares would not be exact."""
    scaled = F.floor(x.cast("double") * factor)
    return F.when(F.abs(x.cast("double") * factor) < most, scaled).otherwise(
        F.raise_error(F.concat(F.lit("a vector has an entry too large for exact sums: "), x.cast("string"))).cast("long")
    )
