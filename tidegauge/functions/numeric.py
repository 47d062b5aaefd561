"""Numeric cleaning rules: coercion, missing values, unit conversion, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Divisor per column-name suffix (bytes to KiB, MiB, GiB).
SUFFIX_DIVISORS = {"_kb": 1024, "_mb": 1048576, "_gb": 1073741824}
BYTES_MARK = "_bytes"
BYTES_DIVISOR = 1048576


def to_number(value: Column) -> Column:
    """Parse as DOUBLE; blank, text, NaN and infinities become NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def zero_if_missing(value: Column) -> Column:
    """:func:`to_number` with 0 in place of every missing value."""
    return F.coalesce(to_number(value), F.lit(0.0))


def suffix_divisor(name: str) -> int | None:
    """Divisor for a column named ``*_kb``, ``*_mb`` or ``*_gb``, any case."""
    return SUFFIX_DIVISORS.get(name.lower()[-3:])


def truncated_units(value: Column, divisor: int) -> Column:
    """Divide and drop the fraction. NULL stays NULL, and text that is no number becomes NULL."""
    return (to_number(value) / F.lit(divisor)).cast("bigint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def rounded(value: Column, digits: int = 6) -> Column:
    """Round, with -0.0 folded into 0.0."""
    return F.round(value, digits) + F.lit(0.0)
