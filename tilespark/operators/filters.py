"""Numeric filters as window functions over one row per element.

``keys`` name the array, ``order`` its element; together they must be unique, as lag and
running sums depend on the order.  ``bits`` wraps results as unsigned integers of that
width; None leaves them as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lag(keys: Sequence[str], order: str, value: str, dist: int) -> Column:
    return F.coalesce(F.lag(value, dist).over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))


def _wrap(x: Column, bits: int | None) -> Column:
    return x if bits is None else F.pmod(x, F.lit(1 << bits))


def _lane(keys: Sequence[str], order: str, dist: int):
    return Window.partitionBy(*keys, *([F.pmod(F.col(order), F.lit(dist))] if dist > 1 else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def delta_encode(df: DataFrame, keys, order: str, value: str, out: str, dist: int = 1, bits: int | None = None) -> DataFrame:
    """Difference to the element ``dist`` before; the first ones stay."""
    return df.withColumn(out, _wrap(F.col(value) - _lag(keys, order, value, dist), bits))


def delta_decode(df: DataFrame, keys, order: str, value: str, out: str, dist: int = 1, bits: int | None = None) -> DataFrame:
    """Running sums in lanes; ``order`` counts the elements of an array."""
    return df.withColumn(out, _wrap(F.sum(value).over(_lane(keys, order, dist)), bits))


def xor_encode(df: DataFrame, keys, order: str, value: str, out: str, dist: int = 1) -> DataFrame:
    return df.withColumn(out, F.col(value).bitwiseXOR(_lag(keys, order, value, dist)))


def xor_decode(df: DataFrame, keys, order: str, value: str, out: str, dist: int = 1) -> DataFrame:
    return df.withColumn(out, F.bit_xor(value).over(_lane(keys, order, dist)))


def predictor2(df: DataFrame, keys, row: str, col: str, value: str, out: str, bits: int | None = None) -> DataFrame:
    """Horizontal difference within a row."""
    return delta_encode(df, [*keys, row], col, value, out, 1, bits)


def nsd(value: Column, digits: int) -> Column:
    """Significant decimal digits, half to even."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.rint(value * scale) / scale)


def bitround(value: Column, keepbits: int) -> Column:
    """Keeps mantissa bits, ties away from zero, for finite values in the normal range."""
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value))) - keepbits)
    return F.when(value == 0, value).otherwise(F.signum(value) * F.floor(F.abs(value) / ulp + 0.5) * ulp)


def running_composite(df: DataFrame, cell, frame: str, value: str, out: str) -> DataFrame:
    """Each cell shows its last value that is not transparent (null) up to the frame."""
    w = Window.partitionBy(*cell).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def lead_sizes(df: DataFrame, file: str, offset: str, total: Column, out: str) -> DataFrame:
    """Stored size of each entry: up to the next one of its file, the last up to its end."""
    w = Window.partitionBy(file).orderBy(offset)
    return df.withColumn(out, F.coalesce(F.lead(offset).over(w), total) - F.col(offset))
