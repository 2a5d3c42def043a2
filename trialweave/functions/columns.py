"""Column building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.when(b != 0, F.try_divide(a, b))


def finite(x: Column) -> Column:
    """``x`` or null if it is NaN or infinite (also the coercion applied on write)."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def floor0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def rounded(df, digits: int = 6):
    """All double columns rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
