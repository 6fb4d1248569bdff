"""Numeric helpers with the null and zero rules used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for an infinite number in flow CSV files.
INFINITY_TEXTS = ["Infinity", "-Infinity", "inf", "-inf"]


def finite(c: Column) -> Column:
    """A floating value, or null for NaN and both infinities."""
    inf = float("inf")
    return F.when(F.isnan(c) | (c == F.lit(inf)) | (c == F.lit(-inf)), None).otherwise(c)


def to_number(c: Column) -> Column:
    """Parse to DOUBLE; anything unparsable or not finite becomes null, the row stays."""
    return finite(c.try_cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / den with 0 wherever the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def is_close(a: Column, b: Column | float = 0.0, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def truncated(n: int, share: float) -> int:
    """int(n * share) on doubles, truncating toward zero."""
    return int(n * share)
