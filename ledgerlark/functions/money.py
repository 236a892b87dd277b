"""Money in minor units and the rounding rules of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, ties towards plus infinity (F.round takes ties away from zero)."""
    return F.floor(x + 0.5)


def to_minor(x: Column) -> Column:
    """Amount in whole minor units (bigint)."""
    return half_up((x + F.lit(2.220446049250313e-16)) * 100).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
