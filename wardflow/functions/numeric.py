"""Numeric helpers shared by every report.

Reports round where the source SQL rounds (``ROUND(x::numeric, n)::float``):
decimal rounding, half away from zero, returned as double.  Going through
``decimal(38,10)`` first also absorbs last-bit noise from summation order, so
the result does not depend on how Spark partitioned the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_SCALE = "decimal(38,10)"


def round_dec(col: Column | str, places: int) -> Column:
    """``ROUND(CAST(x AS numeric), places)`` as a double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast(ROUND_SCALE), places).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den in double arithmetic; null instead of an error on 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(hits: Column, total: Column, places: int = 2) -> Column:
    """``ROUND(hits * 100.0 / total, places)``; null when total is 0."""
    return round_dec(ratio(hits.cast("double") * F.lit(100.0), total), places)


def count_true(flag: Column | str) -> Column:
    """``COUNT(CASE WHEN flag = TRUE THEN 1 END)`` (D3)."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.count(F.when(c, F.lit(1)))


def rate_pct(flag: Column | str, places: int = 2) -> Column:
    """Percentage of rows whose flag is true, over all rows."""
    return pct(count_true(flag), F.count(F.lit(1)), places)


def mean(col: Column | str, places: int) -> Column:
    """Rounded ``AVG``."""
    c = F.col(col) if isinstance(col, str) else col
    return round_dec(F.avg(c), places)


def js_round(col: Column | str) -> Column:
    """``Math.round``: nearest whole number, halves toward +infinity."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c + F.lit(0.5)).cast("bigint")
