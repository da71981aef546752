"""Boolean conformance of source flag columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

# Spellings accepted by the strict flag parser.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]


def truthy(c: Column, dtype) -> Column:
    """Python truthiness as the source ETL applies it (``astype(bool)``).

    A missing value becomes True, a number is True unless 0, and any
    non-empty text — even "No" or "0" — is True.
    """
    if isinstance(dtype, BooleanType):
        return F.coalesce(c, F.lit(True))
    if isinstance(dtype, NumericType):
        return F.coalesce(c != F.lit(0), F.lit(True))
    if isinstance(dtype, StringType):
        return F.coalesce(F.length(c) > 0, F.lit(True))
    return F.lit(True)


def strict_flag(c: Column) -> Column:
    """Read yes/no/true/false/1/0 text as a boolean; anything else is null."""
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s.isin(*TRUE_WORDS), F.lit(True))
            .when(s.isin(*FALSE_WORDS), F.lit(False)))
