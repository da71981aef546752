"""Helpers for reshapes: series keyed by data values, and reports' order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, by: Sequence[str], key: str, value: Column, name: str) -> DataFrame:
    """One row per ``by`` with a map from ``key`` to the aggregate ``value``.

    The schema does not depend on the data, so no job runs to plan it and any
    number of keys fits; null keys have no entry.
    """
    cells = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(value.alias("__v"))
    return cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, "__v"))).alias(name))


def spread(entries: str, names: Sequence[str], missing: Column | None = None) -> list[Column]:
    """A column for each of ``names`` from a map, null (or ``missing``) where it has no entry."""
    found = [F.try_element_at(F.col(entries), F.lit(n)) for n in names]
    return [(f if missing is None else F.coalesce(f, missing)).alias(n) for f, n in zip(found, names, strict=True)]


def text_order(column: str, collation: str | None = None) -> Column:
    """The sort key of a text column: binary order, or that of a collation (``UNICODE`` orders names
    as a database with a language's collation does, ``UNICODE_CI`` ignores case)."""
    return F.collate(F.col(column), collation) if collation else F.col(column)


def sort_if(df: DataFrame, ordered: bool, *keys) -> DataFrame:
    """The report's ORDER BY, skipped when the caller reshapes it further
    (a global sort is a range shuffle that a later window, pivot or
    aggregate would only undo)."""
    return df.orderBy(*keys) if ordered else df
