"""Expose a star as temporary views so it can be queried with SQL.

    register_views(star)
    spark.sql("SELECT hospital_id, COUNT(*) FROM fact_patient_visits GROUP BY 1")
"""

from __future__ import annotations

from wardflow.schemas import LOAD_ORDER
from wardflow.sources.star import Star


def register_views(star: Star, tables: list[str] | None = None, prefix: str = "",
                   columns: dict[str, list[str]] | None = None) -> list[str]:
    """Create or replace one temporary view per star table; returns the names.

    ``prefix`` keeps them apart from other views; ``columns`` lists a table's
    columns that are wanted (default: all).
    """
    names = []
    for name in tables or LOAD_ORDER:
        view = f"{prefix}{name}"
        wanted = (columns or {}).get(name)
        (star.columns(name, *wanted) if wanted else star.table(name)).createOrReplaceTempView(view)
        names.append(view)
    return names
