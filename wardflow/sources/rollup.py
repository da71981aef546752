"""The stored rollup of a published version: partial states of both row-level facts.

``load`` writes it next to the tables, one scan of each fact: a row per
hospital, department and month with counts and sums (``operators.states``).
Reports whose figures are counts, rates and averages by these keys finish
from it without reading a fact.  It is partitioned by year, and ``refresh``
recomputes only the years that changed.

Null keys are values like any other; a null arrival belongs to year 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators import states
from wardflow.sources.commits import Folder
from wardflow.sources.star import Star

VISITS, SHIFTS = "rollup_visits", "rollup_shifts"


def _year(time: str) -> Column:
    return F.coalesce(F.year(time), F.lit(0))


def _between(time: str, years: Iterable[int]) -> Column:
    """Rows of these years as ranges of the column, which reach the files' statistics."""
    found = F.lit(False)
    for y in years:
        mine = (F.col(time) >= F.make_date(F.lit(y), F.lit(1), F.lit(1))) & (
            F.col(time) < F.make_date(F.lit(y + 1), F.lit(1), F.lit(1)))
        found = found | (F.col(time).isNull() if y == 0 else mine)
    return found


def visit_rollup(star: Star, years: Iterable[int] | None = None) -> DataFrame:
    rows = star.visits(*states.VISIT_COLUMNS, "department_id", "arrival_datetime")
    rows = rows if years is None else rows.where(_between("arrival_datetime", years))
    return states.of_visits(rows.withColumn("year", _year("arrival_datetime")), "year", *states.VISIT_KEYS)


def shift_rollup(star: Star, years: Iterable[int] | None = None) -> DataFrame:
    rows = star.staffing(*states.SHIFT_COLUMNS, "department_id", "shift_date")
    rows = rows if years is None else rows.where(_between("shift_date", years))
    return states.of_shifts(rows.withColumn("year", _year("shift_date")), "year", *states.SHIFT_KEYS)


def write(star: Star, root: str) -> None:
    """The rollup of all years below ``root``."""
    for name, frame in ((VISITS, visit_rollup(star)), (SHIFTS, shift_rollup(star))):
        frame.repartition("year").write.partitionBy("year").parquet(f"{root}/{name}")


def refresh(spark: SparkSession, star: Star, root: str, years: Iterable[int]) -> None:
    """Recompute the partitions of ``years`` (0: rows without a time) of the rollup below ``root``.

    Other partitions are neither read nor written.  A year that has no rows
    any more loses its partition.  For a version that is not yet published:
    readers of a published one expect it to stay.
    """
    years = sorted(set(years))
    for name, frame in ((VISITS, visit_rollup(star, years)), (SHIFTS, shift_rollup(star, years))):
        frame.repartition("year").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{root}/{name}")
        left = {r.year for r in frame.select("year").distinct().collect()}  # among the given years
        folder = Folder(spark, f"{root}/{name}")
        for year in set(years) - left:
            folder.delete(f"year={year}")
