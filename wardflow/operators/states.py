"""Partial states of the facts: counts and sums that add up to every average and rate of the reports.

A state row holds, for one combination of keys, what a report needs to finish:
rows, non-null counts and sums.  States of finer keys merge by addition,
so one stored rollup (``sources.rollup``) serves reports by hospital, month,
department or all at once, and a report over the facts takes the same path
with a single aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.numeric import count_true, pct, ratio, round_dec

#: Keys by which states can be asked for; month_text is the arrival's year and month.
VISIT_KEYS = ("hospital_id", "department_id", "month", "month_text")
SHIFT_KEYS = ("hospital_id", "department_id", "month")
VISIT_STATE = ("visits", "with_id", "readmitted", "icu", "wait_n", "wait_sum", "satisfaction_n", "satisfaction_sum")
SHIFT_STATE = ("shifts", "absence_sum", "overtime_n", "overtime_sum", "burnout_n", "burnout_sum")

#: Schemas of empty rollups, which have no file to read them from; others keep the ids' own types.
VISIT_SCHEMA = ("hospital_id string, department_id string, month int, month_text string, visits long, with_id long, "
                "readmitted long, icu long, wait_n long, wait_sum double, satisfaction_n long, satisfaction_sum double, year int")
SHIFT_SCHEMA = ("hospital_id string, department_id string, month int, shifts long, absence_sum long, overtime_n long, "
                "overtime_sum double, burnout_n long, burnout_sum double, year int")

VISIT_COLUMNS = ("hospital_id", "visit_id", "month", "readmission_30_days_flag", "icu_required_flag", "wait_time_minutes",
                 "satisfaction_score")
SHIFT_COLUMNS = ("hospital_id", "month", "staff_absence_count", "overtime_hours", "burnout_risk_index")


def _sum(column: str) -> Column:
    return F.sum(F.col(column).cast("double"))


def of_visits(visits: DataFrame, *keys: str) -> DataFrame:
    """States of visit rows by ``keys``; aggregates that a report doesn't use are pruned."""
    if "month_text" in keys:
        visits = visits.withColumn("month_text", F.date_format("arrival_datetime", "yyyy-MM"))
    return visits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("visits"), F.count("visit_id").alias("with_id"),
        count_true("readmission_30_days_flag").alias("readmitted"), count_true("icu_required_flag").alias("icu"),
        F.count("wait_time_minutes").alias("wait_n"), _sum("wait_time_minutes").alias("wait_sum"),
        F.count("satisfaction_score").alias("satisfaction_n"), _sum("satisfaction_score").alias("satisfaction_sum"))


def of_shifts(shifts: DataFrame, *keys: str) -> DataFrame:
    """States of shift rows by ``keys``."""
    return shifts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shifts"), F.sum("staff_absence_count").cast("long").alias("absence_sum"),
        F.count("overtime_hours").alias("overtime_n"), _sum("overtime_hours").alias("overtime_sum"),
        F.count("burnout_risk_index").alias("burnout_n"), _sum("burnout_risk_index").alias("burnout_sum"))


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """States of ``keys`` from finer ones.  Without any row, counts are 0 and sums null, as of no fact rows."""
    names = [c for c in states.columns if c in VISIT_STATE or c in SHIFT_STATE]

    def total(c: str) -> Column:
        counted = c in ("visits", "with_id", "readmitted", "icu", "shifts") or c.endswith("_n")
        return (F.coalesce(F.sum(c), F.lit(0)).cast("long") if counted else F.sum(c)).alias(c)

    return states.groupBy(*keys).agg(*[total(c) for c in names])


def average(what: str, places: int) -> Column:
    """The rounded mean of ``what`` (wait, satisfaction, overtime, burnout); null without values."""
    return round_dec(ratio(F.col(f"{what}_sum"), F.col(f"{what}_n")), places)


def readmission_rate() -> Column:
    """Percentage of visits followed by a readmission."""
    return pct(F.col("readmitted"), F.col("visits"))
