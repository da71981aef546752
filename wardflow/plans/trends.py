"""Trends over calendar time: growth, winter surge, delayed effects, slopes.

All reports here first reduce a fact to (hospital, month) or (hospital,
department, week) in one scan, then work on series without gaps: the calendar
between the first and the last observation is generated with ``sequence`` inside
the plan, so a month or week without rows is a 0, not a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions import moments
from wardflow.functions.numeric import ratio, round_dec
from wardflow.operators.reshape import sort_if
from wardflow.operators.scope import Scope, hospital_scope, in_scope
from wardflow.sources.star import Star

#: Weeks by which overtime may follow absence.
MAX_LAG = 8
#: The winter season runs from November to January; the months next to it on both sides.
WINTER_MONTHS = (11, 12, 1)
SHOULDER_MONTHS = (8, 9, 10, 2, 3, 4)


def growth(now: Column, before: Column) -> Column:
    """Change in percent, two decimals; null without a positive figure to compare with."""
    return F.when(before > 0, round_dec(ratio((now - before) * 100, before), 2))


def monthly_visits(star: Star, scope: Scope | None = None) -> DataFrame:
    """(hospital_id, hospital_name, month_start, visits): every in-scope hospital in every month of the data.

    The months run from the first to the last arrival of all in-scope
    hospitals; months without arrivals count 0.  Visits without arrival time
    belong to no month.
    """
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    v = in_scope(star.visits("hospital_id", "arrival_datetime"), h).where(F.col("arrival_datetime").isNotNull())
    counts = v.groupBy("hospital_id", F.trunc("arrival_datetime", "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("n"))
    series = counts.groupBy("hospital_id").agg(
        F.map_from_entries(F.collect_list(F.struct("month_start", "n"))).alias("found"),
        F.min("month_start").alias("first"), F.max("month_start").alias("last"))
    # the span is a window over one row per hospital: the fact is read once
    span = Window.partitionBy()
    every = h.join(series, "hospital_id", "left").select(
        "hospital_id", "hospital_name", "found", F.min("first").over(span).alias("first"), F.max("last").over(span).alias("last"))
    months = F.expr("sequence(first, last, interval 1 month)")
    return every.where(F.col("first").isNotNull()).select(
        "hospital_id", "hospital_name", F.explode(months).alias("month_start"), "found").select(
        "hospital_id", "hospital_name", "month_start",
        F.coalesce(F.try_element_at("found", F.col("month_start")), F.lit(0)).cast("bigint").alias("visits"))


def visit_growth(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Visits of each hospital and month against the same month a year before.

    The first twelve months have nothing to compare with, and neither has a
    month that had no visits a year before: null.
    """
    year_ago = F.lag("visits", 12).over(Window.partitionBy("hospital_id").orderBy("month_start"))
    out = monthly_visits(star, scope).withColumn("visits_year_ago", year_ago)
    out = out.select("hospital_id", "hospital_name", F.date_format("month_start", "yyyy-MM").alias("month"), "visits",
                     "visits_year_ago", growth(F.col("visits"), F.col("visits_year_ago")).alias("growth_pct"))
    return sort_if(out, ordered, "hospital_id", "month")


def visit_growth_by_year(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """X2 by year: whole years against whole years, and like months against like months.

    ``growth_pct`` compares two years that the data cover in all twelve
    months; for the first year and for partial ones it is null.
    ``aligned_growth_pct`` compares the months that a year has with the same
    months of the year before, so a year still running is not set against a whole one.
    """
    by_month = Window.partitionBy("hospital_id").orderBy("month_start")
    months = monthly_visits(star, scope).withColumn("before", F.lag("visits", 12).over(by_month))
    years = months.groupBy("hospital_id", "hospital_name", F.year("month_start").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).cast("bigint").alias("months"), F.sum("visits").alias("visits"),
        F.sum(F.when(F.col("before").isNotNull(), F.col("visits"))).alias("aligned"), F.sum("before").alias("before"))
    by_year = Window.partitionBy("hospital_id").orderBy("year")
    whole = (F.col("months") == 12) & (F.lag("months").over(by_year) == 12)
    out = years.select(
        "hospital_id", "hospital_name", "year", "months", "visits",
        F.when(whole, growth(F.col("visits"), F.lag("visits").over(by_year))).alias("growth_pct"),
        growth(F.col("aligned"), F.col("before")).alias("aligned_growth_pct"))
    return sort_if(out, ordered, "hospital_id", "year")


def winter_surge(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Visits a month in each winter against the months next to it.

    A winter (November to January) crosses the year's end and is one season,
    named by the year of its November.  The months next to it are August to
    October before and February to April after.  A winter of which the data
    cover less than three months, or no month next to it, has no surge.
    """
    month, year = F.month("month_start"), F.year("month_start")
    season = F.when(month <= 4, year - 1).otherwise(year)
    winter, beside = month.isin(*WINTER_MONTHS), month.isin(*SHOULDER_MONTHS)
    rows = monthly_visits(star, scope).where(winter | beside)
    sums = rows.groupBy("hospital_id", "hospital_name", season.cast("bigint").alias("season")).agg(
        F.sum(F.when(winter, F.col("visits"))).alias("winter"), F.count(F.when(winter, 1)).alias("winter_months"),
        F.sum(F.when(beside, F.col("visits"))).alias("beside"), F.count(F.when(beside, 1)).alias("beside_months"))
    per_month = ratio(F.col("winter"), F.col("winter_months"))
    level = ratio(F.col("beside"), F.col("beside_months"))
    whole = (F.col("winter_months") == len(WINTER_MONTHS)) & (level > 0)
    out = sums.select(
        "hospital_id", "hospital_name", "season", F.coalesce("winter", F.lit(0)).cast("bigint").alias("winter_visits"),
        F.col("winter_months").cast("bigint").alias("winter_months"),
        F.coalesce("beside", F.lit(0)).cast("bigint").alias("beside_visits"),
        F.col("beside_months").cast("bigint").alias("beside_months"),
        F.when(whole, round_dec((ratio(per_month, level) - 1) * 100, 2)).alias("surge_pct"))
    return sort_if(out, ordered, "hospital_id", "season")


# ----------------------------------------------------- absence and overtime
def weekly_shifts(star: Star, scope: Scope | None = None) -> DataFrame:
    """(hospital_id, department_id, week, absences, overtime) without gaps between a series' first and last week.

    Weeks start on Monday; a week without shifts has neither absences nor
    overtime.  Shifts without a department make one series of their hospital.
    """
    h = hospital_scope(star.hospitals(), scope).select("hospital_id")
    s = in_scope(star.staffing("hospital_id", "department_id", "shift_date", "staff_absence_count", "overtime_hours"), h)
    weeks = s.where(F.col("shift_date").isNotNull()).groupBy(
        "hospital_id", "department_id", F.to_date(F.date_trunc("week", "shift_date")).alias("week")).agg(
        F.coalesce(F.sum("staff_absence_count"), F.lit(0)).cast("double").alias("absences"),
        F.coalesce(F.sum("overtime_hours"), F.lit(0.0)).alias("overtime"))
    # a week emits itself and the empty weeks up to the next one of its series
    series = Window.partitionBy("hospital_id", "department_id").orderBy("week")
    last = F.date_sub(F.coalesce(F.lead("week").over(series), F.date_add("week", 7)), 7)
    filled = weeks.withColumn("last", last).select(
        "hospital_id", "department_id", "absences", "overtime", F.col("week").alias("own"),
        F.explode(F.expr("sequence(week, last, interval 7 days)")).alias("week"))
    own = F.col("week") == F.col("own")
    return filled.select("hospital_id", "department_id", "week", F.when(own, F.col("absences")).otherwise(0.0).alias("absences"),
                         F.when(own, F.col("overtime")).otherwise(0.0).alias("overtime"))


def lag_states(star: Star, scope: Scope | None = None, max_lag: int = MAX_LAG) -> DataFrame:
    """A moments state of (absences, overtime ``lag`` weeks later) per hospital, department and lag.

    One sort of the weekly series gives the later weeks of every lag, and one
    aggregate all states: no join of the series with itself.
    """
    series = Window.partitionBy("hospital_id", "department_id").orderBy("week")
    later = [F.lead("overtime", k).over(series).alias(f"o{k}") for k in range(max_lag + 1)]
    weeks = weekly_shifts(star, scope).select("hospital_id", "department_id", "absences", *later)
    states = [s for k in range(max_lag + 1) for s in moments.state_of(F.col("absences"), F.col(f"o{k}"), f"s{k}_")]
    wide = weeks.groupBy("hospital_id", "department_id").agg(*states)
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag_weeks"),
                              *[F.col(f"s{k}_{s}").alias(s) for s in moments.STATE]) for k in range(max_lag + 1)])
    return wide.select("hospital_id", "department_id", F.inline(rows))


def absence_overtime_lags(star: Star, scope: Scope | None = None, max_lag: int = MAX_LAG,
                          ordered: bool = True) -> DataFrame:
    """Does overtime follow absence?  Correlation of weekly absences with overtime 0 to 8 weeks later.

    One row per hospital, department and lag with the number of week pairs;
    null when fewer than two pairs exist or a side never changes.
    """
    out = lag_states(star, scope, max_lag).select(
        "hospital_id", "department_id", "lag_weeks", F.col("n").cast("bigint").alias("pairs"),
        round_dec(moments.correlation(), 6).alias("correlation"))
    return sort_if(out, ordered, "hospital_id", "department_id", "lag_weeks")


def absence_overtime_network(star: Star, scope: Scope | None = None, max_lag: int = MAX_LAG,
                             ordered: bool = True) -> DataFrame:
    """X4 over all series together: their states merged by lag, and which lag is the strongest."""
    merged = moments.merge(lag_states(star, scope, max_lag), "lag_weeks").select(
        "lag_weeks", F.col("n").cast("bigint").alias("pairs"), round_dec(moments.correlation(), 6).alias("correlation"))
    strongest = F.max("correlation").over(Window.partitionBy())
    out = merged.withColumn("strongest", F.coalesce(F.col("correlation") == strongest, F.lit(False)))
    return sort_if(out, ordered, "lag_weeks")


# ------------------------------------------------------- half-year slopes
def month_states(rows: DataFrame, value: str) -> DataFrame:
    """A moments state of (month, value) per hospital and month: what a line over any months needs."""
    return rows.groupBy("hospital_id", "month").agg(*moments.state_of(F.col("month"), F.col(value)))


def _lines(states: DataFrame, name: str) -> DataFrame:
    """Slope and fit over the months of each half-year, per hospital."""
    out = None
    for half, where in (("h1", F.col("month") <= 6), ("h2", F.col("month") > 6)):
        line = moments.merge(states, "hospital_id", where=where).select(
            "hospital_id", round_dec(moments.slope(), 6).alias(f"{half}_{name}_slope"),
            round_dec(moments.r_squared(), 6).alias(f"{half}_{name}_r2"))
        out = line if out is None else out.join(line, "hospital_id")
    return out.withColumn(f"{name}_slope_change", round_dec(
        F.col(f"h2_{name}_slope") - F.col(f"h1_{name}_slope"), 6))


def half_year_slopes(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """The lines of satisfaction (visits) and burnout (shifts) over the months of H1 and H2.

    Least-squares slope a month and coefficient of determination per hospital, years
    pooled as in the other half-year reports; null without two different
    months in the half.  Every in-scope hospital has a row.
    """
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    v = in_scope(star.visits("hospital_id", "month", "satisfaction_score"), h)
    s = in_scope(star.staffing("hospital_id", "month", "burnout_risk_index"), h)
    out = (h.join(_lines(month_states(v, "satisfaction_score"), "satisfaction"), "hospital_id", "left")
           .join(_lines(month_states(s, "burnout_risk_index"), "burnout"), "hospital_id", "left"))
    return sort_if(out, ordered, "hospital_id")
