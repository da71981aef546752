"""Overview reports (R1-R5): system-wide volumes and headline KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.operators import states
from wardflow.operators.reshape import sort_if, text_order
from wardflow.operators.scope import Scope, hospital_scope, in_scope
from wardflow.sources.star import Star


def kpis(star: Star, scope: Scope | None = None) -> DataFrame:
    """Visits, readmission %, mean wait and mean burnout (one row).

    Burnout comes from the shifts alone (a scalar subquery, no fan-out).
    An empty selection gives zeros, as the dashboard intends (T2).
    """
    h = hospital_scope(star.hospitals(), scope)
    burnout = star.shift_states(h).select(states.average("burnout", 3).alias("b")).scalar()
    empty = F.col("visits") == 0
    return star.visit_states(h).select(
        F.col("visits").alias("total_visits"),
        F.when(empty, F.lit(0.0)).otherwise(states.readmission_rate()).alias("readmission_rate"),
        F.when(empty, F.lit(0.0)).otherwise(states.average("wait", 1)).alias("avg_wait_time"),
        F.when(empty, F.lit(0.0)).otherwise(burnout).alias("avg_burnout_index"),
    )


def visits_over_time(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """R2: visits per arrival ``YYYY-MM`` (null arrivals form a null month)."""
    h = hospital_scope(star.hospitals(), scope)
    out = star.visit_states(h, "month_text").select(F.col("month_text").alias("month"), "visits")
    return sort_if(out, ordered, F.asc_nulls_last("month"))


def visits_by_department(star: Star, scope: Scope | None = None, ordered: bool = True,
                         collation: str | None = None) -> DataFrame:
    """R3 (flat): visits per hospital name x department name; names in binary order or a collation's."""
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    d = star.dim("dim_department").select("department_id", "department_name")
    out = (star.visit_states(h, "hospital_id", "department_id").join(h, "hospital_id")
           .join(d, "department_id")
           .groupBy("hospital_name", "department_name")
           .agg(F.sum("with_id").cast("bigint").alias("visits")))
    return sort_if(out, ordered, text_order("hospital_name", collation).asc_nulls_last(), F.desc_nulls_first("visits"))


def visits_treemap(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """One row per hospital with its departments as an ordered list.

    ``children`` is ``array<struct<name, value>>`` ordered by visits
    descending; a hospital's list is bounded by the department dimension.
    """
    flat = visits_by_department(star, scope, ordered=False)
    by_visits = F.array_sort(
        F.collect_list(F.struct((-F.col("visits")).alias("k"),
                                F.col("department_name").alias("name"),
                                F.col("visits").alias("value"))))
    out = (flat.groupBy(F.col("hospital_name").alias("name"))
           .agg(by_visits.alias("c"))
           .select("name", F.transform("c", lambda x: F.struct(
               x["name"].alias("name"), x["value"].alias("value"))).alias("children")))
    return sort_if(out, ordered, F.asc_nulls_last("name"))


def visits_treemap_text(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """R3 with the ordered children as text, ``name=visits`` joined by commas."""
    nested = visits_treemap(star, scope, ordered)
    return nested.select("name", F.array_join(F.transform("children", lambda x: F.concat_ws(
        "=", x["name"], x["value"].cast("string"))), ", ").alias("children"))


def visits_treemap_json(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """R3 with the ordered children as JSON, the form in which the page gets them."""
    return visits_treemap(star, scope, ordered).select("name", F.to_json("children").alias("children"))


def daily_counts(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Visits per arrival date as ``YYYY-MM-DD`` text."""
    h = hospital_scope(star.hospitals(), scope)
    v = in_scope(star.visits("hospital_id", "arrival_datetime"), h)
    out = (v.groupBy(F.to_date("arrival_datetime").cast("string").alias("date"))
           .agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    return sort_if(out, ordered, F.asc_nulls_last("date"))


def hourly_arrivals(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Visits per hour of arrival."""
    h = hospital_scope(star.hospitals(), scope)
    v = in_scope(star.visits("hospital_id", "arrival_datetime"), h)
    out = (v.groupBy(F.hour("arrival_datetime").cast("bigint").alias("hour"))
           .agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    return sort_if(out, ordered, F.asc_nulls_last("hour"))


__all__ = ["kpis", "visits_over_time", "visits_by_department", "visits_treemap",
           "daily_counts", "hourly_arrivals"]
