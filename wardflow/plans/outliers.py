"""Outlier reports (R6-R9): per-hospital scatter, monthly ranks, flows, waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions.numeric import mean
from wardflow.operators import states
from wardflow.operators.reshape import sort_if
from wardflow.operators.scope import Scope, hospital_scope, in_scope
from wardflow.sources.star import Star


def visit_metrics(star: Star, hospitals: DataFrame, period: str | None = None) -> DataFrame:
    """Per-hospital visit aggregates (the ``visit_metrics`` CTE)."""
    v = star.visit_states(hospitals, "hospital_id", period=period)
    return v.select("hospital_id", F.col("with_id").alias("total_visits"),
                    states.readmission_rate().alias("readmission_rate"),
                    states.average("wait", 1).alias("avg_wait_time"),
                    states.average("satisfaction", 1).alias("avg_satisfaction"))


def staff_metrics(star: Star, hospitals: DataFrame, period: str | None = None) -> DataFrame:
    """Per-hospital mean burnout of shifts (the ``staff_metrics`` CTE)."""
    s = star.shift_states(hospitals, "hospital_id", period=period)
    return s.select("hospital_id", states.average("burnout", 3).alias("avg_burnout_index"))


def hospital_outliers(star: Star, scope: Scope | None = None, period: str | None = None,
                      ordered: bool = True) -> DataFrame:
    """Every in-scope hospital with visit and shift metrics; zeros if none.

    Both facts are reduced to in-scope hospitals and aggregated to one row
    per hospital before the (hospital-sized) left joins.
    """
    h = hospital_scope(star.hospitals(), scope).select(
        "hospital_id", "hospital_name", "nhs_trust_type", "city", "staffing_stress")
    v = visit_metrics(star, h, period)
    s = staff_metrics(star, h, period)
    zero = F.lit(0.0)
    out = (h.join(v, "hospital_id", "left").join(s, "hospital_id", "left").select(
        "hospital_id", "hospital_name", "nhs_trust_type", "city",
        F.coalesce("total_visits", F.lit(0).cast("bigint")).alias("total_visits"),
        F.coalesce("readmission_rate", zero).alias("readmission_rate"),
        F.coalesce("avg_wait_time", zero).alias("avg_wait_time"),
        F.coalesce("avg_satisfaction", zero).alias("avg_satisfaction"),
        F.coalesce("avg_burnout_index", zero).alias("avg_burnout_index"),
        "staffing_stress",
    ))
    return sort_if(out, ordered, F.desc_nulls_first("readmission_rate"))


def bump_rankings(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Monthly readmission % per hospital and its dense rank in the month.

    The rank is over the *rounded* rate (T9) and only among the filtered
    hospitals.  The window runs on the (months x hospitals) aggregate.
    """
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    monthly = star.visit_states(h, "hospital_id", "month").join(h, "hospital_id").withColumn(
        "readmission_rate", states.readmission_rate())
    w = Window.partitionBy("month").orderBy(F.desc_nulls_first("readmission_rate"))
    out = monthly.select(
        F.col("month").cast("bigint").alias("month"), "hospital_id", "hospital_name",
        "readmission_rate", F.dense_rank().over(w).cast("bigint").alias("rank"))
    return sort_if(out, ordered, F.asc_nulls_last("month"), F.asc_nulls_last("rank"))


def _severity_node(level) -> F.Column:
    return F.concat(F.lit("Severity "), level.cast("int").cast("string"))


def _flows(star: Star, scope: Scope | None, hospital_id: str | None) -> DataFrame:
    """Counts per (hospital, admission, severity, outcome): one scan of visits."""
    scope = scope or Scope()
    h = hospital_scope(star.hospitals(), scope.without_hospital())
    if hospital_id:
        h = h.filter(F.col("hospital_id") == F.lit(hospital_id))
    v = in_scope(star.visits("hospital_id", "admission_type", "severity_level", "outcome"), h)
    return (v.groupBy("hospital_id", "admission_type", "severity_level", "outcome")
            .agg(F.count(F.lit(1)).alias("n")))


def _links(star: Star, scope: Scope | None, hospital_id: str | None) -> DataFrame:
    """Flow counts per (hospital, source node, target node).

    Each (admission, severity, outcome) count emits its two links and the
    links are re-aggregated: one scan of visits, one tiny second shuffle.
    """
    flows = _flows(star, scope, hospital_id)
    severity = _severity_node(F.col("severity_level"))
    both = F.array(
        F.struct(F.col("admission_type").alias("source_node"), severity.alias("target_node")),
        F.struct(severity.alias("source_node"), F.col("outcome").alias("target_node")))
    return (flows.select("hospital_id", "n", F.inline(both))
            .filter(F.col("source_node").isNotNull() & F.col("target_node").isNotNull())
            .groupBy("hospital_id", "source_node", "target_node")
            .agg(F.sum("n").cast("bigint").alias("value")))


def sankey_dropped(star: Star, hospital_id: str | None = None, scope: Scope | None = None) -> DataFrame:
    """Visits per hospital left out of each flow hop for a null end."""
    flows = _flows(star, scope, hospital_id)
    first_gap = F.col("admission_type").isNull() | F.col("severity_level").isNull()
    second_gap = F.col("severity_level").isNull() | F.col("outcome").isNull()
    return flows.groupBy("hospital_id").agg(
        F.coalesce(F.sum(F.when(first_gap, F.col("n"))), F.lit(0)).cast("bigint").alias("dropped_admission_links"),
        F.coalesce(F.sum(F.when(second_gap, F.col("n"))), F.lit(0)).cast("bigint").alias("dropped_outcome_links"))


def _node_names(links: DataFrame) -> F.Column:
    """Sorted distinct node names of a hospital (bounded by the categories)."""
    return F.array_sort(F.array_distinct(F.concat(
        F.collect_set("source_node"), F.collect_set("target_node"))))


def sankey_links(star: Star, hospital_id: str | None = None, scope: Scope | None = None) -> DataFrame:
    """R8 links: admission -> severity and severity -> outcome flow counts.

    With ``hospital_id`` it is the single-hospital report; without it, every
    in-scope hospital's flows at once (keyed by ``hospital_id``).  Node
    indexes are positions in the hospital's sorted node-name list, found
    with a window over the hospital's links (no self-join).  Links with a
    null end are left out (T12).
    """
    links = _links(star, scope, hospital_id)
    w = Window.partitionBy("hospital_id")
    names = F.array_sort(F.array_distinct(F.concat(
        F.collect_set("source_node").over(w), F.collect_set("target_node").over(w))))
    return (links.withColumn("names", names).select(
        "hospital_id", "source_node", "target_node",
        (F.array_position("names", F.col("source_node")) - 1).cast("bigint").alias("source"),
        (F.array_position("names", F.col("target_node")) - 1).cast("bigint").alias("target"),
        "value"))


def sankey_nodes(star: Star, hospital_id: str | None = None, scope: Scope | None = None) -> DataFrame:
    """R8 nodes: sorted distinct node names per hospital with their index."""
    links = _links(star, scope, hospital_id)
    return (links.groupBy("hospital_id").agg(_node_names(links).alias("names"))
            .select("hospital_id", F.posexplode("names").alias("node_index", "name"))
            .select("hospital_id", F.col("node_index").cast("bigint").alias("node_index"), "name"))


def severity_weekday_wait(star: Star, hospital_id: str | None = None,
                          scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Mean wait per severity x weekday (arrival date joined to the calendar).

    Arrivals outside the calendar or without a date drop out (inner join,
    T11).  Without ``hospital_id`` every in-scope hospital is reported.
    """
    scope = scope or Scope()
    h = hospital_scope(star.hospitals(), scope.without_hospital())
    if hospital_id:
        h = h.filter(F.col("hospital_id") == F.lit(hospital_id))
    v = in_scope(star.visits("hospital_id", "arrival_datetime", "severity_level", "wait_time_minutes"), h)
    cal = star.calendar().select("full_date", "day_of_week", "day_number")
    joined = v.join(cal, F.to_date(v["arrival_datetime"]) == cal["full_date"])
    out = (joined.groupBy("hospital_id", "severity_level", "day_of_week", "day_number")
            .agg(mean("wait_time_minutes", 1).alias("avg_wait"))
            .select("hospital_id",
                    F.col("severity_level").cast("bigint").alias("severity"),
                    F.col("day_of_week").alias("weekday"),
                    F.col("day_number").cast("bigint").alias("day_num"),
                    "avg_wait"))
    return sort_if(out, ordered, F.asc_nulls_last("hospital_id"), F.asc_nulls_last("severity"),
                   F.asc_nulls_last("day_num"))


__all__ = ["visit_metrics", "staff_metrics", "hospital_outliers", "bump_rankings",
           "sankey_links", "sankey_nodes", "severity_weekday_wait"]
