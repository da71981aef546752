"""Sector reports (R10-R12): NHS vs private profiles, wait divergence, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.numeric import pct, round_dec
from wardflow.operators.fanout import FactSide, fanout_sums, weighted_mean
from wardflow.operators.reshape import sort_if
from wardflow.operators.scope import Scope, hospital_scope, in_scope
from wardflow.sources.star import Star

# Radar axes (key, label) in display order.
RADAR_AXES = [
    ("wait_time", "Wait Time (min)"),
    ("satisfaction", "Satisfaction (%)"),
    ("burnout", "Burnout Index"),
    ("readmission", "Readmissions (%)"),
    ("profit_margin", "Profit Margin (%)"),
    ("icu_rate", "ICU Admits (%)"),
]

NETWORK_WAIT_BENCHMARK = 61.4  # minutes; a constant of the report (T14)


def _visit_side(star: Star, hospitals: DataFrame) -> FactSide:
    return FactSide("v", star.visit_states(hospitals, "hospital_id", "month"),
                    measures=["wait_time_minutes", "satisfaction_score"], flags=["readmission_30_days_flag", "icu_required_flag"],
                    states={"rows": "visits", "wait_time_minutes": "wait", "satisfaction_score": "satisfaction",
                            "readmission_30_days_flag": "readmitted", "icu_required_flag": "icu"})


def _shift_side(star: Star, hospitals: DataFrame) -> FactSide:
    return FactSide("s", star.shift_states(hospitals, "hospital_id", "month"), measures=["burnout_risk_index"],
                    states={"rows": "shifts", "burnout_risk_index": "burnout"})


def sector_metrics(star: Star, scope: Scope | None = None) -> DataFrame:
    """The grouped row per ``private`` value behind R10 (fan-out weighted, T4)."""
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "private")
    visits, shifts = _visit_side(star, h), _shift_side(star, h)
    money = FactSide("f", in_scope(star.financials("hospital_id", "month", "profit_margin"), h),
                     measures=["profit_margin"])
    sums = fanout_sums(h, visits, [shifts, money], ["private"])
    return sums.select(
        "private",
        round_dec(weighted_mean("wait_time_minutes"), 1).alias("wait_time"),
        round_dec(weighted_mean("satisfaction_score"), 1).alias("satisfaction"),
        round_dec(weighted_mean("burnout_risk_index"), 3).alias("burnout"),
        pct(F.col("hits__readmission_30_days_flag"), F.col("rows")).alias("readmission"),
        round_dec(weighted_mean("profit_margin") * F.lit(100.0), 1).alias("profit_margin"),
        pct(F.col("hits__icu_required_flag"), F.col("rows")).alias("icu_rate"),
    )


def radar_profiles(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Six axes with an NHS and a Private value each.

    A sector with no row gives 0.0; a null ``private`` is read as NHS, after
    the ``private = false`` row (T19).
    """
    m = sector_metrics(star, scope)
    nhs_rank = F.when(F.col("private") == F.lit(False), 2).when(F.col("private").isNull(), 1).otherwise(0)
    pvt_rank = F.when(F.col("private"), 1).otherwise(0)

    def pick(key: str, rank) -> F.Column:
        return F.when(F.max(rank) > 0, F.max_by(key, rank)).otherwise(F.lit(0.0))

    # A global aggregate always yields one row, so all six axes exist even
    # when the selection is empty (both sectors then read 0.0).
    one = m.agg(*[c for key, _ in RADAR_AXES
                  for c in (pick(key, nhs_rank).alias(f"nhs_{key}"), pick(key, pvt_rank).alias(f"pvt_{key}"))])
    stack = ", ".join(f"{i}L, '{label}', nhs_{key}, pvt_{key}"
                      for i, (key, label) in enumerate(RADAR_AXES, 1))
    out = one.select(F.expr(f"stack({len(RADAR_AXES)}, {stack}) AS (axis, subject, NHS, Private)"))
    return sort_if(out, ordered, "axis")


def diverging_wait(star: Star, scope: Scope | None = None,
                   benchmark: float = NETWORK_WAIT_BENCHMARK, ordered: bool = True) -> DataFrame:
    """Mean wait per hospital and its distance from a fixed benchmark.

    Visits are pre-aggregated per hospital before the join; hospitals
    without visits keep a null mean.  The divergence rounds the unrounded
    mean minus the benchmark (T18).
    """
    h = hospital_scope(star.hospitals(), scope).select(
        "hospital_id", "hospital_name", "nhs_trust_type", "private")
    v = star.visit_states(h, "hospital_id")
    avg = F.try_divide(F.col("wait_sum"), F.col("wait_n").cast("double"))
    out = h.join(v, "hospital_id", "left").select(
        "hospital_id", "hospital_name", "nhs_trust_type", "private",
        round_dec(avg, 1).alias("avg_wait_time"),
        round_dec(avg - F.lit(benchmark), 1).alias("divergence"))
    return sort_if(out, ordered, F.desc_nulls_first("avg_wait_time"))


def regional_choropleth(star: Star, scope: Scope | None = None) -> DataFrame:
    """Readmission %, mean wait and mean burnout per region (fan-out weighted)."""
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "region_id")
    r = star.regions().select("region_id", "region_name")
    hr = h.join(r, "region_id")
    visits, shifts = _visit_side(star, h), _shift_side(star, h)
    sums = fanout_sums(hr, visits, [shifts], ["region_id", "region_name"])
    return sums.select(
        "region_id", "region_name",
        pct(F.col("hits__readmission_30_days_flag"), F.col("rows")).alias("readmission_rate"),
        round_dec(weighted_mean("wait_time_minutes"), 1).alias("avg_wait_time"),
        round_dec(weighted_mean("burnout_risk_index"), 3).alias("avg_burnout"),
    )
