"""Threshold analyses of the notebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions.numeric import pct, ratio, round_dec
from wardflow.operators.reshape import sort_if
from wardflow.operators.scope import Scope, hospital_scope
from wardflow.plans.outliers import staff_metrics, visit_metrics
from wardflow.sources.star import Star

READMISSION_TARGET = 11.0  # percent
BURNOUT_LIMIT = 0.60


def threshold_flags(star: Star, scope: Scope | None = None,
                    readmission_target: float = READMISSION_TARGET,
                    burnout_limit: float = BURNOUT_LIMIT, ordered: bool = True) -> DataFrame:
    """Full-year rates per hospital and which limits they break.

    Hospitals need both visits and shifts (inner joins); flags compare the
    rounded values (T18).
    """
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    v = visit_metrics(star, h).select("hospital_id", "total_visits",
                                      F.col("readmission_rate").alias("readmission_rate_pct"))
    s = staff_metrics(star, h)
    over_r = F.col("readmission_rate_pct") > F.lit(readmission_target)
    over_b = F.col("avg_burnout_index") > F.lit(burnout_limit)
    out = (h.join(v, "hospital_id").join(s, "hospital_id").select(
        "hospital_id", "hospital_name", "total_visits", "readmission_rate_pct", "avg_burnout_index",
        over_r.alias("violates_readmission"), over_b.alias("violates_burnout"),
        (over_r & over_b).alias("violates_both")))
    return sort_if(out, ordered, F.desc_nulls_first("readmission_rate_pct"))


def half_year_shift(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """H1 (months 1-6) vs H2 (7-12) readmission % and burnout, and deltas.

    One pass over each fact with conditional aggregates instead of four
    filtered scans.  A hospital is kept only with visits *and* shifts in
    *both* halves (the source inner-joins four CTEs).  Deltas subtract the
    rounded values and round again (T18).
    """
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    first, second = F.col("month") <= 6, F.col("month") > 6

    def of(half, column):
        return F.sum(F.when(half, F.col(column)))

    def burnout(half):
        return round_dec(ratio(of(half, "burnout_sum"), of(half, "burnout_n")), 3)

    va = star.visit_states(h, "hospital_id", "month").groupBy("hospital_id").agg(
        of(first, "visits").alias("h1_n"), of(second, "visits").alias("h2_n"),
        of(first, "readmitted").alias("h1_hits"), of(second, "readmitted").alias("h2_hits"))
    sa = star.shift_states(h, "hospital_id", "month").groupBy("hospital_id").agg(
        of(first, "shifts").alias("h1_s"), of(second, "shifts").alias("h2_s"),
        burnout(first).alias("h1_burnout"), burnout(second).alias("h2_burnout"))
    j = (h.join(va.filter((F.col("h1_n") > 0) & (F.col("h2_n") > 0)), "hospital_id")
         .join(sa.filter((F.col("h1_s") > 0) & (F.col("h2_s") > 0)), "hospital_id"))
    rates = j.select(
        "hospital_id", "hospital_name",
        pct(F.col("h1_hits"), F.col("h1_n")).alias("h1_readmission_rate"),
        pct(F.col("h2_hits"), F.col("h2_n")).alias("h2_readmission_rate"),
        "h1_burnout", "h2_burnout")
    out = rates.select(
        "hospital_id", "hospital_name", "h1_readmission_rate", "h2_readmission_rate",
        round_dec(F.col("h2_readmission_rate") - F.col("h1_readmission_rate"), 2).alias("readmission_delta"),
        "h1_burnout", "h2_burnout",
        round_dec(F.col("h2_burnout") - F.col("h1_burnout"), 3).alias("burnout_delta"))
    return sort_if(out, ordered, F.desc_nulls_first("readmission_delta"))


def double_violators(star: Star, scope: Scope | None = None,
                     readmission_target: float = READMISSION_TARGET,
                     burnout_limit: float = BURNOUT_LIMIT) -> DataFrame:
    """Hospitals over both limits, per half, from R19 (one pass)."""
    t = half_year_shift(star, scope, ordered=False)
    halves = F.array(*[
        F.struct(F.lit(p.upper()).alias("period"),
                 F.col(f"{p}_readmission_rate").alias("readmission_rate"),
                 F.col(f"{p}_burnout").alias("burnout"))
        for p in ("h1", "h2")])
    return (t.select("hospital_id", "hospital_name", F.inline(halves))
            .filter((F.col("readmission_rate") > F.lit(readmission_target))
                    & (F.col("burnout") > F.lit(burnout_limit)))
            .select("period", "hospital_id", "hospital_name", "readmission_rate", "burnout"))


def burnout_violators(star: Star, scope: Scope | None = None,
                      burnout_limit: float = BURNOUT_LIMIT) -> DataFrame:
    """Hospitals whose full-year burnout breaks the limit, with the count.

    The count is a window over the flagged rows, one per hospital, so the
    facts are scanned once (a scalar subquery would scan them twice).
    """
    flagged = threshold_flags(star, scope, burnout_limit=burnout_limit, ordered=False).filter("violates_burnout")
    many = F.count(F.lit(1)).over(Window.partitionBy()).cast("bigint")
    return flagged.select("hospital_id", "hospital_name", "avg_burnout_index", "readmission_rate_pct",
                          many.alias("violator_count"))
