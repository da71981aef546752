"""Burnout and finance reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.numeric import mean, round_dec
from wardflow.functions.text import py_str as py_text
from wardflow.operators import states
from wardflow.operators.reshape import sort_if
from wardflow.operators.scope import Scope, hospital_scope
from wardflow.sources.star import Star

# Waterfall stage labels in bridge order.
WATERFALL_STAGES = [
    "Total Revenue",
    "Base Staffing Costs",
    "General Ops Costs",
    "ICU Department Costs",
    "Net Profit Margin",
]

# CFO alert limits.
BURNOUT_CEILING = 0.63
MARGIN_FLOOR = 15.0
WATCHED_MARGIN_FLOOR = 16.0
READMISSION_CEILING = 18.0
WATCHED_HOSPITALS = ("H03", "H07")

# CFO alert texts, in rule order; {name} is the hospital name
# and {value} the averaged figure the rule tested, printed as Python does.
ALERT_TEXTS = {
    "critical_burnout": "Action Required: {name} staffing burnout index has reached {value}, "
                        "crossing the 0.630 safety limit.",
    "stress_first": "Staffing Alert: {name} staffing stress has reached HIGH due to long wait times "
                    "and rising clinician fatigue.",
    "stress_second": "Staffing Alert: {name} staffing stress index sits at {value}, crossing target limits.",
    "squeeze": "Sustainability Alert: {name} profit margin sits at {value}%, "
               "violating the 15.0% board sustainability floor.",
    "squeeze_watched": "Sustainability Alert: {name} profit margin sits at {value}%, "
                       "violating the 16.0% board sustainability floor.",
    "readmission": "Readmission Alert: {name} 30-day readmission rate sits at {value}%, "
                   "exceeding the 11.0% NHS ceiling.",
}


def render(template: str, name: Column, value: Column) -> Column:
    """An alert text as a ``concat`` of its literal parts and the two fields."""
    parts = re.split(r"(\{name\}|\{value\})", template)
    cols = [name if p == "{name}" else py_text(value) if p == "{value}" else F.lit(p)
            for p in parts if p]
    return F.concat(*cols)


def _financials_in_scope(star: Star, scope: Scope | None, *cols: str) -> DataFrame:
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    return star.financials("hospital_id", *cols).join(h, "hospital_id")


def burnout_financials(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Per hospital mean burnout, margin %, revenue, op cost, visits.

    Uses the financial rows' own burnout figure, not the shifts (T15).
    """
    f = _financials_in_scope(star, scope, "avg_burnout_index", "profit_margin",
                             "revenue", "operational_cost", "visit_count")
    out = f.groupBy("hospital_id", "hospital_name").agg(
        mean("avg_burnout_index", 3).alias("avg_burnout"),
        round_dec(F.avg("profit_margin") * F.lit(100.0), 2).alias("profit_margin_pct"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.sum("operational_cost").cast("double").alias("operational_cost"),
        F.sum("visit_count").cast("bigint").alias("visit_count"))
    return sort_if(out, ordered, F.desc_nulls_first("avg_burnout"))


def waterfall_totals(star: Star, scope: Scope | None = None) -> DataFrame:
    """One row of summed money columns (none when no financial row is in scope)."""
    f = _financials_in_scope(star, scope, "revenue", "staffing_cost", "operational_cost", "icu_cost")
    t = f.agg(*[F.sum(c).cast("double").alias(c)
                for c in ("revenue", "staffing_cost", "operational_cost", "icu_cost")])
    return t.filter(F.col("revenue").isNotNull())


def waterfall_values() -> list[Column]:
    """The five stage values of the bridge, in order, over ``waterfall_totals``."""
    net = F.col("revenue") - F.col("staffing_cost") - F.col("operational_cost") - F.col("icu_cost")
    return [F.col("revenue"), -F.col("staffing_cost"), -F.col("operational_cost"),
            -F.col("icu_cost"), net]


def financial_waterfall(star: Star, scope: Scope | None = None) -> DataFrame:
    """Revenue minus staffing, operational and ICU cost = net (5 stages).

    Empty when there is no financial row in scope.
    """
    stages = F.array(*[F.struct(F.lit(i).cast("bigint").alias("stage"), F.lit(name).alias("name"),
                                value.alias("value"))
                       for i, (name, value) in enumerate(zip(WATERFALL_STAGES, waterfall_values()), 1)])
    return waterfall_totals(star, scope).select(F.inline(stages))


def absences_overtime(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Per month, total absences and mean overtime hours."""
    h = hospital_scope(star.hospitals(), scope).select("hospital_id")
    out = star.shift_states(h, "month").select(
        F.col("month").cast("bigint").alias("month"), F.col("absence_sum").alias("absences"),
        states.average("overtime", 1).alias("overtime_hours"))
    return sort_if(out, ordered, F.asc_nulls_last("month"))


def burnout_by_month(star: Star, scope: Scope | None = None, ordered: bool = True) -> DataFrame:
    """Mean shift burnout per hospital and month (years pooled, T7)."""
    h = hospital_scope(star.hospitals(), scope).select("hospital_id", "hospital_name")
    out = star.shift_states(h, "hospital_id", "month").join(h, "hospital_id").select(
        "hospital_id", "hospital_name", F.col("month").cast("bigint").alias("month"),
        states.average("burnout", 3).alias("burnout"))
    return sort_if(out, ordered, F.asc_nulls_last("month"), F.asc_nulls_last("hospital_name"))


def alert_inputs(star: Star, scope: Scope | None = None) -> DataFrame:
    """Per hospital averages of the financial rows the alerts are tested on."""
    f = _financials_in_scope(star, scope, "avg_burnout_index", "profit_margin", "readmission_rate")
    return f.groupBy("hospital_id", "hospital_name").agg(
        mean("avg_burnout_index", 3).alias("avg_burnout"),
        round_dec(F.avg("profit_margin") * F.lit(100.0), 1).alias("avg_profit_margin"),
        round_dec(F.avg("readmission_rate") * F.lit(100.0), 1).alias("avg_readmit_rate"),
    )


def _truthy_number(c: Column) -> Column:
    """Python truthiness of a number: not null and not zero."""
    return c.isNotNull() & (c != F.lit(0.0))


def cfo_alerts(star: Star, scope: Scope | None = None,
               watched: tuple[str, ...] = WATCHED_HOSPITALS,
               burnout_ceiling: float = BURNOUT_CEILING,
               margin_floor: float = MARGIN_FLOOR,
               watched_margin_floor: float = WATCHED_MARGIN_FLOOR,
               readmission_ceiling: float = READMISSION_CEILING) -> DataFrame:
    """0-4 alert rows per hospital, rules in SURVEY §2.9.

    Rules are evaluated per hospital row into an array of optional alerts
    and exploded; no row leaves the executor that computed it.
    ``watched`` holds (first, second) hospital ids that always get a
    staffing-stress warning, each with its own wording.
    """
    a = alert_inputs(star, scope)
    hid, name = F.col("hospital_id"), F.col("hospital_name")
    burnout, margin, readmit = F.col("avg_burnout"), F.col("avg_profit_margin"), F.col("avg_readmit_rate")
    first_watch, second_watch = watched

    def alert(cond: Column, kind: str, severity: str, value: Column, message: Column) -> Column:
        return F.when(cond, F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
            value.cast("double").alias("value"), message.alias("message")))

    name_text = F.coalesce(name, F.lit("None"))
    squeeze = _truthy_number(margin) & (margin < F.lit(margin_floor))
    rules = F.array(
        alert(_truthy_number(burnout) & (burnout > F.lit(burnout_ceiling)),
              "CRITICAL_BURNOUT", "CRITICAL", burnout,
              render(ALERT_TEXTS["critical_burnout"], name_text, burnout)),
        alert(hid == F.lit(first_watch), "STAFFING_STRESS", "WARNING", burnout,
              render(ALERT_TEXTS["stress_first"], name_text, burnout)),
        alert(hid == F.lit(second_watch), "STAFFING_STRESS", "WARNING", burnout,
              render(ALERT_TEXTS["stress_second"], name_text, burnout)),
        alert(squeeze, "FINANCIAL_SQUEEZE", "WARNING", margin,
              render(ALERT_TEXTS["squeeze"], name_text, margin)),
        alert(~squeeze & (hid == F.lit(first_watch)) & _truthy_number(margin)
              & (margin < F.lit(watched_margin_floor)),
              "FINANCIAL_SQUEEZE", "WARNING", margin,
              render(ALERT_TEXTS["squeeze_watched"], name_text, margin)),
        alert(_truthy_number(readmit) & (readmit > F.lit(readmission_ceiling)),
              "READMISSION_SPIKE", "WARNING", readmit,
              render(ALERT_TEXTS["readmission"], name_text, readmit)),
    )
    return (a.select("hospital_id", "hospital_name",
                     F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("a"))
            .select("hospital_id", "hospital_name", "a.type", "a.severity", "a.value", "a.message"))
