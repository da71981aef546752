"""Page-side reshapes of the reports (§2.9, P1-P23) as DataFrame operators.

Every operator takes a report's output (small: hospitals x months x
categories) and reshapes it.  Windows are partitioned by the report's own
key (hospital, year); the few without a partition key run over outputs of
a fixed size (five waterfall stages) or bounded by the hospital dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.functions import bands
from wardflow.functions.numeric import js_round, round_dec
from wardflow.functions.text import (
    clean_facility_name, currency, first_underscore_to_space, fixed, month_short_name, short_hospital_name, weekday_short,
)
from wardflow.operators.reshape import keyed, spread, text_order
from wardflow.operators.scope import Scope, focus_flag, hospital_scope, search
from wardflow.plans import finance, outliers, overview, sector
from wardflow.sources.star import Star

# Business order of departments in the stacked view (P1);
# departments not listed follow, by name.
DEPARTMENT_ORDER = [
    "Emergency Department",
    "General Medicine",
    "Cardiology",
    "Intensive Care Unit",
    "Surgery",
    "Paediatrics",
    "Respiratory",
    "Neurology",
    "Oncology",
    "Orthopaedics",
    "Mental Health",
    "Geriatrics",
]

# Weekday columns of the severity grid (P10), and its
# severity rows from 5 down to 1.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEVERITY_ROWS = [5, 4, 3, 2, 1]

# Unit of each radar axis for the sector gap text.
AXIS_UNITS = {
    "Wait Time (min)": ("min", 1),
    "Satisfaction (%)": ("%", 1),
    "Burnout Index": ("index", 3),
    "Readmissions (%)": ("%", 1),
    "Profit Margin (%)": ("%", 1),
    "ICU Admits (%)": ("%", 1),
}


def ordered_departments(names: list[str]) -> list[str]:
    rank = {d: i for i, d in enumerate(DEPARTMENT_ORDER)}
    return sorted(names, key=lambda d: (rank.get(d, len(rank)), d))


# ---------------------------------------------------------------- overview
def department_map(star: Star, scope: Scope | None = None) -> DataFrame:
    """A row per hospital with its visits by department name."""
    flat = overview.visits_by_department(star, scope, ordered=False)
    rows = keyed(flat, ["hospital_name"], "department_name", F.sum("visits").cast("bigint"), "departments")
    return rows.select(short_hospital_name("hospital_name").alias("name"), "hospital_name", "departments")


def department_pivot(star: Star, scope: Scope | None = None, departments: Sequence[str] | None = None) -> DataFrame:
    """P1 with a column for each of the given departments, in business order (missing = 0).

    Without a list the departments stay a map: columns never come from the data.
    """
    rows = department_map(star, scope)
    if departments is None:
        return rows
    cells = spread("departments", ordered_departments(list(departments)), F.lit(0).cast("bigint"))
    return rows.select("name", "hospital_name", *cells)


def department_totals(star: Star, scope: Scope | None = None) -> DataFrame:
    """Visits per department summed over the hospitals' nested lists
    (the totals that order the stacked view)."""
    tree = overview.visits_treemap(star, scope, ordered=False)
    return (tree.select(F.inline("children"))
            .groupBy(F.col("name").alias("department_name"))
            .agg(F.sum("value").cast("bigint").alias("visits"))
            .orderBy(F.desc("visits"), "department_name"))


def department_stack(star: Star, scope: Scope | None = None) -> DataFrame:
    """departments in business order, those not listed last by name, with their place and visits."""
    listed = F.array(*[F.lit(d) for d in DEPARTMENT_ORDER])
    rank = F.coalesce(F.nullif(F.array_position(listed, F.col("department_name")), F.lit(0)), F.lit(999))
    totals = department_totals(star, scope).withColumn("rank", rank)
    # one row per department reaches this window
    place = F.row_number().over(Window.orderBy("rank", "department_name")).cast("bigint")
    return totals.select(place.alias("place"), "department_name", "visits").orderBy("place")


def department_labels(star: Star) -> DataFrame:
    """Department ids as labels, the first underscore a space."""
    return star.dim("dim_department").select("department_id", first_underscore_to_space("department_id").alias("label"))


def calendar_heatmap(star: Star, scope: Scope | None = None, year: str | None = None) -> DataFrame:
    """P2 + P3: daily counts laid out in blocks of 7 *present* days per year.

    ``week_index``/``day_slot`` place a day; ``month_label`` names the month
    on the first day of a block whose month differs from the block before
    (gaps shift the grid, as on the page).  ``year`` filters (B5).
    """
    daily = overview.daily_counts(star, scope, ordered=False).withColumn("year", F.substring("date", 1, 4))
    if year:
        daily = daily.filter(F.col("year") == F.lit(str(year)))
    w = Window.partitionBy("year").orderBy("date")
    rn = F.row_number().over(w) - 1
    laid = daily.select("date", "year", "count", rn.alias("rn"),
                        F.substring("date", 6, 2).cast("int").alias("m"))
    prev_block_month = F.lag("m", 7).over(w)
    slot = F.col("rn") % 7
    return laid.select(
        "date", "year", "count",
        bands.intensity_band("count").cast("bigint").alias("band"),
        F.floor(F.col("rn") / 7).cast("bigint").alias("week_index"),
        slot.cast("bigint").alias("day_slot"),
        F.when((slot == 0) & (prev_block_month.isNull() | (prev_block_month != F.col("m"))),
               month_short_name(F.col("m"))).alias("month_label"))


def kpi_target_gap(star: Star, scope: Scope | None = None,
                   target: float = bands.READMISSION_TARGET) -> DataFrame:
    """P5: KPIs with the readmission excess over target (null = within)."""
    k = overview.kpis(star, scope)
    return k.select("*", bands.target_gap("readmission_rate", target).alias("excess_points"),
                    (F.col("readmission_rate") <= F.lit(target)).alias("within_target"))


def kpi_labels(star: Star, scope: Scope | None = None) -> DataFrame:
    """The headline figures as the page prints them: thousands separators, fixed decimals."""
    return overview.kpis(star, scope).select(
        fixed("total_visits", 0).alias("total_visits"), F.concat(fixed("readmission_rate", 2), F.lit("%")).alias("readmission_rate"),
        F.concat(fixed("avg_wait_time", 1), F.lit(" min")).alias("avg_wait_time"), fixed("avg_burnout_index", 3).alias("avg_burnout_index"))


def waterfall_labels(star: Star, scope: Scope | None = None) -> DataFrame:
    """The stages of the cost bridge as money, the sign before the symbol."""
    return finance.financial_waterfall(star, scope).select("stage", "name", currency("value").alias("label"))


def filter_options(star: Star) -> DataFrame:
    """The dashboard's filter menus from the dimensions: regions, trust types
    and hospitals, each value with its display label (G16: the name, or the
    code when the name is missing)."""
    h = star.hospitals()
    r = star.regions()
    regions = r.select(F.lit("region").alias("kind"), F.col("region_id").alias("value"),
                       F.coalesce("region_name", "region_id").alias("label"))
    trusts = (h.select(F.lit("trust_type").alias("kind"), F.col("nhs_trust_type").alias("value"))
              .filter(F.col("value").isNotNull()).distinct()
              .withColumn("label", F.col("value")))
    hospitals = h.select(F.lit("hospital").alias("kind"), F.col("hospital_id").alias("value"),
                         F.coalesce("hospital_name", "hospital_id").alias("label"))
    return regions.unionByName(trusts).unionByName(hospitals)


def department_families(star: Star) -> DataFrame:
    """Department family by name rules, else a stable hash bucket."""
    d = star.dim("dim_department")
    return d.select("department_id", "department_name",
                    bands.department_family("department_name").alias("family"))


# ---------------------------------------------------------------- outliers
def readmission_month_map(star: Star, scope: Scope | None = None) -> DataFrame:
    """A row per month with the readmission % by hospital id."""
    bump = outliers.bump_rankings(star, scope, ordered=False)
    return keyed(bump, ["month"], "hospital_id", F.max("readmission_rate"), "rates").orderBy("month")


def readmission_month_pivot(star: Star, scope: Scope | None = None, hospital_ids: Sequence[str] | None = None) -> DataFrame:
    """P6 with a column for each of the given hospital ids; a map without a list."""
    rows = readmission_month_map(star, scope)
    return rows if hospital_ids is None else rows.select("month", *spread("rates", hospital_ids))


def sankey_node_stats(star: Star, hospital_id: str | None = None,
                      scope: Scope | None = None) -> DataFrame:
    """P7 + P8 + P9: per node its stage, throughput (in + out) and warning.

    The stage comes from the link side (severity = 1, target of a severity
    link = 2, else 0) with the fixed outcome list as fallback.
    """
    links = outliers.sankey_links(star, hospital_id, scope)
    ends = links.select("hospital_id", F.inline(F.array(
        F.struct(F.col("source_node").alias("name"), F.col("source").alias("node_index"),
                 F.col("value").alias("v_out"), F.lit(0).cast("bigint").alias("v_in"),
                 F.lit(False).alias("as_outcome")),
        F.struct(F.col("target_node").alias("name"), F.col("target").alias("node_index"),
                 F.lit(0).cast("bigint").alias("v_out"), F.col("value").alias("v_in"),
                 F.col("source_node").startswith("Severity").alias("as_outcome")))))
    nodes = ends.groupBy("hospital_id", "node_index", "name").agg(
        F.sum("v_in").alias("v_in"), F.sum("v_out").alias("v_out"),
        F.max("as_outcome").alias("as_outcome"))
    total = F.col("v_in") + F.col("v_out")
    stage = (F.when(F.col("name").startswith("Severity"), F.lit(1))
             .when(F.col("as_outcome") | F.col("name").isin(*bands.OUTCOME_NODES), F.lit(2))
             .otherwise(F.lit(0)))
    return nodes.select("hospital_id", "node_index", "name",
                        stage.cast("bigint").alias("stage"),
                        F.when(total == 0, F.lit(5)).otherwise(total).cast("bigint").alias("value"),
                        bands.flow_warning("name").alias("is_warning"))


def sankey_link_shares(star: Star, hospital_id: str | None = None,
                       scope: Scope | None = None) -> DataFrame:
    """P8 + P9: each link's share of its source node's throughput."""
    links = outliers.sankey_links(star, hospital_id, scope)
    nodes = sankey_node_stats(star, hospital_id, scope).select(
        "hospital_id", F.col("node_index").alias("source"), F.col("value").alias("source_value"))
    return links.join(nodes, ["hospital_id", "source"]).select(
        "hospital_id", "source_node", "target_node", "value",
        round_dec(F.col("value") / F.col("source_value"), 6).alias("share"),
        bands.flow_warning("target_node").alias("is_warning"))


def severity_weekday_grid(star: Star, hospital_id: str | None = None,
                          scope: Scope | None = None) -> DataFrame:
    """P10 + P11: the full 5 x 7 severity/weekday grid per hospital.

    The grid is generated per hospital row (explode of two fixed lists, no
    join of cross products) and left-joined to the measured cells.
    """
    scope = scope or Scope()
    h = hospital_scope(star.hospitals(), scope.without_hospital())
    if hospital_id:
        h = h.filter(F.col("hospital_id") == F.lit(hospital_id))
    grid = (h.select("hospital_id",
                     F.explode(F.array(*[F.lit(s) for s in SEVERITY_ROWS])).alias("severity"))
            .select("hospital_id", F.col("severity").cast("bigint").alias("severity"),
                    F.posexplode(F.array(*[F.lit(d) for d in WEEKDAYS])).alias("pos", "weekday"))
            .select("hospital_id", "severity", "weekday",
                    (F.col("pos") + 1).cast("bigint").alias("day_num")))
    cells = outliers.severity_weekday_wait(star, hospital_id, scope, ordered=False).select(
        "hospital_id", "severity", "weekday", "avg_wait")
    wait = F.col("avg_wait")
    truthy = wait.isNotNull() & (wait != 0)
    return grid.join(cells, ["hospital_id", "severity", "weekday"], "left").select(
        "hospital_id", "severity", "weekday", weekday_short("weekday").alias("day"), "day_num", "avg_wait",
        bands.wait_band("avg_wait").alias("wait_band"),
        F.when(truthy, F.concat(js_round(wait).cast("string"), F.lit("m"))).otherwise(F.lit("-"))
        .alias("label"))


def scatter_focus(star: Star, focus_id: str = "H07", scope: Scope | None = None) -> DataFrame:
    """The financial bubble rows with the focus hospital marked."""
    return focus_flag(finance.burnout_financials(star, scope, ordered=False), focus_id)


# ------------------------------------------------------------------ sector
def facility_ledger(star: Star, scope: Scope | None = None, period: str | None = None,
                    text: str | None = None, sort_by: str = "readmission_rate",
                    ascending: bool = False, collation: str | None = None) -> DataFrame:
    """The outlier table with sector flag, recalculated staffing
    stress, readmission band against the listed hospitals' mean, optional
    search (B6) and sort (F2).  The mean is of the whole list; the search
    only picks what is shown.  Text sorts without regard to case, or by ``collation``.
    """
    t = outliers.hospital_outliers(star, scope, period, ordered=False)
    t = t.select(
        "hospital_id", "hospital_name", "nhs_trust_type", "city", "total_visits",
        "readmission_rate", "avg_wait_time", "avg_satisfaction", "avg_burnout_index",
        bands.is_private_trust("nhs_trust_type").alias("private"),
        bands.stress_score("avg_burnout_index", "avg_wait_time", "readmission_rate")
        .cast("bigint").alias("stress_score"),
        bands.stress_level("avg_burnout_index", "avg_wait_time", "readmission_rate",
                           "staffing_stress").alias("staffing_stress"))
    # one row per hospital reaches this window; a scalar subquery would scan the facts twice
    mean = F.avg("readmission_rate").over(Window.partitionBy())
    t = t.withColumn("readmission_band", bands.readmission_band("readmission_rate", mean))
    t = search(t, text, "hospital_name", "city")
    key = _sort_key(t, sort_by, collation)
    return t.orderBy(key.asc() if ascending else key.desc())


def _sort_key(t: DataFrame, sort_by: str, collation: str | None = None) -> Column:
    if dict(t.dtypes)[sort_by] != "string":
        return F.col(sort_by)
    return text_order(sort_by, collation) if collation else F.lower(F.col(sort_by))


def ledger_places(star: Star, scope: Scope | None = None, sort_by: str = "hospital_name", ascending: bool = True,
                  collation: str | None = None) -> DataFrame:
    """the ledger's hospitals with their places under a chosen sort; equal keys by hospital id."""
    t = facility_ledger(star, scope)
    key = _sort_key(t, sort_by, collation)
    # one row per hospital reaches this window
    place = F.row_number().over(Window.orderBy(key.asc() if ascending else key.desc(), "hospital_id")).cast("bigint")
    return t.select(place.alias("place"), "hospital_id", "hospital_name", "city").orderBy("place")


def diverging_bars(star: Star, scope: Scope | None = None) -> DataFrame:
    """R11 as the sector page charts it: facility names shortened."""
    d = sector.diverging_wait(star, scope, ordered=False)
    out = d.withColumn("hospital_name", clean_facility_name("hospital_name"))
    return out.orderBy(F.desc_nulls_first("avg_wait_time"))


def regional_alarms(star: Star, scope: Scope | None = None) -> DataFrame:
    """Regions with the readmission alarm flag and whole-minute wait."""
    r = sector.regional_choropleth(star, scope)
    return r.select("*", bands.regional_alarm("readmission_rate").alias("alarm"),
                    js_round("avg_wait_time").alias("wait_minutes"))


# Least and most of each radar axis as the sector page draws it.
AXIS_RANGES = {
    "Wait Time (min)": (45.0, 90.0),
    "Satisfaction (%)": (62.0, 62.7),
    "Burnout Index": (0.588, 0.598),
    "Readmissions (%)": (16.5, 17.4),
    "Profit Margin (%)": (20.0, 30.0),
    "ICU Admits (%)": (16.0, 17.0),
}


def sector_gap(star: Star, scope: Scope | None = None,
               ranges: dict[str, tuple[float, float]] = AXIS_RANGES) -> DataFrame:
    """Private minus NHS per radar axis, with direction text and the
    positions of both sectors in percent of the axis range (50 when the range
    is empty; outside 0 to 100 when a value is outside its range)."""
    radar = sector.radar_profiles(star, scope, ordered=False)
    subject = F.col("subject")
    unit_txt, places_of = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, (u, p) in AXIS_UNITS.items():
        unit_txt = F.when(subject == name, F.lit(u)).otherwise(unit_txt)
        places_of = F.when(subject == name, F.lit(p)).otherwise(places_of)
    diff = F.col("Private") - F.col("NHS")
    gap = F.when(places_of == 3, round_dec(diff, 3)).otherwise(round_dec(diff, 1))
    shown = F.when(places_of == 3, F.format_string("%.3f", F.abs(F.col("gap")))) \
        .otherwise(F.format_string("%.1f", F.abs(F.col("gap"))))
    lo, rng = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, (least, most) in ranges.items():
        lo = F.when(subject == name, F.lit(least)).otherwise(lo)
        rng = F.when(subject == name, F.lit(most) - F.lit(least)).otherwise(rng)
    pos = lambda c: F.when(rng > 0, (F.col(c) - lo) / rng * F.lit(100.0)).otherwise(F.lit(50.0))
    return (radar.select("axis", "subject", "NHS", "Private", gap.alias("gap"),
                         unit_txt.alias("unit"), pos("NHS").alias("nhs_position"),
                         pos("Private").alias("private_position"))
            .withColumn("gap_text",
                        F.when(F.col("gap") > 0, F.concat(F.lit("+"), shown, F.lit(" "), F.col("unit"),
                                                          F.lit(" above NHS")))
                        .when(F.col("gap") < 0, F.concat(F.lit("-"), shown, F.lit(" "), F.col("unit"),
                                                         F.lit(" below NHS")))
                        .otherwise(F.lit("No gap"))))


# ----------------------------------------------------------------- burnout
def waterfall_bars(star: Star, scope: Scope | None = None) -> DataFrame:
    """Floating bars of the five-stage bridge (first and last from 0).

    The running total is accumulated stage by stage inside the single row
    of totals (same left-to-right addition as a running sum), then the five
    bars are generated from it.
    """
    values = finance.waterfall_values()
    last = len(values)
    bars, running = [], F.lit(0.0)
    for i, (name, value) in enumerate(zip(finance.WATERFALL_STAGES, values), 1):
        anchored = i in (1, last)
        bars.append(F.struct(
            F.lit(i).cast("bigint").alias("stage"), F.lit(name).alias("name"), value.alias("value"),
            (F.lit(0.0) if anchored else running).alias("open"),
            (value if anchored else running + value).alias("close"),
            (value >= 0).alias("is_positive")))
        running = value if i == 1 else running + value
    return finance.waterfall_totals(star, scope).select(F.inline(F.array(*bars)))


def burnout_month_map(star: Star, scope: Scope | None = None) -> DataFrame:
    """Twelve month rows (always present) with the burnout by hospital name."""
    slope = finance.burnout_by_month(star, scope, ordered=False)
    found = keyed(slope, ["month"], "hospital_name", F.max("burnout"), "burnout")
    months = star.spark.range(1, 13).select(F.col("id").alias("month"))
    return (months.join(found, "month", "left")
            .select("month", month_short_name("month").alias("name"), "burnout").orderBy("month"))


def burnout_month_pivot(star: Star, scope: Scope | None = None, hospital_names: Sequence[str] | None = None) -> DataFrame:
    """P19 with a column for each of the given hospital names; a map without a list."""
    rows = burnout_month_map(star, scope)
    return rows if hospital_names is None else rows.select("month", "name", *spread("burnout", hospital_names))


def burnout_hospital_list(star: Star, scope: Scope | None = None) -> DataFrame:
    """P20: one row per hospital: the last row by month, null months after all others."""
    slope = finance.burnout_by_month(star, scope, ordered=False)
    w = Window.partitionBy("hospital_id").orderBy(F.desc_nulls_first("month"), F.desc("hospital_name"))
    return (slope.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn"))


def alert_summary(star: Star, scope: Scope | None = None) -> DataFrame:
    """Hospital names per alert label (two types share one label)."""
    a = finance.cfo_alerts(star, scope)
    return (a.groupBy(bands.alert_label("type").alias("label"))
            .agg(F.array_join(F.array_sort(F.collect_list("hospital_name")), ", ").alias("hospitals"),
                 F.count(F.lit(1)).cast("bigint").alias("alerts")))


def deficit_hospitals(star: Star, scope: Scope | None = None) -> DataFrame:
    """Hospitals whose mean profit margin is negative."""
    return (finance.burnout_financials(star, scope, ordered=False)
            .filter(F.col("profit_margin_pct") < 0)
            .select("hospital_id", "hospital_name", "profit_margin_pct"))
