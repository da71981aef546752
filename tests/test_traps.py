"""Semantic traps of the reference on hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from support import rows
from wardflow.functions.numeric import round_dec
from wardflow.operators.scope import Scope
from wardflow.plans import finance, outliers, overview, sector, shapes, thresholds
from wardflow.sources.star import FrameStar

HOSPITALS = [
    # id, name, region, trust type, private
    ("H01", "Alpha Hospital", "R01", "Independent / Private", True),
    ("H02", "Beta Infirmary", "R01", "NHS Trust", False),
    ("H03", "Gamma NHS FT", "R02", "NHS Foundation Trust", False),
    ("H07", "Delta General", "R02", "NHS Trust", False),
    ("H09", "Empty Hospital", "R02", "NHS Trust", False),  # no facts at all
]


def hospitals(spark, data=HOSPITALS):
    return spark.createDataFrame(
        data, "hospital_id string, hospital_name string, region_id string, "
              "nhs_trust_type string, private boolean")


def ts(day: int, hour: int = 8, month: int = 1, year: int = 2024):
    return dt.datetime(year, month, day, hour)


def visits(spark, data):
    return spark.createDataFrame(
        data, "visit_id long, hospital_id string, month int, arrival_datetime timestamp_ntz, "
              "wait_time_minutes double, readmission_30_days_flag boolean, severity_level int, "
              "admission_type string, outcome string, icu_required_flag boolean, "
              "satisfaction_score double")


def v(i, h, month=1, arrival=None, wait=10.0, readmit=False, sev=3, adm="Emergency",
      outcome="Discharged", icu=False, sat=50.0):
    return (i, h, month, arrival if arrival is not None else ts(1 + i % 27, month=month or 1),
            wait, readmit, sev, adm, outcome, icu, sat)


def staffing(spark, data):
    return spark.createDataFrame(
        data, "shift_id long, hospital_id string, month int, burnout_risk_index double, "
              "staff_absence_count int, overtime_hours double")


def financials(spark, data):
    return spark.createDataFrame(
        data, "financial_record_id string, hospital_id string, month int, profit_margin double, "
              "avg_burnout_index double, readmission_rate double")


def calendar(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(366)]
    return (spark.createDataFrame([(d,) for d in days], "full_date date")
            .select(F.date_format("full_date", "yyyyMMdd").cast("int").alias("date_key"), "full_date",
                    F.date_format("full_date", "EEEE").alias("day_of_week"),
                    (F.weekday("full_date") + 1).alias("day_number")))


def star(spark, **tables):
    base = {"dim_hospital": hospitals(spark), "dim_date": calendar(spark),
            "dim_region": spark.createDataFrame([("R01", "North"), ("R02", "South")],
                                                "region_id string, region_name string")}
    base.update(tables)
    return FrameStar(spark, base)


# --------------------------------------------------------------------- T1
def test_decimal_rounding_half_away_from_zero(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-2.675,), (0.125,), (-0.125,)], "x double")
    got = [r[0] for r in df.select(round_dec("x", 2)).collect()]
    assert got == [1.01, 2.68, -2.68, 0.13, -0.13]


# --------------------------------------------------------------------- T2
def test_empty_selection_gives_zeros(spark):
    s = star(spark, fact_patient_visits=visits(spark, [v(1, "H01")]))
    out = overview.kpis(s, Scope(region="R99")).collect()[0]
    assert tuple(out) == (0, 0.0, 0.0, 0.0)


def test_kpis_filter_and_scalar_burnout(spark):
    s = star(spark,
             fact_patient_visits=visits(spark, [v(1, "H01", wait=10.0, readmit=True),
                                                v(2, "H01", wait=21.0), v(3, "H02", wait=30.0)]),
             fact_staffing=staffing(spark, [(1, "H01", 1, 0.5, 1, 1.0), (2, "H02", 1, 0.9, 1, 1.0)]))
    out = overview.kpis(s, Scope(hospital_id="H01")).collect()[0].asDict()
    assert out == {"total_visits": 2, "readmission_rate": 50.0, "avg_wait_time": 15.5,
                   "avg_burnout_index": 0.5}


# ------------------------------------------------------------- T3 + T14
def test_divergence_nulls_first_and_benchmark_parameter(spark):
    s = star(spark, fact_patient_visits=visits(spark, [v(1, "H01", wait=70.0), v(2, "H02", wait=50.0)]))
    out = sector.diverging_wait(s, benchmark=60.0).collect()
    assert out[0]["avg_wait_time"] is None  # hospitals without visits first (DESC NULLS FIRST)
    by_id = {r["hospital_id"]: r for r in out}
    assert by_id["H01"]["divergence"] == 10.0 and by_id["H02"]["divergence"] == -10.0
    assert len(out) == len(HOSPITALS)


# --------------------------------------------------------- T4 + T5 + T19
def naive_product(s, *others):
    """Every hospital with its visits, each visit with all rows of ``others`` of its hospital and month."""
    rows_ = s.visits("hospital_id", "month", "wait_time_minutes", "readmission_30_days_flag")
    for other in others:
        rows_ = rows_.join(other, ["hospital_id", "month"], "left")
    return s.hospitals().select("hospital_id", "region_id", "private").join(rows_, "hospital_id", "left")


def rounded_mean(column, places, scale=1.0):
    return round_dec(F.avg(column) * scale, places)


def fanout_star(spark):
    vs = [v(1, "H01", month=1, wait=10.0, readmit=True), v(2, "H01", month=1, wait=20.0),
          v(3, "H01", month=2, wait=40.0), v(4, "H02", month=1, wait=5.0, readmit=True),
          v(5, "H02", month=None, wait=7.0), v(6, "H03", month=3, wait=None)]
    ss = [(1, "H01", 1, 0.5, 0, 0.0), (2, "H01", 1, 0.7, 0, 0.0), (3, "H01", 1, 0.9, 0, 0.0),
          (4, "H01", 2, 0.4, 0, 0.0), (5, "H02", 2, 0.8, 0, 0.0), (6, "H07", 1, 0.6, 0, 0.0)]
    fs = [("a", "H01", 1, 0.10, 0.6, 0.1), ("b", "H01", 1, 0.30, 0.6, 0.1),
          ("c", "H02", 1, 0.20, 0.6, 0.1), ("d", "H03", 4, 0.50, 0.6, 0.1)]
    return star(spark, fact_patient_visits=visits(spark, vs), fact_staffing=staffing(spark, ss),
                fact_financials=financials(spark, fs))


def test_fanout_eager_equals_naive_join(spark):
    s = fanout_star(spark)
    every = naive_product(s, s.staffing("hospital_id", "month", "burnout_risk_index"),
                          s.financials("hospital_id", "month", "profit_margin"))
    back = F.sum(F.when(F.col("readmission_30_days_flag"), 100.0).otherwise(0.0)) / F.count("*")
    expected = every.groupBy("private").agg(
        rounded_mean("wait_time_minutes", 1), rounded_mean("burnout_risk_index", 3),
        round_dec(back, 2), rounded_mean("profit_margin", 1, 100.0))
    found = sector.sector_metrics(s).select("private", "wait_time", "burnout", "readmission", "profit_margin")
    assert rows(found) == rows(expected)


def test_regional_eager_equals_naive_join(spark):
    s = fanout_star(spark)
    every = naive_product(s, s.staffing("hospital_id", "month", "burnout_risk_index"))
    expected = every.groupBy("region_id").agg(
        rounded_mean("wait_time_minutes", 1), rounded_mean("burnout_risk_index", 3))
    found = sector.regional_choropleth(s).select("region_id", "avg_wait_time", "avg_burnout")
    assert rows(found) == rows(expected)


def test_missing_sector_is_zero_and_null_private_reads_as_nhs(spark):
    hs = [("H01", "A", "R01", "NHS Trust", None)]
    s = star(spark, dim_hospital=hospitals(spark, hs),
             fact_patient_visits=visits(spark, [v(1, "H01", wait=12.0)]))
    out = {r["subject"]: (r["NHS"], r["Private"]) for r in sector.radar_profiles(s).collect()}
    assert out["Wait Time (min)"] == (12.0, 0.0)
    assert out["Burnout Index"] == (None, 0.0)  # the row exists, the metric is null


# --------------------------------------------------------------------- T6
def test_severity_node_text_has_no_decimal(spark):
    df = spark.createDataFrame([(3.0,)], "s double")
    assert df.select(outliers._severity_node(F.col("s"))).collect()[0][0] == "Severity 3"


# --------------------------------------------------------------------- T7
def test_months_pool_years(spark):
    ss = [(1, "H01", 1, 0.5, 1, 1.0), (2, "H01", 1, 0.7, 2, 3.0)]  # Jan 2024 and Jan 2025
    s = star(spark, fact_staffing=staffing(spark, ss))
    assert rows(finance.burnout_by_month(s), "hospital_id", "month", "burnout") == [("H01", 1, 0.6)]
    assert rows(finance.absences_overtime(s)) == [(1, 3, 2.0)]


# --------------------------------------------------------------------- T9
def test_dense_rank_on_rounded_rate(spark):
    vs = [v(i, "H01", readmit=(i == 0)) for i in range(140)]
    vs += [v(1000 + i, "H02", readmit=(i == 0)) for i in range(141)]
    vs += [v(5000, "H03")]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    got = rows(outliers.bump_rankings(s), "hospital_id", "readmission_rate", "rank")
    assert got == [("H01", 0.71, 1), ("H02", 0.71, 1), ("H03", 0.0, 2)]
    scoped = rows(outliers.bump_rankings(s, Scope(hospital_id="H03")), "hospital_id", "rank")
    assert scoped == [("H03", 1)]  # the filter precedes the rank


# -------------------------------------------------------------------- T11
def test_calendar_join_drops_outside_and_null_arrivals(spark):
    vs = [v(1, "H01", arrival=ts(1, 9)), v(2, "H01", arrival=dt.datetime(2030, 5, 5, 1)),
          (3, "H01", 1, None, 30.0, False, 3, "Emergency", "Discharged", False, 50.0)]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    wait = outliers.severity_weekday_wait(s, "H01").collect()
    assert [(r["weekday"], r["avg_wait"]) for r in wait] == [("Monday", 10.0)]
    months = rows(overview.visits_over_time(s))
    assert (None, 1) in months and ("2024-01", 1) in months and ("2030-05", 1) in months


# -------------------------------------------------------------------- T12
def test_sankey_drops_null_ends_and_indexes_sorted_names(spark):
    vs = [v(1, "H07", sev=2, outcome="Readmitted"), v(2, "H07", sev=None, outcome="Discharged"),
          v(3, "H07", sev=5, adm="Elective", outcome=None)]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    nodes = rows(outliers.sankey_nodes(s, "H07"), "node_index", "name")
    assert nodes == [(0, "Elective"), (1, "Emergency"), (2, "Readmitted"), (3, "Severity 2"),
                     (4, "Severity 5")]
    links = rows(outliers.sankey_links(s, "H07"), "source", "target", "value")
    assert links == [(0, 4, 1), (1, 3, 1), (3, 2, 1)]


# -------------------------------------------------------------------- T18
def test_half_year_deltas_subtract_rounded_values(spark):
    vs = [v(1, "H01", month=2), v(2, "H01", month=8, readmit=True), v(3, "H01", month=9)]
    ss = [(1, "H01", 2, 0.6004, 0, 0.0), (2, "H01", 8, 0.6016, 0, 0.0)]
    s = star(spark, fact_patient_visits=visits(spark, vs), fact_staffing=staffing(spark, ss))
    r = thresholds.half_year_shift(s).collect()[0]
    assert (r["h1_burnout"], r["h2_burnout"], r["burnout_delta"]) == (0.6, 0.602, 0.002)
    assert (r["h1_readmission_rate"], r["h2_readmission_rate"], r["readmission_delta"]) == (0.0, 50.0, 50.0)
    # hospitals missing a half in either fact are dropped (inner joins)
    assert thresholds.half_year_shift(s).count() == 1


def test_thresholds_compare_rounded_values(spark):
    vs = [v(i, "H01", readmit=(i < 2)) for i in range(10)]
    ss = [(1, "H01", 1, 0.6004, 0, 0.0)]
    s = star(spark, fact_patient_visits=visits(spark, vs), fact_staffing=staffing(spark, ss))
    r = thresholds.threshold_flags(s).collect()[0]
    assert r["readmission_rate_pct"] == 20.0 and r["avg_burnout_index"] == 0.6
    assert (r["violates_readmission"], r["violates_burnout"], r["violates_both"]) == (True, False, False)
    assert thresholds.burnout_violators(s).count() == 0


# ------------------------------------------------------------- R17 rules
def test_cfo_alert_rules(spark):
    fs = [
        ("1", "H01", 1, 0.149, 0.631, 0.181),   # burnout, margin 14.9, readmit 18.1 -> 3 alerts
        ("2", "H02", 1, 0.15, 0.63, 0.18),      # exactly on every limit -> none
        ("3", "H03", 1, 0.155, 0.5, 0.1),       # watched: stress + 16% squeeze
        ("4", "H07", 1, 0.0, None, 0.1),        # watched: stress only (0 margin is falsy)
    ]
    s = star(spark, fact_financials=financials(spark, fs))
    got = rows(finance.cfo_alerts(s), "hospital_id", "type", "value")
    assert got == [("H01", "CRITICAL_BURNOUT", 0.631), ("H01", "FINANCIAL_SQUEEZE", 14.9),
                   ("H01", "READMISSION_SPIKE", 18.1), ("H03", "FINANCIAL_SQUEEZE", 15.5),
                   ("H03", "STAFFING_STRESS", 0.5), ("H07", "STAFFING_STRESS", None)]
    msgs = {(r["hospital_id"], r["type"]): r["message"] for r in finance.cfo_alerts(s).collect()}
    assert msgs[("H07", "STAFFING_STRESS")].endswith("sits at None, crossing target limits.")
    assert "16.0% board" in msgs[("H03", "FINANCIAL_SQUEEZE")]
    assert "at 14.9%," in msgs[("H01", "FINANCIAL_SQUEEZE")]


def test_outliers_zero_fill_and_period(spark):
    vs = [v(1, "H01", month=1, readmit=True), v(2, "H01", month=7)]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    out = {r["hospital_id"]: r for r in outliers.hospital_outliers(s, period="H2").collect()}
    assert out["H01"]["total_visits"] == 1 and out["H01"]["readmission_rate"] == 0.0
    assert out["H09"]["total_visits"] == 0 and out["H09"]["avg_burnout_index"] == 0.0


@pytest.mark.parametrize("period,expected", [("H1", 1), ("H2", 1), (None, 2), ("bogus", 2)])
def test_half_year_filter(spark, period, expected):
    vs = [v(1, "H01", month=6), v(2, "H01", month=7)]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    out = {r["hospital_id"]: r for r in outliers.hospital_outliers(s, period=period).collect()}
    assert out["H01"]["total_visits"] == expected


def test_sankey_reports_dropped_flows(spark):
    vs = [v(1, "H07", sev=2, outcome="Readmitted"), v(2, "H07", sev=None, outcome="Discharged"),
          v(3, "H07", sev=5, adm="Elective", outcome=None)]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    got = rows(outliers.sankey_dropped(s, "H07"))
    assert got == [("H07", 1, 2)]


def test_fanout_weights_do_not_overflow_bigint(spark):
    """At 100 TB a (hospital, month) can hold ~1e10 visits and ~1e9 shifts;
    their product exceeds bigint and must still be exact."""
    from wardflow.operators.fanout import FactSide, fanout_sums

    class Counted(FactSide):
        def __init__(self, name, rows, measures, flags=()):
            super().__init__(name, None, list(measures), list(flags))
            self.rows = rows

        def partial(self):
            return spark.createDataFrame(self.rows, self.schema)

    visits_side = Counted("v", [("H01", 1, 4_000_000_000, 8.0e10, 4_000_000_000, 1_000_000_000)], ["w"], ["r"])
    visits_side.schema = "hospital_id string, month int, v__n long, v__sum__w double, v__cnt__w long, v__hits__r long"
    shifts_side = Counted("s", [("H01", 1, 3_000_000_000, 1.8e9, 3_000_000_000)], ["b"])
    shifts_side.schema = "hospital_id string, month int, s__n long, s__sum__b double, s__cnt__b long"
    h = spark.createDataFrame([("H01", "x")], "hospital_id string, g string")
    out = fanout_sums(h, visits_side, [shifts_side], ["g"]).collect()[0]
    assert int(out["rows"]) == 12 * 10**18          # > 2**63 - 1
    assert int(out["hits__r"]) == 3 * 10**18
    assert out["sum__w"] / float(out["cnt__w"]) == 20.0


def test_text_order_is_binary(spark):
    """Node indexes follow binary (code point) order, not a locale
    collation: upper-case names sort before lower-case ones."""
    vs = [v(1, "H07", adm="emergency", sev=1, outcome="Discharged"),
          v(2, "H07", adm="Elective", sev=1, outcome="Discharged")]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    names = [r[1] for r in sorted(rows(outliers.sankey_nodes(s, "H07"), "node_index", "name"))]
    assert names == ["Discharged", "Elective", "Severity 1", "emergency"]


def test_financial_reports_use_their_own_burnout(spark):
    """R13 and the alerts average the financial rows' burnout figure;
    R6 averages the shifts.  The two are kept apart."""
    s = star(spark, fact_patient_visits=visits(spark, [v(1, "H01")]),
             fact_staffing=staffing(spark, [(1, "H01", 1, 0.5, 0, 0.0)]),
             fact_financials=financials(spark, [("a", "H01", 1, 0.2, 0.9, 0.1)]))
    r6 = {r["hospital_id"]: r["avg_burnout_index"] for r in outliers.hospital_outliers(s).collect()}
    r13 = {r["hospital_id"]: r["avg_burnout"] for r in finance.burnout_financials(s).collect()}
    assert r6["H01"] == 0.5 and r13["H01"] == 0.9


# ------------------------------------------------- more hospitals than two digits
def test_150_hospitals_in_reports_and_pivots(spark):
    ids = [f"H{k:02d}" for k in range(1, 151)]
    s = star(spark, dim_hospital=hospitals(spark, [(h, f"Name {h}", "R01", "NHS Trust", False) for h in ids]),
             fact_patient_visits=visits(spark, [v(i, h, month=1) for i, h in enumerate(ids)]),
             fact_staffing=staffing(spark, [(i, h, 1, 0.5, 0, 0.0) for i, h in enumerate(ids)]))
    assert {r["hospital_id"]: r["total_visits"] for r in outliers.hospital_outliers(s).collect()} == dict.fromkeys(ids, 1)
    assert {r["hospital_id"] for r in outliers.bump_rankings(s).collect()} == set(ids)
    assert {r["hospital_id"] for r in finance.burnout_by_month(s).collect()} == set(ids)
    assert set(shapes.readmission_month_pivot(s, hospital_ids=ids).columns) == {"month", *ids}
    assert all(set(r["rates"]) <= set(ids) for r in shapes.readmission_month_map(s).collect())
    names = [f"Name {h}" for h in ids]
    assert set(shapes.burnout_month_pivot(s, hospital_names=names).columns) == {"month", "name", *names}
