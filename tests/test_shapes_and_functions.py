"""Page-side rules (§2.9) and scalar functions (§2.7) on hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from support import rows
from test_traps import financials, staffing, star, v, visits
from wardflow.functions import bands
from wardflow.functions.flags import strict_flag, truthy
from wardflow.functions.numeric import js_round
from wardflow.functions.text import (char_code_bucket, clean_column_name, clean_facility_name,
                                     clean_name_col, first_underscore_to_space, month_short_name,
                                     short_hospital_name, weekday_short)
from wardflow.operators.scope import Scope, focus_flag, search
from wardflow.plans import overview, shapes


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x"))).collect()[0][0]


# ------------------------------------------------------------ A3/A4, G11-G19
@pytest.mark.parametrize("raw,clean", [
    ("Patient ID", "patient_id"), ("Wait-Time.Min", "wait_time_min"), ("A·B/C", "a_b_c"),
    ("__x__", "x"), ("  Mixed  Case  ", "mixed_case"),
])
def test_header_normalisation(spark, raw, clean):
    assert clean_column_name(raw) == clean
    assert one(spark, clean_name_col, raw) == clean


def test_facility_and_short_names(spark):
    assert one(spark, clean_facility_name, "King's College Hospital NHS Foundation Trust") == "King's College"
    assert one(spark, clean_facility_name, "Leeds General Infirmary") == "Leeds Gen"
    assert one(spark, clean_facility_name, "nuffield health woking hospital") == "Nuffield woking"
    assert one(spark, short_hospital_name, "Royal Hospital Hospital NHS FT") == "Royal Hospital"


def test_small_text_rules(spark):
    assert one(spark, first_underscore_to_space, "CRITICAL_BURNOUT_X") == "CRITICAL BURNOUT_X"
    assert one(spark, month_short_name, 12, "int") == "Dec"
    assert one(spark, month_short_name, 13, "int") is None
    assert one(spark, weekday_short, "Wednesday") == "Wed"
    assert one(spark, char_code_bucket, "AB") == (65 + 66) % 6
    assert one(spark, js_round, 2.5, "double") == 3 and one(spark, js_round, -2.5, "double") == -2


def test_truthy_and_strict_flags(spark):
    df = spark.createDataFrame([("No",), ("",), ("0",), (None,)], "s string")
    assert [r[0] for r in df.select(truthy(F.col("s"), StringType())).collect()] == [True, False, True, True]
    df = spark.createDataFrame([(0.0,), (2.0,), (None,)], "d double")
    assert [r[0] for r in df.select(truthy(F.col("d"), DoubleType())).collect()] == [False, True, True]
    df = spark.createDataFrame([(None,), (False,)], "b boolean")
    assert [r[0] for r in df.select(truthy(F.col("b"), BooleanType())).collect()] == [True, False]
    df = spark.createDataFrame([("Yes",), ("no",), ("maybe",), ("1",)], "s string")
    assert [r[0] for r in df.select(strict_flag(F.col("s"))).collect()] == [True, False, None, True]


# ---------------------------------------------------------------- bands
@pytest.mark.parametrize("count,band", [(0, 0), (2, 0), (3, 1), (6, 1), (11, 2), (16, 3), (17, 4)])
def test_intensity_band(spark, count, band):
    assert one(spark, bands.intensity_band, count, "int") == band


@pytest.mark.parametrize("wait,band", [(None, "none"), (0.0, "none"), (49.9, "<50"), (50.0, "<75"),
                                       (94.9, "<95"), (95.0, ">=95")])
def test_wait_band(spark, wait, band):
    assert one(spark, bands.wait_band, wait, "double") == band


@pytest.mark.parametrize("b,w,r,level", [
    (0.60, 60.0, 15.0, "LOW"), (0.6001, 60.0, 15.0, "MODERATE"), (0.62, 90.0, 19.0, "HIGH"),
    (0.63, 91.0, 15.1, "CRITICAL"), (0.63, 91.0, 19.1, "CRITICAL"), (None, 99.0, 30.0, "STORED"),
])
def test_stress_levels(spark, b, w, r, level):
    df = spark.createDataFrame([(b, w, r, "STORED")], "b double, w double, r double, s string")
    assert df.select(bands.stress_level("b", "w", "r", "s")).collect()[0][0] == level


def test_department_family_and_alert_labels(spark):
    assert one(spark, bands.department_family, "Emergency Department") == "emergency"
    assert one(spark, bands.department_family, "Paediatric ICU") == "critical care"
    assert one(spark, bands.department_family, "Child Health") == "paediatrics"
    assert one(spark, bands.department_family, "AB").startswith("other-")
    assert one(spark, bands.alert_label, "CRITICAL_BURNOUT") == "Staffing stress"
    assert one(spark, bands.alert_label, "NEW_KIND_X") == "NEW KIND_X"


def test_search_and_focus(spark):
    df = spark.createDataFrame([("H01", "Alpha Hospital", "Leeds"), ("H02", "Beta", "York")],
                               "hospital_id string, hospital_name string, city string")
    assert rows(search(df, "yor", "hospital_name", "city"), "hospital_id") == [("H02",)]
    assert rows(search(df, "ALPHA", "hospital_name", "city"), "hospital_id") == [("H01",)]
    assert rows(focus_flag(df, "H02"), "hospital_id", "is_focus") == [("H01", False), ("H02", True)]


# ---------------------------------------------------------------- shapes
def test_calendar_layout_with_gap(spark):
    days = [1, 2, 3, 4, 5, 6, 8, 32, 33, 34]  # day 7 missing -> the grid shifts
    vs = [v(i, "H01", arrival=dt.datetime(2024, 1, 1) + dt.timedelta(days=d - 1)) for i, d in enumerate(days)]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    out = shapes.calendar_heatmap(s).orderBy("date").collect()
    assert [(r["week_index"], r["day_slot"]) for r in out][:8] == [(0, i) for i in range(7)] + [(1, 0)]
    assert out[6]["date"] == "2024-01-08"  # a block is 7 present days, not a calendar week
    labels = [(r["date"], r["month_label"]) for r in out if r["month_label"]]
    assert labels == [("2024-01-01", "Jan"), ("2024-02-01", "Feb")]
    assert all(r["band"] == 0 for r in out)
    assert shapes.calendar_heatmap(s, year="2023").count() == 0


def test_severity_grid_is_full(spark):
    s = star(spark, fact_patient_visits=visits(spark, [v(1, "H07", arrival=dt.datetime(2024, 1, 1, 3),
                                                         wait=62.5, sev=5)]))
    grid = shapes.severity_weekday_grid(s, "H07").collect()
    assert len(grid) == 35
    cell = [r for r in grid if r["avg_wait"] is not None]
    assert [(c["severity"], c["weekday"], c["wait_band"], c["label"]) for c in cell] == [
        (5, "Monday", "<75", "63m")]
    assert {r["label"] for r in grid if r["avg_wait"] is None} == {"-"}


def test_waterfall_bars_anchor_ends(spark):
    fs = spark.createDataFrame([("a", "H01", 1, 100.0, 4.0, 60.0, 5.0)],
                               "financial_record_id string, hospital_id string, month int, "
                               "revenue double, staffing_cost double, operational_cost double, icu_cost double")
    s = star(spark, fact_financials=fs)
    bars = [(r["name"], r["open"], r["close"]) for r in shapes.waterfall_bars(s).orderBy("stage").collect()]
    assert bars == [("Total Revenue", 0.0, 100.0), ("Base Staffing Costs", 100.0, 96.0),
                    ("General Ops Costs", 96.0, 36.0), ("ICU Department Costs", 36.0, 31.0),
                    ("Net Profit Margin", 0.0, 31.0)]
    empty = star(spark)
    assert shapes.waterfall_bars(empty).count() == 0


def test_ledger_alarm_gap_and_lists(spark):
    vs = [v(i, "H01", wait=95.0, readmit=(i < 3)) for i in range(10)] + [v(20, "H02", wait=20.0)]
    ss = [(1, "H01", 1, 0.63, 0, 0.0), (2, "H02", 1, 0.5, 0, 0.0), (3, "H02", 12, 0.7, 0, 0.0)]
    s = star(spark, fact_patient_visits=visits(spark, vs), fact_staffing=staffing(spark, ss))
    ledger = {r["hospital_id"]: r for r in shapes.facility_ledger(s).collect()}
    assert ledger["H01"]["staffing_stress"] == "CRITICAL" and ledger["H01"]["private"]
    assert ledger["H01"]["readmission_band"] == "high" and ledger["H02"]["readmission_band"] == "low"
    found = shapes.facility_ledger(s, text="beta").collect()
    assert [(r["hospital_id"], r["readmission_band"]) for r in found] == [("H02", "low")]  # the band is of the whole list
    last = rows(shapes.burnout_hospital_list(s), "hospital_id", "month", "burnout")
    assert last == [("H01", 1, 0.63), ("H02", 12, 0.7)]
    pivot = shapes.burnout_month_pivot(s, hospital_names=["Alpha Hospital", "Beta Infirmary"]).collect()
    assert len(pivot) == 12 and pivot[11]["Beta Infirmary"] == 0.7 and pivot[5]["Alpha Hospital"] is None


def test_alert_summary_and_deficit(spark):
    fs = [("1", "H01", 1, -0.05, 0.64, 0.1), ("2", "H07", 1, 0.2, 0.61, 0.1)]
    s = star(spark, fact_financials=financials(spark, fs))
    summary = {r["label"]: r["hospitals"] for r in shapes.alert_summary(s).collect()}
    assert summary == {"Staffing stress": "Alpha Hospital, Delta General",
                       "Financial squeeze": "Alpha Hospital"}
    assert rows(shapes.deficit_hospitals(s), "hospital_id") == [("H01",)]


def test_sankey_stats(spark):
    vs = [v(1, "H07", sev=2, outcome="Admitted"), v(2, "H07", sev=2, outcome="Readmitted")]
    s = star(spark, fact_patient_visits=visits(spark, vs))
    nodes = {r["name"]: (r["stage"], r["value"], r["is_warning"])
             for r in shapes.sankey_node_stats(s, "H07").collect()}
    # "Admitted" is not in the fixed outcome list but sits on the outcome side
    assert nodes == {"Emergency": (0, 2, False), "Severity 2": (1, 4, False),
                     "Admitted": (2, 1, False), "Readmitted": (2, 1, True)}
    shares = {(r["source_node"], r["target_node"]): r["share"]
              for r in shapes.sankey_link_shares(s, "H07").collect()}
    assert shares[("Emergency", "Severity 2")] == 1.0
    assert shares[("Severity 2", "Readmitted")] == 0.25


def test_department_pivot_order_and_zero_fill(spark):
    depts = spark.createDataFrame([("D1", "Cardiology"), ("D2", "Emergency Department"), ("D3", "Zoo")],
                                  "department_id string, department_name string")
    vv = visits(spark, [v(1, "H01"), v(2, "H02")]).withColumn(
        "department_id", F.when(F.col("hospital_id") == "H01", "D1").otherwise("D3"))
    s = star(spark, fact_patient_visits=vv, dim_department=depts)
    out = shapes.department_pivot(s, departments=[r["department_name"] for r in s.dim("dim_department").collect()])
    assert out.columns == ["name", "hospital_name", "Emergency Department", "Cardiology", "Zoo"]
    got = {r["name"]: tuple(r)[2:] for r in out.collect()}
    assert got == {"Alpha": (0, 1, 0), "Beta": (0, 0, 1)}
    assert shapes.department_pivot(s, Scope(hospital_id="H02")).count() == 1


def test_maps_hold_any_number_of_hospitals(spark):
    """20,000 hospitals, planned without a job; wide columns only for those that are named."""
    ids = [f"H{i:05d}" for i in range(20_000)]
    h = spark.createDataFrame([(i, f"Name {i}", "R01", "NHS Trust", False) for i in ids],
                              "hospital_id string, hospital_name string, region_id string, nhs_trust_type string, private boolean")
    vs = spark.range(40_000).selectExpr("id as visit_id", "concat('H', lpad(cast(id % 20000 as string), 5, '0')) as hospital_id",
                                        "cast(1 + id % 2 as int) as month", "id % 3 = 0 as readmission_30_days_flag")
    s = star(spark, dim_hospital=h, fact_patient_visits=vs)
    sc = spark.sparkContext
    sc.setJobGroup("planning", "no job may run here")
    out, wide = shapes.readmission_month_map(s), shapes.readmission_month_pivot(s, hospital_ids=["H00007", "H19999", "H99999"])
    assert shapes.readmission_month_pivot(s).columns == ["month", "rates"]
    sc.setJobGroup("running", "")
    assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    got = {r["month"]: len(r["rates"]) for r in out.collect()}
    assert got == {1: 10_000, 2: 10_000} and wide.columns == ["month", "H00007", "H19999", "H99999"]
    assert {r["month"]: (r["H00007"] is None, r["H99999"]) for r in wide.collect()} == {1: (True, None), 2: (False, None)}


def test_collations_order_names(spark):
    """Mixed case and accents as a database collation orders them; binary order by default."""
    names = ["Zulu", "alpha", "Éclair", "eclat", "Beta", "echo"]
    h = spark.createDataFrame([(f"H{i:02d}", n, "R01", "NHS Trust", False, n) for i, n in enumerate(names)],
                              "hospital_id string, hospital_name string, region_id string, nhs_trust_type string, private boolean, city string")
    d = spark.createDataFrame([("D1", "Ward")], "department_id string, department_name string")
    vs = spark.createDataFrame([(i, f"H{i:02d}", "D1") for i in range(6)], "visit_id long, hospital_id string, department_id string")
    s = star(spark, dim_hospital=h, dim_department=d, fact_patient_visits=vs)
    order = ["alpha", "Beta", "echo", "Éclair", "eclat", "Zulu"]

    def names_of(df):
        return [r["hospital_name"] for r in df.collect()]

    assert names_of(overview.visits_by_department(s, collation="UNICODE")) == order
    assert names_of(overview.visits_by_department(s)) == sorted(names)
    assert names_of(shapes.facility_ledger(s, sort_by="hospital_name", ascending=True, collation="UNICODE_CI")) == order
    assert names_of(shapes.facility_ledger(s, sort_by="hospital_name", ascending=True)) == sorted(names, key=str.lower)
    assert [r["place"] for r in shapes.ledger_places(s, collation="UNICODE").collect()] == [1, 2, 3, 4, 5, 6]
    assert names_of(shapes.ledger_places(s, collation="UNICODE", ascending=False)) == order[::-1]

def test_filter_options_fall_back_to_codes(spark):
    hs = spark.createDataFrame([("H01", None, "R01", "NHS Trust", False), ("H02", "Beta", "R02", None, False)],
                               "hospital_id string, hospital_name string, region_id string, "
                               "nhs_trust_type string, private boolean")
    s = star(spark, dim_hospital=hs)
    got = rows(shapes.filter_options(s))
    assert ("hospital", "H01", "H01") in got and ("hospital", "H02", "Beta") in got
    assert [r for r in got if r[0] == "trust_type"] == [("trust_type", "NHS Trust", "NHS Trust")]
    assert ("region", "R02", "South") in got


def test_diverging_bars_shorten_names(spark):
    hs = spark.createDataFrame([("H01", "King's College Hospital NHS Foundation Trust", "R01", "NHS Trust", False)],
                               "hospital_id string, hospital_name string, region_id string, "
                               "nhs_trust_type string, private boolean")
    s = star(spark, dim_hospital=hs, fact_patient_visits=visits(spark, [v(1, "H01", wait=70.0)]))
    got = shapes.diverging_bars(s).collect()[0]
    assert (got["hospital_name"], got["avg_wait_time"], got["divergence"]) == ("King's College", 70.0, 8.6)
