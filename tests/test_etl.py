"""Load job and audits (A1-A18): conform rules, planted defects, round trip."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from support import rows
from test_traps import hospitals, star, v, visits
from wardflow.plans import audit, outliers, sector
from wardflow.sources import etl
from wardflow.sources.star import DriverStar, FrameStar, PublishedStar


def scratch():
    return tempfile.mkdtemp(prefix="wardflow-test-")


def test_conform_dirty_visits_sheet(spark):
    raw = spark.createDataFrame(
        [("1", "H01", "2024-01-05 10:00:00", "No", "", "x", "1.5", "1.0", "2.0"),
         ("2", "H02", "not a time", None, "1", "x", "2.5", None, None)],
        "`Visit ID` string, `Hospital-ID` string, `Arrival.Datetime` string, "
        "`Readmission 30 Days Flag` string, `ICU·Required/Flag` string, `__Hospital_Name__` string, "
        "`Wait Time Minutes` string, latitude string, longitude string")
    df = etl.conform_table("fact_patient_visits", etl.normalise_headers(raw))
    assert df.columns == ["visit_id", "hospital_id", "arrival_datetime", "readmission_30_days_flag",
                          "icu_required_flag", "wait_time_minutes"]
    got = [tuple(r) for r in df.orderBy("visit_id").collect()]
    assert got == [("1", "H01", dt.datetime(2024, 1, 5, 10), True, False, 1.5),
                   ("2", "H02", None, True, True, 2.5)]  # "No" and null are truthy (T8)
    strict = etl.conform_table("fact_patient_visits", etl.normalise_headers(raw), strict_flags=True)
    assert [r[0] for r in strict.orderBy("visit_id").select("readmission_30_days_flag").collect()] == [False, None]


def test_strict_dates_fail_the_load(spark):
    raw = spark.createDataFrame([("2024-13-45",)], "`Full Date` string")
    with pytest.raises(Exception):
        etl.conform_table("dim_date", etl.normalise_headers(raw)).collect()


def test_conform_vocabulary(spark):
    raw = spark.createDataFrame(
        [("Table", "Column", "Type", "Description", "Context", "Notes"),
         ("Fact Patient Visits", "Wait-Time (min)", "float", "d", "c", "n"),
         (None, "orphan", "t", "d", "c", "n")],
        "a string, b string, c string, d string, e string, f string")
    out = etl.conform_vocabulary(raw).collect()
    assert [(r["table_name"], r["column_name"]) for r in out] == [("fact_patient_visits", "wait_time_(min)")]


def test_missing_source_raises(spark):
    with pytest.raises(etl.SourceMissing):
        etl.read_sources(spark, scratch() + "/nope", tables={"Dim_Region": "dim_region"})


def test_read_csv_sources(spark):
    root = scratch()
    (spark.createDataFrame([("R01", "North")], "`Region ID` string, `Region Name` string")
     .write.option("header", True).csv(f"{root}/Dim_Region"))
    tables = etl.read_sources(spark, root, fmt="csv", tables={"Dim_Region": "dim_region"})
    assert rows(etl.conform(tables)["dim_region"]) == [("R01", "North")]


def test_key_and_reference_audits_find_planted_defects(spark):
    hs = hospitals(spark).union(spark.createDataFrame(
        [("H01", "dup", "R01", "NHS Trust", False), (None, "nokey", "R09", "NHS Trust", False)],
        hospitals(spark).schema))
    vs = visits(spark, [v(1, "H01"), v(1, "H02"), v(2, "H99"), v(3, None)])
    s = star(spark, dim_hospital=hs, fact_patient_visits=vs)
    keys = {r["table_name"]: r for r in audit.key_audit(s).collect()}
    assert keys["dim_hospital"]["duplicated_keys"] == 1 and keys["dim_hospital"]["null_keys"] == 1
    assert keys["fact_patient_visits"]["duplicated_keys"] == 1
    assert keys["dim_hospital"]["status"] == "violation" and keys["dim_region"]["status"] == "ok"
    refs = {(r["table_name"], r["column_name"]): r for r in audit.reference_audit(s).collect()}
    visit_h = refs[("fact_patient_visits", "hospital_id")]
    assert (visit_h["checked"], visit_h["orphans"], visit_h["orphan_values"]) == (3, 1, 1)
    region = refs[("dim_hospital", "region_id")]
    assert region["orphans"] == 1 and region["status"] == "violation"


def test_expected_rows_of_the_driver_star_find_a_lost_row(spark, sf0001):
    src = DriverStar(spark, sf0001)
    ok = {r["table_name"]: r["status"] for r in audit.row_counts(src, src.expected_rows()).collect()}
    assert len(ok) == 10 and set(ok.values()) == {"ok"}
    short = FrameStar(spark, {"fact_staffing": src.staffing().where("shift_id <> 1")})
    found = {r["table_name"]: r for r in audit.row_counts(short, src.expected_rows(), ["fact_staffing"]).collect()}
    assert found["fact_staffing"]["status"] == "mismatch"


def test_references_of_other_types_and_repeated_keys(spark):
    keys = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "doctor_id string")
    facts = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (None,)], "doctor_id long")

    class Two:
        def __init__(self):
            self.spark = spark

        def columns(self, name, *cols):
            return (facts if name == "f" else keys).select(*cols)

    row = audit.reference_check(Two(), [("f", "doctor_id", "k", "doctor_id")]).collect()
    assert [(r["checked"], r["orphans"], r["orphan_values"]) for r in row] == [(5, 2, 1)]


def test_row_count_and_headline_checks(spark):
    s = star(spark, fact_patient_visits=visits(spark, [v(i, "H01", readmit=(i < 17)) for i in range(100)]))
    counts = {r["table_name"]: r for r in audit.row_counts(s, {"fact_patient_visits": 100,
                                                               "fact_staffing": 5}).collect()}
    assert counts["fact_patient_visits"]["status"] == "ok"
    assert counts["fact_staffing"]["status"] == "mismatch"
    assert counts["dim_region"]["status"] == "n/a"
    head = audit.headline_check(s).collect()[0]
    assert head["readmission_rate"] == 17.0 and head["status"] == "ok"


def test_load_stages_audits_and_publishes(spark, sf0001, published_sf0001):
    src = DriverStar(spark, sf0001)
    target = scratch() + "/star"
    with pytest.raises(etl.LoadRejected) as err:  # duplicate visit ids are a real finding
        etl.load(spark, etl.star_tables(src), target)
    bad = [r for r in err.value.findings["keys"] if r["status"] != "ok"]
    assert [r["table_name"] for r in bad] == ["fact_patient_visits"]
    import os
    assert not os.path.exists(f"{target}/fact_patient_visits")  # nothing published
    src, pub = published_sf0001
    for report in (outliers.hospital_outliers, sector.radar_profiles, outliers.sankey_links):
        assert rows(report(pub)) == rows(report(src))
    files = spark.read.parquet(f"{pub.root}/fact_patient_visits").inputFiles()
    first = [tuple(r) for r in spark.read.parquet(files[0]).select("hospital_id", "arrival_datetime").collect()]
    assert first == sorted(first)  # sorted by hospital and time inside each file


def small_tables(spark, ids=("01", "02"), visit_ids=("V001", "V002")):
    """A whole star of a few rows, with text ids and an extra column."""
    s = star(spark)
    tables = etl.star_tables(s)
    tables["dim_region"] = spark.createDataFrame([("R1", "North")], "region_id string, region_name string")
    tables["dim_hospital"] = spark.createDataFrame([(i, f"Hospital {i}", "R1", 51.5) for i in ids],
                                                   "hospital_id string, hospital_name string, region_id string, latitude double")
    for t in ("dim_department", "dim_patient", "dim_doctor", "dim_diagnosis", "fact_staffing", "fact_financials"):
        tables[t] = tables[t].where("false")
    tables["fact_patient_visits"] = spark.createDataFrame(
        [(v, i, 1) for v, i in zip(visit_ids, ids)], "visit_id string, hospital_id string, month int")
    return tables


def test_publish_keeps_ids_and_takes_empty_facts(spark):
    target = scratch() + "/star"
    result = etl.load(spark, small_tables(spark), target, expected_rows={"fact_patient_visits": 2})
    pub = PublishedStar(spark, target)
    assert rows(pub.visits("visit_id", "hospital_id")) == [("V001", "01"), ("V002", "02")]
    assert rows(pub.hospitals().select("hospital_id", "latitude")) == [("01", 51.5), ("02", 51.5)]
    assert {r["hospital_id"]: r["total_visits"] for r in outliers.hospital_outliers(pub).collect()} == {"01": 1, "02": 1}
    assert pub.financials().count() == 0
    counts = {r["table_name"]: r["status"] for r in result.findings["row_counts"]}
    assert counts["fact_patient_visits"] == "ok" and result.findings["headline"]


def test_failed_load_leaves_the_old_star(spark, monkeypatch):
    target = scratch() + "/star"
    etl.load(spark, small_tables(spark), target)
    newer = small_tables(spark, ids=("03", "04"))
    with pytest.raises(etl.LoadRejected):
        etl.load(spark, newer, target, expected_rows={"fact_patient_visits": 3})
    write, seen = etl._write, []

    def failing(df, path, name):
        seen.append(name)
        if name == "fact_financials":
            raise OSError("lost")
        write(df, path, name)

    monkeypatch.setattr(etl, "_write", failing)
    with pytest.raises(OSError):
        etl.load(spark, newer, target)
    monkeypatch.undo()
    assert "dim_hospital" in seen
    assert rows(PublishedStar(spark, target).hospitals().select("hospital_id")) == [("01",), ("02",)]
    before = PublishedStar(spark, target)
    etl.load(spark, newer, target)
    assert rows(PublishedStar(spark, target).hospitals().select("hospital_id")) == [("03",), ("04",)]
    assert rows(before.hospitals().select("hospital_id")) == [("01",), ("02",)]  # a star stays one version


def test_a_finding_is_allowed_by_its_column(spark):
    tables = small_tables(spark, visit_ids=("V1", "V1"))
    tables["fact_patient_visits"] = tables["fact_patient_visits"].withColumn(
        "hospital_id", F.when(F.col("hospital_id") == "02", "99").otherwise(F.col("hospital_id")))
    with pytest.raises(etl.LoadRejected, match="references:fact_patient_visits:hospital_id"):
        etl.load(spark, tables, scratch() + "/s", allow_violations={"keys:fact_patient_visits:visit_id"})


def test_unparsable_values_fail_the_load(spark):
    raw = spark.createDataFrame([("V1", "3.0", "4", "")], "visit_id string, month string, severity_level string, wait_time_minutes string")
    assert rows(etl.conform_table("fact_patient_visits", raw)) == [("V1", 3, 4, None)]
    bad = spark.createDataFrame([("V1", "March")], "visit_id string, month string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        etl.conform_table("fact_patient_visits", bad).collect()


def test_codes_of_more_than_99_hospitals(spark):
    from wardflow.sources.star import coded_id

    got = [r[0] for r in spark.range(150).select(coded_id("H", F.col("id"))).collect()]
    assert got[0] == "H01" and got[98:101] == ["H99", "H100", "H101"] and len(set(got)) == 150


def test_new_files_are_seen_by_a_new_star(spark):
    root = scratch()
    region = spark.createDataFrame([(0, "A")], "r_regionkey long, r_name string")
    region.write.parquet(f"{root}/region.parquet")
    assert DriverStar(spark, root).regions().count() == 1
    region.write.mode("append").parquet(f"{root}/region.parquet")
    assert DriverStar(spark, root).regions().count() == 2


def test_dimension_bounds(spark):
    s = star(spark)
    b = {r["table_name"]: r["status"] for r in audit.dimension_bounds(s).collect()}
    assert set(b.values()) == {"ok"}
    big = spark.range(10_001).select(F.col("id").cast("string").alias("region_id"))
    s2 = star(spark, dim_region=big)
    b2 = {r["table_name"]: r["status"] for r in audit.dimension_bounds(s2).collect()}
    assert b2["dim_region"] == "violation"


def _sheet_header(column: str) -> str:
    """A workbook-style header that normalises back to ``column``."""
    return " ".join(part.capitalize() for part in column.split("_"))


def test_csv_workbook_round_trip(spark, sf0001):
    """Star tables exported as CSV sheets with human headers load back into
    the same star: every report over the published copy matches."""
    from wardflow import catalog

    src = DriverStar(spark, sf0001)
    root = scratch()
    for sheet, table in etl.SOURCE_TABLES.items():
        df = src.table(table)
        if table != "data_dictionary":
            df = df.toDF(*[_sheet_header(c) for c in df.columns])
        df.write.option("header", True).csv(f"{root}/{sheet}")
    tables = etl.conform(etl.read_sources(spark, root, fmt="csv"), strict_flags=True)
    res = etl.load(spark, tables, scratch() + "/star", allow_violations={"keys:fact_patient_visits:visit_id"})
    pub = PublishedStar(spark, res.published_to)
    for name in ("hospital_outliers", "radar_profiles", "cfo_alerts", "severity_weekday_wait",
                 "regional_choropleth", "burnout_financials", "daily_heatmap", "audit_references"):
        report = catalog.queries()[name].on
        assert rows(report(pub)) == rows(report(src)), name
