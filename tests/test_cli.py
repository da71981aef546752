"""The command line runs reports and the load job."""

from __future__ import annotations

import tempfile

from wardflow.cli import main


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "hospital_outliers" in out and "audit_references" in out


def test_report_with_filters_and_output(spark, sf0001, capsys):
    out = tempfile.mkdtemp(prefix="wardflow-cli-") + "/r6"
    assert main(["report", "hospital_outliers", "--sf-dir", sf0001, "--region", "R02",
                 "--period", "H2", "--out", out, "--show", "3"]) == 0
    df = spark.read.parquet(out)
    assert df.count() == 5 and set(r[0] for r in df.select("hospital_id").collect()) <= {
        f"H{k + 1:02d}" for k in range(25)}
    assert main(["report", "sankey_links", "--sf-dir", sf0001, "--hospital", "H07"]) == 0
    assert main(["report", "nope", "--sf-dir", sf0001]) == 2


def test_derive_then_report_on_published_star(spark, sf0001):
    target = tempfile.mkdtemp(prefix="wardflow-cli-") + "/star"
    assert main(["derive", "--sf-dir", sf0001, "--target", target]) == 0
    out = tempfile.mkdtemp(prefix="wardflow-cli-") + "/r10"
    assert main(["report", "radar_profiles", "--star", target, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 6


def test_report_as_json(spark, sf0001):
    out = tempfile.mkdtemp(prefix="wardflow-cli-") + "/tree"
    assert main(["report", "visits_treemap", "--sf-dir", sf0001, "--out", out, "--out-format", "json"]) == 0
    first = spark.read.json(out).first()
    assert first["children"] and {"name", "value"} <= set(first["children"][0].asDict())


def test_load_command_from_csv_sheets(spark, sf0001):
    from support import rows
    from test_etl import _sheet_header
    from wardflow.plans import outliers
    from wardflow.sources import etl
    from wardflow.sources.star import DriverStar, PublishedStar

    src = DriverStar(spark, sf0001)
    root = tempfile.mkdtemp(prefix="wardflow-cli-")
    for sheet, table in etl.SOURCE_TABLES.items():
        df = src.table(table)
        if table != "data_dictionary":
            df = df.toDF(*[_sheet_header(c) for c in df.columns])
        df.write.option("header", True).csv(f"{root}/in/{sheet}")
    assert main(["load", "--source", f"{root}/in", "--format", "csv", "--target", f"{root}/star",
                 "--allow", "keys:fact_patient_visits:visit_id"]) == 0
    pub = PublishedStar(spark, f"{root}/star")
    assert rows(outliers.hospital_outliers(pub)) == rows(outliers.hospital_outliers(src))
