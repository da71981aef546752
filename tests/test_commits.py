"""The commit log, retention and the stored rollup of published stars."""

from __future__ import annotations

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from support import rows
from test_traps import hospitals, star, staffing, v, visits
from wardflow.operators.scope import Scope
from wardflow.plans import finance, outliers, overview, sector, thresholds
from wardflow.sources import commits, etl, rollup
from wardflow.sources.star import PublishedStar, Star


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="wardflow-commits-")


def test_threads_that_publish_at_once_lose_nothing(spark, root):
    barrier, done = threading.Barrier(8), []

    def publish(name):
        barrier.wait()
        for k in range(3):
            done.append(commits.publish(spark, root, f"{name}-{k}"))

    threads = [threading.Thread(target=publish, args=(f"load{i}",)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = commits.commits(spark, root)
    assert [c.number for c in log] == list(range(1, 25)) and len({c.version for c in log}) == 24
    assert sorted(done, key=lambda c: c.number) == log and commits.current(spark, root) == log[-1]
    assert [n for n in os.listdir(f"{root}/_log") if n.endswith(".tmp")] == []


def test_a_taken_number_is_refused(spark, root):
    folder = commits.Folder(spark, root)
    assert commits.current(spark, root) is None and commits.commits(spark, root) == []
    assert folder.put_if_absent("_log/a.json", "1") and not folder.put_if_absent("_log/a.json", "2")
    assert folder.read("_log/a.json") == "1"
    folder.local = False  # the way of other file systems: a rename that does not overwrite
    assert folder.put_if_absent("_log/b.json", "3") and not folder.put_if_absent("_log/b.json", "4")
    assert folder.read("_log/b.json") == "3"
    with pytest.raises(commits.CommitConflict):
        commits.publish(spark, root, "x", attempts=0)


def test_expire_spares_recent_young_and_pinned_versions(spark, root):
    for i in range(5):
        os.makedirs(f"{root}/_versions/v{i}/dim_region")
        commits.publish(spark, root, f"v{i}")
    os.makedirs(f"{root}/_versions/rejected")
    assert commits.expire(spark, root, keep=2, min_age_seconds=3600) == []
    folder = commits.Folder(spark, root)
    folder.write("_pins/v1/reader", "")
    assert commits.expire(spark, root, keep=2, min_age_seconds=-1) == ["rejected", "v0", "v2"]
    assert sorted(os.listdir(f"{root}/_versions")) == ["v1", "v3", "v4"]
    folder.delete("_pins/v1/reader")
    with commits.reading(spark, root) as version:
        assert version == "v4"
        commits.publish(spark, root, "v3")  # v4 is not the last one any more
        commits.publish(spark, root, "v3")
        assert commits.expire(spark, root, keep=1, min_age_seconds=-1) == ["v1"]
    assert commits.expire(spark, root, keep=1, min_age_seconds=-1) == ["v4"]
    assert [c.version for c in commits.commits(spark, root)][-1] == "v3"
    with commits.reading(spark, root + "/none") as version:
        assert version is None


def test_two_loads_at_once(spark, root):
    """Both versions are published and readable; the later commit is what readers get."""
    barrier, results = threading.Barrier(2), []

    def tables(n):
        return etl.star_tables(star(spark, dim_hospital=hospitals(spark), fact_patient_visits=visits(
            spark, [v(i, "H01") for i in range(n)])))

    def load(n):
        frames = tables(n)
        barrier.wait()
        results.append((n, etl.load(spark, frames, root, allow_violations=ALLOWED)))

    threads = [threading.Thread(target=load, args=(n,)) for n in (3, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(results) == 2 and [c.number for c in commits.commits(spark, root)] == [1, 2]
    last = commits.current(spark, root).version
    want = next(n for n, r in results if r.staged_at.endswith(last))
    assert PublishedStar(spark, root).visits("visit_id").count() == want


#: A few visits by hand have neither patients nor departments.
ALLOWED = {f"references:{t}:{c}" for t, c in (
    ("fact_patient_visits", "patient_id"), ("fact_patient_visits", "hospital_id"), ("fact_patient_visits", "department_id"),
    ("fact_staffing", "hospital_id"), ("fact_staffing", "shift_date"))}


REPORTS = {
    "departments": overview.visits_by_department, "waits": sector.diverging_wait, "regions": sector.regional_choropleth,
    "kpis": overview.kpis, "months": overview.visits_over_time, "outliers": outliers.hospital_outliers,
    "bump": outliers.bump_rankings, "absences": finance.absences_overtime, "burnout": finance.burnout_by_month,
    "flags": thresholds.threshold_flags, "halves": thresholds.half_year_shift, "double": thresholds.double_violators,
}


@pytest.mark.parametrize("scope", [None, Scope(region="R02"), Scope(region="R99")])
def test_reports_finish_from_the_rollup(published_sf0001, scope):
    """Equal to the scans, and no fact is read."""
    from wardflow.checks.plans import final_plan

    pub = published_sf0001[1]
    assert pub.has_rollup
    scanning = PublishedStar(pub.spark, pub.target)
    scanning.has_rollup = False
    for name, report in REPORTS.items():
        from_states = report(pub, scope)
        assert rows(from_states) == rows(report(scanning, scope)), name
        assert "fact_" not in final_plan(from_states), name
    assert rows(sector.radar_profiles(pub, scope)) == rows(sector.radar_profiles(scanning, scope))
    assert "fact_patient_visits" not in final_plan(sector.radar_profiles(pub, scope))
    for period in ("H1", "H2"):
        assert rows(outliers.hospital_outliers(pub, scope, period=period)) == rows(
            outliers.hospital_outliers(scanning, scope, period=period))


def test_states_of_awkward_rows(spark, root):
    """Null months, arrivals, waits and departments; hospitals without visits; every figure as from the rows."""
    data = [v(1, "H01", wait=None), v(2, "H01", readmit=True, sat=None), v(3, "H02", month=None), v(4, "H07", wait=None, sat=None),
            (None, "H03", 7, None, 5.0, True, 1, "Emergency", "Transfer", False, 1.0), v(6, "H99")]
    shifts = [(1, "H01", 1, 0.5, 2, None), (2, "H01", 8, None, None, 1.0), (3, "H02", None, 0.7, 1, 2.5), (4, "H99", 1, 0.1, 1, 1.0)]
    s = star(spark, dim_hospital=hospitals(spark), fact_patient_visits=visits(spark, data),
             fact_staffing=staffing(spark, shifts))
    rollup.write(s, root)
    stored = _FromRollup(s, root)
    for name, report in REPORTS.items():
        assert rows(report(stored)) == rows(report(s)), name


class _FromRollup(Star):
    """A star whose states come from a stored rollup."""

    def __init__(self, base, root):
        self.spark, self.base, self.root, self.has_rollup = base.spark, base, root, True

    def dim(self, name):
        return self.base.dim(name)

    _rollup = PublishedStar._rollup
    visit_states, shift_states = PublishedStar.visit_states, PublishedStar.shift_states


def test_refresh_touches_only_the_given_years(spark, root):
    def with_waits(wait, years=(2022, 2023, 2024)):
        return star(spark, dim_hospital=hospitals(spark), fact_patient_visits=visits(spark, [
            v(i, "H01", arrival=__import__("datetime").datetime(y, 3, 1, 8), wait=wait) for i, y in enumerate(years)] + [
            (9, "H02", 3, None, wait, False, 3, "Emergency", "Discharged", False, 1.0)]))

    rollup.write(with_waits(10.0), root)
    rollup.refresh(spark, with_waits(99.0), root, [2023])

    def waits():
        return {r.year: r.wait_sum for r in spark.read.parquet(f"{root}/{rollup.VISITS}").collect()}

    assert waits() == {0: 10.0, 2022: 10.0, 2023: 99.0, 2024: 10.0}
    rollup.refresh(spark, with_waits(5.0, years=(2022,)), root, [2024, 0])
    assert waits() == {0: 5.0, 2022: 10.0, 2023: 99.0}


def test_load_counts_while_it_writes(spark, root):
    """Rows, null keys and timestamps that did not parse come from the writes."""
    raw = spark.createDataFrame(
        [("1", "H01", "2024-01-05 10:00:00", "2024-01-05 10:05:00"), ("2", "H02", "not a time", None),
         ("3", "H02", "5 o'clock", " "), ("4", "H02", None, "never")],
        "visit_id string, hospital_id string, arrival_datetime string, triage_datetime string")
    seen = {}
    tables = etl.star_tables(star(spark, dim_hospital=hospitals(spark)))
    tables |= etl.conform({"fact_patient_visits": raw}, coerced=seen)
    result = etl.load(spark, tables, root, expected_rows={"fact_patient_visits": 4, "dim_hospital": 5},
                      allow_violations=ALLOWED, coerced=seen)
    found = {r["column_name"]: (r["rows"], r["status"]) for r in result.findings["coerced"]}
    assert found == {"arrival_datetime": (2, "coerced"), "triage_datetime": (1, "coerced")}
    counts = {r["table_name"]: (r["rows"], r["status"]) for r in result.findings["row_counts"]}
    assert counts["fact_patient_visits"] == (4, "ok") and counts["dim_hospital"] == (5, "ok") and counts["fact_staffing"][1] == "n/a"
    with pytest.raises(etl.LoadRejected):
        etl.load(spark, tables | {"fact_patient_visits": tables["fact_patient_visits"].limit(3)}, root,
                 expected_rows={"fact_patient_visits": 4}, allow_violations=ALLOWED)
    assert len(commits.commits(spark, root)) == 1


def test_calendar_follows_the_data(spark, root):
    """An arrival in 2005 has its weekday, and no shift is an orphan."""
    from wardflow.plans import audit
    from wardflow.sources.star import DriverStar

    sf = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part"):
        os.symlink(f"{sf}/{t}.parquet", f"{root}/{t}.parquet")
    move = F.when(F.col("o_orderkey") % 50 == 0, F.make_interval(years=F.lit(4))).otherwise(F.make_interval(years=F.lit(0)))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.withColumn("o_orderdate", F.col("o_orderdate") + move).write.parquet(f"{root}/orders.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("o_orderkey", F.col("l_orderkey"))
    lines.withColumn("l_shipdate", F.col("l_shipdate") + move).drop("o_orderkey").write.parquet(f"{root}/lineitem.parquet")
    s = DriverStar(spark, root)
    days = s.calendar().agg(F.min("full_date"), F.max("full_date"), F.count("*")).first()
    assert days[1].year > 2001 and days[2] == (days[1] - days[0]).days + 1
    assert s.visits("visit_id").count() == sum(r.n for r in _waits(s).collect())
    found = {(r.table_name, r.column_name): r.orphans for r in audit.reference_audit(s).collect()}
    assert found["fact_staffing", "shift_date"] == 0
    counts = {r.table_name: r.status for r in audit.row_counts(s, s.expected_rows()).collect()}
    assert counts["dim_date"] == "ok"


def _waits(s):
    """Visits that meet a calendar day, as the severity by weekday report joins them."""
    v = s.visits("arrival_datetime").select(F.to_date("arrival_datetime").alias("full_date"))
    return v.join(s.calendar().select("full_date"), "full_date").agg(F.count("*").alias("n"))
