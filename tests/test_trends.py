"""Trends over calendar time on hand-made frames (X2-X5) and the moments that they merge."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from support import rows
from test_traps import hospitals, star, v, visits
from wardflow.functions import moments
from wardflow.plans import trends


def at(year, month, day=10):
    return dt.datetime(year, month, day, 9)


def with_visits(spark, counts):
    """A star with so many visits: {(hospital, year, month): n}."""
    data = [(h, y, m) for (h, y, m), n in counts.items() for _ in range(n)]
    return star(spark, dim_hospital=hospitals(spark), fact_patient_visits=visits(
        spark, [v(i, h, month=m, arrival=at(y, m)) for i, (h, y, m) in enumerate(data)]))


def test_growth_has_no_gaps_and_no_first_year(spark):
    s = with_visits(spark, {("H01", 2023, 1): 4, ("H01", 2024, 1): 6, ("H01", 2024, 3): 1, ("H02", 2023, 2): 1})
    got = {(r.hospital_id, r.month): (r.visits, r.visits_year_ago, r.growth_pct) for r in trends.visit_growth(s).collect()}
    assert len(got) == 5 * 15  # every hospital of the dimension, January 2023 to March 2024
    assert got["H01", "2023-01"] == (4, None, None) and got["H01", "2024-01"] == (6, 4, 50.0)
    assert got["H02", "2024-02"] == (0, 1, -100.0) and got["H01", "2024-03"] == (1, 0, None)
    assert got["H09", "2024-01"] == (0, 0, None)


def test_partial_years_are_compared_by_like_months_only(spark):
    counts = {("H01", y, m): n for y, n, months in ((2022, 2, range(1, 13)), (2023, 3, range(1, 13)), (2024, 6, range(1, 4)))
              for m in months}
    got = {r.year: tuple(r)[3:] for r in trends.visit_growth_by_year(with_visits(spark, counts)).collect()
           if r.hospital_id == "H01"}
    assert got == {2022: (12, 24, None, None), 2023: (12, 36, 50.0, 50.0), 2024: (3, 18, None, 100.0)}


def test_november_to_january_is_one_season(spark):
    counts = {("H01", 2022, m): 2 for m in (8, 9, 10)} | {("H01", 2022, 11): 3, ("H01", 2022, 12): 4, ("H01", 2023, 1): 5}
    counts |= {("H01", 2023, 2): 2, ("H01", 2023, 4): 4, ("H01", 2023, 6): 50, ("H01", 2023, 12): 9}
    got = {r.season: tuple(r)[3:] for r in trends.winter_surge(with_visits(spark, counts)).collect() if r.hospital_id == "H01"}
    # 12 visits in 3 winter months against 12 in the 6 next to them (March has none)
    assert got[2022] == (12, 3, 12, 6, 100.0)
    assert got[2023] == (9, 2, 0, 3, None)  # January 2024 is not in the data
    empty = trends.winter_surge(with_visits(spark, {}))
    assert empty.count() == 0


SHIFT = "shift_id long, hospital_id string, department_id string, shift_date date, staff_absence_count int, overtime_hours double"


def with_shifts(spark, data):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], SHIFT)
    return star(spark, dim_hospital=hospitals(spark), fact_staffing=frame)


def test_overtime_two_weeks_after_absence(spark):
    """Overtime repeats the absences of two weeks before; the weeks in between have no shifts at all."""
    first, absences = dt.date(2024, 1, 1), [3, 0, 5, 1, 0, 7, 2, 0, 0, 4, 6, 1]
    overtime = [0.0, 0.0] + [float(a) for a in absences[:-2]]
    data = [("H01", "D1", first + dt.timedelta(days=7 * w + 2), a, o)
            for w, (a, o) in enumerate(zip(absences, overtime, strict=True)) if a or o]
    assert len(data) < len(absences)
    s = with_shifts(spark, data)
    weeks = rows(trends.weekly_shifts(s), "week", "absences", "overtime")
    assert [w[1:] for w in weeks] == [(float(a), o) for a, o in zip(absences, overtime, strict=True)]
    got = {r.lag_weeks: (r.pairs, r.correlation) for r in trends.absence_overtime_lags(s).collect()}
    assert got[2] == (10, 1.0) and [got[k][0] for k in range(9)] == list(range(12, 3, -1))
    for k in range(9):
        want = np.corrcoef(absences[:12 - k], overtime[k:])[0, 1]
        assert got[k][1] == pytest.approx(want, abs=1e-6)
    network = {r.lag_weeks: r.strongest for r in trends.absence_overtime_network(s).collect()}
    assert network == {k: k == 2 for k in range(9)}


def test_series_that_say_nothing(spark):
    """One week, constant sides, null departments and dates, hospitals outside the dimension."""
    day = dt.date(2024, 1, 1)
    data = [("H01", "D1", day, 1, 1.0), ("H02", None, day, 1, 1.0), ("H02", None, day + dt.timedelta(7), 1, 2.0),
            ("H03", "D1", None, 1, 1.0), ("H99", "D1", day, 1, 1.0), ("H07", "D1", day, None, None)]
    got = trends.absence_overtime_lags(with_shifts(spark, data)).collect()
    assert {(r.hospital_id, r.department_id) for r in got} == {("H01", "D1"), ("H02", None), ("H07", "D1")}
    assert all(r.correlation is None for r in got) and len(got) == 27
    network = trends.absence_overtime_network(with_shifts(spark, data)).collect()
    assert [r.pairs for r in network][:3] == [4, 1, 0]


def test_no_join_of_the_series_with_itself(spark, sf0001):
    from wardflow.sources.star import DriverStar

    plan = trends.lag_states(DriverStar(spark, sf0001))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("parquet") == 3  # scope and staffing's own join; no second scan


def test_merged_states_equal_the_whole(spark):
    draw = np.random.default_rng(5)
    data = [(int(g), int(m), float(x), None if draw.random() < 0.1 else float(x * 2 + draw.normal()))
            for g, m, x in zip(draw.integers(0, 3, 300), draw.integers(0, 12, 300), draw.normal(1e3, 5, 300), strict=True)]
    data += [(7, 1, 5.0, 1.0), (8, 1, 5.0, 1.0), (8, 2, 5.0, 3.0), (9, 1, 1.0, 4.0), (9, 2, 2.0, 4.0), (10, 1, None, 1.0)]
    frame = spark.createDataFrame(data, "g int, m int, x double, y double")
    parts = frame.groupBy("g", "m").agg(*moments.state_of(F.col("x"), F.col("y")))
    merged = moments.merge(parts, "g").select("g", "n", moments.correlation().alias("r"), moments.slope().alias("s"),
                                              moments.r_squared().alias("q"))
    got = {r.g: r for r in merged.collect()}
    want = {r.g: r for r in frame.groupBy("g").agg(
        F.expr("regr_count(y, x)").alias("n"), F.expr("regr_slope(y, x)").alias("s"), F.expr("regr_r2(y, x)").alias("q")).collect()}
    for g, w in want.items():
        assert got[g].n == w.n
        for a, b in ((got[g].s, w.s), (got[g].q, w.q)):
            assert a == (b if b is None else pytest.approx(b, rel=1e-6))
    assert got[7].s is None and got[8].s is None and got[9].q == 1.0 and got[9].r is None and got[10].n == 0
    halves = {r.g: r.n for r in moments.merge(parts, "g", where=F.col("m") < 6).collect()}
    assert halves[7] == 1 and set(halves) == set(want)


def test_slopes_of_the_halves(spark):
    sat = [v(i, "H01", month=m, sat=50.0 + m * (1 if m <= 6 else -2)) for i, m in enumerate(range(1, 13))]
    sat += [v(20 + i, "H02", month=3, sat=float(x)) for i, x in enumerate((1, 2))]  # one month: no line
    got = {r.hospital_id: r for r in trends.half_year_slopes(star(
        spark, dim_hospital=hospitals(spark), fact_patient_visits=visits(spark, sat))).collect()}
    one, two = got["H01"], got["H02"]
    assert (one.h1_satisfaction_slope, one.h2_satisfaction_slope, one.satisfaction_slope_change) == (1.0, -2.0, -3.0)
    assert one.h1_satisfaction_r2 == 1.0 and one.h1_burnout_slope is None
    assert two.h1_satisfaction_slope is None and two.h2_satisfaction_slope is None and len(got) == 5
