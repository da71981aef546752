"""Property-based checks of the two hard parts: fan-out equality and rounding."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from support import SECTOR_PRODUCT
from test_traps import financials, hospitals, staffing, star, visits
from wardflow.functions.numeric import round_dec
from wardflow.plans import sector
from wardflow.sources.views import register_views

HOSPITAL_IDS = ["H01", "H02", "H03", "H07", "H09", "H99"]  # H99: not in the dimension
MONTHS = st.one_of(st.none(), st.integers(1, 3))

visit_rows = st.lists(st.tuples(st.sampled_from(HOSPITAL_IDS), MONTHS,
                                st.one_of(st.none(), st.integers(0, 120).map(float)),
                                st.booleans()), max_size=25)
shift_rows = st.lists(st.tuples(st.sampled_from(HOSPITAL_IDS), MONTHS,
                                st.one_of(st.none(), st.integers(300, 900).map(lambda x: x / 1000))),
                      max_size=15)
money_rows = st.lists(st.tuples(st.sampled_from(HOSPITAL_IDS), MONTHS,
                                st.one_of(st.none(), st.integers(-10, 40).map(lambda x: x / 100))),
                      max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(visit_rows, shift_rows, money_rows)
def test_eager_fanout_equals_naive_join(spark, vs, ss, fs):
    v = visits(spark, [(i, h, m, None, w, r, 3, "Emergency", "Discharged", False, 50.0)
                       for i, (h, m, w, r) in enumerate(vs)])
    s = staffing(spark, [(i, h, m, b, 0, 0.0) for i, (h, m, b) in enumerate(ss)])
    f = financials(spark, [(str(i), h, m, p, 0.6, 0.1) for i, (h, m, p) in enumerate(fs)])
    frame = star(spark, dim_hospital=hospitals(spark), fact_patient_visits=v, fact_staffing=s,
                 fact_financials=f)
    register_views(frame, ["dim_hospital", "fact_patient_visits", "fact_staffing", "fact_financials"])
    naive = {r["private"]: r.asDict() for r in spark.sql(SECTOR_PRODUCT).collect()}
    eager = {r["private"]: r.asDict() for r in sector.sector_metrics(frame).collect()}
    assert set(naive) == set(eager)
    for key, row in naive.items():
        for metric in ("wait_time", "burnout", "readmission", "profit_margin"):
            assert eager[key][metric] == row[metric], (key, metric)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=200), st.integers(0, 3))
def test_round_dec_is_decimal_half_up(spark, ints, places):
    # values with exactly places+1 decimals put every tie at the rounding digit
    scale = 10 ** (places + 1)
    xs = [i / scale for i in ints]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_dec("x", places)).collect()]
    q = Decimal(1).scaleb(-places)
    want = [float(Decimal(repr(x)).quantize(q, rounding=ROUND_HALF_UP)) for x in xs]
    assert got == want
