"""Every dashboard path answers through the route table."""

from __future__ import annotations

import pytest

from support import rows
from wardflow import routes
from wardflow.operators.scope import Scope
from wardflow.plans import outliers
from wardflow.sources.star import DriverStar


@pytest.mark.parametrize("path", sorted(routes.ROUTES))
def test_every_route_runs(spark, sf0001, path):
    star = DriverStar(spark, sf0001)
    out = routes.call(star, path.replace("{hospital_id}", "H07"), region="R03", period="H1")
    frames = out.values() if isinstance(out, dict) else [out]
    for df in frames:
        df.collect()


def test_route_arguments(spark, sf0001):
    star = DriverStar(spark, sf0001)
    got = routes.call(star, "/hospitals/outliers?x=1", region="R02", period="H2")
    assert rows(got) == rows(outliers.hospital_outliers(star, Scope(region="R02"), period="H2"))
    some = star.visits("hospital_id").first()[0]  # a hospital with visits at this scale
    other = "H99" if some != "H99" else "H98"
    flow = routes.call(star, f"/hospitals/{some}/sankey-flow", hospital_id=other)  # query id ignored
    assert {r[0] for r in flow["links"].select("hospital_id").collect()} == {some}
    assert flow["nodes"].count() > 0
    with pytest.raises(KeyError):
        routes.call(star, "/nope")


# The source system's smoke test allowed 10 s per request.
SMOKE_LIMIT_SECONDS = 10.0


@pytest.mark.parametrize("path", sorted(routes.ROUTES))
def test_every_route_answers_within_the_smoke_limit(spark, sf001, path):
    import time

    star = DriverStar(spark, sf001)
    started = time.perf_counter()
    out = routes.call(star, path.replace("{hospital_id}", "H07"))
    for df in (out.values() if isinstance(out, dict) else [out]):
        assert df.count() >= 0
    assert time.perf_counter() - started < SMOKE_LIMIT_SECONDS


def test_ignored_route_arguments(spark, sf0001):
    """The dashboard sends `period` to bump rankings and a second
    hospital id to the per-hospital routes; the server ignored both."""
    star = DriverStar(spark, sf0001)
    with_period = routes.call(star, "/hospitals/bump-rankings", period="H1")
    assert rows(with_period) == rows(routes.call(star, "/hospitals/bump-rankings"))
    some = star.visits("hospital_id").first()[0]
    a = routes.call(star, f"/hospitals/{some}/severity-weekday-wait", hospital_id="H99")
    b = routes.call(star, f"/hospitals/{some}/severity-weekday-wait")
    assert rows(a) == rows(b) and len(rows(a)) > 0
