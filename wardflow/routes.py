"""The dashboard's request paths mapped onto the DataFrame reports.

A caller that used to request ``GET /hospitals/outliers?region=R02&period=H2``
calls ``call(star, "/hospitals/outliers", region="R02", period="H2")`` and gets
the same report as a DataFrame (no server is involved).  Path parameters in
braces are read from the path.  Arguments a route ignores are accepted and
ignored, as the dashboard's server did (T10).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wardflow.operators.scope import Scope
from wardflow.plans import finance, outliers, overview, sector
from wardflow.sources.star import Star


@dataclass(frozen=True)
class Route:
    report: Callable[..., DataFrame]
    takes_period: bool = False
    path_hospital: bool = False


def _sankey(star: Star, hospital_id: str, scope: Scope) -> dict[str, DataFrame]:
    return {"nodes": outliers.sankey_nodes(star, hospital_id, scope),
            "links": outliers.sankey_links(star, hospital_id, scope)}


# Request paths of the dashboard's reports.
ROUTES: dict[str, Route] = {
    "/overview/kpis": Route(overview.kpis),
    "/overview/visits-over-time": Route(overview.visits_over_time),
    "/overview/visits-treemap": Route(overview.visits_treemap),
    "/overview/daily-heatmap": Route(overview.daily_counts),
    "/overview/hourly-arrivals": Route(overview.hourly_arrivals),
    "/hospitals/outliers": Route(outliers.hospital_outliers, takes_period=True),
    "/hospitals/bump-rankings": Route(outliers.bump_rankings),
    "/hospitals/{hospital_id}/sankey-flow": Route(_sankey, path_hospital=True),
    "/hospitals/{hospital_id}/severity-weekday-wait": Route(outliers.severity_weekday_wait, path_hospital=True),
    "/analytics/radar-profiles": Route(sector.radar_profiles),
    "/analytics/diverging-wait": Route(sector.diverging_wait),
    "/analytics/regional-choropleth": Route(sector.regional_choropleth),
    "/analytics/burnout-financials": Route(finance.burnout_financials),
    "/analytics/financial-waterfall": Route(finance.financial_waterfall),
    "/analytics/absences-overtime": Route(finance.absences_overtime),
    "/analytics/satisfaction-burnout-slope": Route(finance.burnout_by_month),
    "/analytics/cfo-alerts": Route(finance.cfo_alerts),
}


def _match(path: str) -> tuple[Route, dict[str, str]]:
    clean = "/" + path.split("?", 1)[0].strip("/")
    for pattern, route in ROUTES.items():
        regex = "^" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", pattern) + "$"
        m = re.match(regex, clean)
        if m:
            return route, m.groupdict()
    raise KeyError(f"no report at {path!r}")


def call(star: Star, path: str, region: str | None = None, trust_type: str | None = None,
         hospital_id: str | None = None, period: str | None = None) -> DataFrame | dict[str, DataFrame]:
    """The report behind ``path`` with the dashboard's query parameters."""
    route, params = _match(path)
    if route.path_hospital:
        # the path names the hospital; a hospital_id query argument is ignored
        return route.report(star, params["hospital_id"], Scope(region, trust_type))
    scope = Scope(region, trust_type, hospital_id)
    if route.takes_period:
        return route.report(star, scope, period=period)
    return route.report(star, scope)
