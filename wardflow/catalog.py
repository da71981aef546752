"""Registry of the reports as ``(spark, sf_dir) -> DataFrame`` callables.

Every entry reads the driver tables in ``sf_dir`` through ``DriverStar`` and
runs the report over all of them (no id subsets: the per-hospital reports
are run for every hospital at once, keyed by ``hospital_id``).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.operators.scope import Scope
from wardflow.plans import audit, finance, outliers, overview, sector, shapes, sql, thresholds, trends
from wardflow.sources import etl, sheets
from wardflow.sources.star import DRIVER_TABLES, DriverStar

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_star(report: Callable[..., DataFrame], **kwargs) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(DriverStar(spark, sf_dir), **kwargs)
    run.__name__ = report.__name__
    run.__doc__ = report.__doc__
    run.on = lambda star: report(star, **kwargs)  # the same report on any Star
    run.report = lambda star, **more: report(star, **{**kwargs, **more})  # with filters
    run.report.__signature__ = inspect.signature(report)
    return run


def report_queries() -> dict[str, QueryFn]:
    return {
        # overview (R1-R5)
        "overview_kpis": _on_star(overview.kpis),
        "visits_over_time": _on_star(overview.visits_over_time),
        "visits_by_department": _on_star(overview.visits_by_department),
        "visits_treemap": _on_star(overview.visits_treemap),
        "daily_heatmap": _on_star(overview.daily_counts),
        "hourly_arrivals": _on_star(overview.hourly_arrivals),
        # outliers (R6-R9)
        "hospital_outliers": _on_star(outliers.hospital_outliers),
        "hospital_outliers_h1": _on_star(outliers.hospital_outliers, period="H1"),
        "hospital_outliers_h2": _on_star(outliers.hospital_outliers, period="H2"),
        "bump_rankings": _on_star(outliers.bump_rankings),
        "sankey_links": _on_star(outliers.sankey_links),
        "sankey_nodes": _on_star(outliers.sankey_nodes),
        "sankey_dropped": _on_star(outliers.sankey_dropped),
        "severity_weekday_wait": _on_star(outliers.severity_weekday_wait),
        # sector (R10-R12)
        "radar_profiles": _on_star(sector.radar_profiles),
        "diverging_wait": _on_star(sector.diverging_wait),
        "regional_choropleth": _on_star(sector.regional_choropleth),
        # burnout & finance
        "burnout_financials": _on_star(finance.burnout_financials),
        "financial_waterfall": _on_star(finance.financial_waterfall),
        "absences_overtime": _on_star(finance.absences_overtime),
        "burnout_by_month": _on_star(finance.burnout_by_month),
        "cfo_alerts": _on_star(finance.cfo_alerts),
        # notebook analyses
        "threshold_flags": _on_star(thresholds.threshold_flags),
        "half_year_shift": _on_star(thresholds.half_year_shift),
        "double_violators": _on_star(thresholds.double_violators),
        "burnout_violators": _on_star(thresholds.burnout_violators),
        # the same analysis as SQL over the star's views
        "sql_threshold_flags": _on_star(sql.sql_report),
    }


def shape_queries() -> dict[str, QueryFn]:
    return {
        "department_pivot": _on_star(shapes.department_pivot, departments=list(sheets.DEPARTMENT_NAMES)),
        "department_totals": _on_star(shapes.department_totals),
        "calendar_heatmap": _on_star(shapes.calendar_heatmap),
        "kpi_target_gap": _on_star(shapes.kpi_target_gap),
        "department_families": _on_star(shapes.department_families),
        "filter_options": _on_star(shapes.filter_options),
        "readmission_month_pivot": _on_star(shapes.readmission_month_pivot, hospital_ids=[f"H{k:02d}" for k in range(1, 26)]),
        "sankey_node_stats": _on_star(shapes.sankey_node_stats),
        "sankey_link_shares": _on_star(shapes.sankey_link_shares),
        "severity_weekday_grid": _on_star(shapes.severity_weekday_grid),
        "scatter_focus": _on_star(shapes.scatter_focus),
        "facility_ledger": _on_star(shapes.facility_ledger),
        "regional_alarms": _on_star(shapes.regional_alarms),
        "diverging_bars": _on_star(shapes.diverging_bars),
        "sector_gap": _on_star(shapes.sector_gap),
        "waterfall_bars": _on_star(shapes.waterfall_bars),
        "burnout_month_pivot": _on_star(shapes.burnout_month_pivot, hospital_names=[f"NATION_{k}" for k in range(25)]),
        "burnout_hospital_list": _on_star(shapes.burnout_hospital_list),
        "alert_summary": _on_star(shapes.alert_summary),
        "deficit_hospitals": _on_star(shapes.deficit_hospitals),
        "department_labels": _on_star(shapes.department_labels),
        "kpi_labels": _on_star(shapes.kpi_labels),
        "waterfall_labels": _on_star(shapes.waterfall_labels),
        "ledger_places": _on_star(shapes.ledger_places, sort_by="city"),
    }


def trend_queries() -> dict[str, QueryFn]:
    """Growth, winter surge, delayed effects and slopes."""
    return {
        "visit_growth": _on_star(trends.visit_growth),
        "visit_growth_by_year": _on_star(trends.visit_growth_by_year),
        "winter_surge": _on_star(trends.winter_surge),
        "absence_overtime_lags": _on_star(trends.absence_overtime_lags),
        "absence_overtime_network": _on_star(trends.absence_overtime_network),
        "half_year_slopes": _on_star(trends.half_year_slopes),
    }


def scoped_queries() -> dict[str, QueryFn]:
    """Reports under a dashboard filter, a search or a sort."""
    region, private = Scope(region="R02"), Scope(trust_type="Independent / Private")
    return {
        "overview_kpis_region": _on_star(overview.kpis, scope=region),
        "hospital_outliers_private": _on_star(outliers.hospital_outliers, scope=private),
        "radar_profiles_region": _on_star(sector.radar_profiles, scope=region),
        "regional_choropleth_private": _on_star(sector.regional_choropleth, scope=private),
        "sankey_links_hospital": _on_star(outliers.sankey_links, hospital_id="H07"),
        "severity_weekday_wait_hospital": _on_star(outliers.severity_weekday_wait, hospital_id="H07"),
        "facility_ledger_search": _on_star(shapes.facility_ledger, text="nation_1", sort_by="avg_wait_time",
                                           ascending=True),
        "visits_treemap_text": _on_star(overview.visits_treemap_text),
        "visits_treemap_json": _on_star(overview.visits_treemap_json),
        "calendar_heatmap_1997": _on_star(shapes.calendar_heatmap, year="1997"),
    }


def _reconciled_rows() -> QueryFn:
    """A15 with the counts that the driver tables imply; on another star nothing is expected."""
    plain = _on_star(audit.row_counts)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = DriverStar(spark, sf_dir)
        return audit.row_counts(star, star.expected_rows())
    run.on, run.report = plain.on, plain.report
    return run


def conform_queries() -> dict[str, QueryFn]:
    """The load's conforming step (A3-A9) over untidy sheets of whole driver tables."""
    def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
        return etl.conform_table("fact_patient_visits", etl.normalise_headers(sheets.visit_sheet(spark, sf_dir)))

    def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
        sheet = etl.normalise_headers(sheets.visit_sheet(spark, sf_dir)).select("visit_id", "icu_required_flag")
        return etl.conform_table("fact_patient_visits", sheet, strict_flags=True)

    def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
        return etl.conform_vocabulary(sheets.vocabulary_sheet(spark, sf_dir))

    def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return etl.conform_table("fact_staffing", etl.normalise_headers(sheets.shift_sheet(spark, sf_dir)))

    return {"conform_visits": visits, "conform_flags": flags, "conform_vocabulary": vocabulary, "conform_shifts": shifts}


def source_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3: the driver tables read as sources: their normalised headers and rows."""
    found = etl.read_sources(spark, sf_dir, tables={f"{t}.parquet": t for t in DRIVER_TABLES})
    return reduce(DataFrame.unionAll, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), F.lit(",".join(df.columns)).alias("headers"), "rows")
        for t, df in found.items()])


def named_queries() -> dict[str, QueryFn]:
    """Display rules over a star whose names they know."""
    def on(report: Callable[..., DataFrame], **kwargs) -> QueryFn:
        return lambda spark, sf_dir: report(sheets.NamedStar(spark, sf_dir), **kwargs)

    return {
        "named_department_pivot": on(shapes.department_pivot, departments=list(sheets.DEPARTMENT_NAMES.values())),
        "named_department_stack": on(shapes.department_stack),
        "named_department_families": on(shapes.department_families),
        "named_diverging_bars": on(shapes.diverging_bars),
        "named_deficit_hospitals": on(shapes.deficit_hospitals),
    }


def audit_queries() -> dict[str, QueryFn]:
    return {
        "audit_keys": _on_star(audit.key_audit),
        "audit_references": _on_star(audit.reference_audit),
        "audit_row_counts": _reconciled_rows(),
        "audit_headline": _on_star(audit.headline_check),
        "audit_sector_agreement": _on_star(audit.sector_agreement),
        "audit_dimension_bounds": _on_star(audit.dimension_bounds),
    }


def star_queries() -> dict[str, QueryFn]:
    """The queries that run on any star."""
    return {**report_queries(), **shape_queries(), **trend_queries(), **scoped_queries(),
            **audit_queries()}


def queries() -> dict[str, QueryFn]:
    return {**star_queries(), **conform_queries(), **named_queries(), "source_tables": source_tables}
