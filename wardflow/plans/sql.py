"""A report written as Spark SQL over the star's temporary views.

The views hold only the columns that the statement reads, so no join is made
for others.  Rounding goes through decimals, as in ``numeric.round_dec``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardflow.sources.star import Star
from wardflow.sources.views import register_views

# Full-year threshold analysis (R18): each fact becomes one row per hospital
# with its count or mean, and the limits are tested on the rounded figures.
FULL_YEAR_THRESHOLDS = """
SELECT hospital_id, hospital_name, total_visits, readmission_rate_pct, avg_burnout_index,
       readmission_rate_pct > 11.0 AS violates_readmission,
       avg_burnout_index > 0.60 AS violates_burnout,
       least(readmission_rate_pct > 11.0, avg_burnout_index > 0.60) AS violates_both
FROM {prefix}dim_hospital
JOIN (SELECT hospital_id, count(visit_id) AS total_visits,
             double(round(cast(100.0D * count_if(readmission_30_days_flag) / count(*) AS DECIMAL(38,10)), 2))
                 AS readmission_rate_pct
      FROM {prefix}fact_patient_visits GROUP BY ALL) USING (hospital_id)
JOIN (SELECT hospital_id, double(round(cast(avg(burnout_risk_index) AS DECIMAL(38,10)), 3)) AS avg_burnout_index
      FROM {prefix}fact_staffing GROUP BY ALL) USING (hospital_id)
ORDER BY readmission_rate_pct DESC NULLS FIRST
"""

COLUMNS = {
    "dim_hospital": ["hospital_id", "hospital_name"],
    "fact_patient_visits": ["hospital_id", "visit_id", "readmission_30_days_flag"],
    "fact_staffing": ["hospital_id", "burnout_risk_index"],
}


def sql_report(star: Star, text: str = FULL_YEAR_THRESHOLDS,
               columns: dict[str, list[str]] = COLUMNS, prefix: str = "wardflow_") -> DataFrame:
    """Register the columns that ``text`` reads as views and run it with ``spark.sql``.

    The views are resolved when the statement is analysed, so the returned
    DataFrame keeps its own plan even if the views are replaced later; the
    prefix keeps them apart from the caller's own views.
    """
    register_views(star, list(columns), prefix, columns)
    return star.spark.sql(text.replace("{prefix}", prefix))
