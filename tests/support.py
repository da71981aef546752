"""Helpers that several test modules import."""

from __future__ import annotations


def rows(df, *cols):
    """Sorted tuples of a DataFrame (optionally of some columns)."""
    if cols:
        df = df.select(*cols)
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))


#: The sector averages over the materialised visits x shifts x finances product, by plain joins.
SECTOR_PRODUCT = """
WITH product AS (
  SELECT h.private, v.wait_time_minutes AS wait, v.readmission_30_days_flag AS again,
         s.burnout_risk_index AS burnout, f.profit_margin AS margin
  FROM dim_hospital AS h
  LEFT JOIN fact_patient_visits AS v USING (hospital_id)
  LEFT JOIN fact_staffing AS s ON s.hospital_id = h.hospital_id AND s.month = v.month
  LEFT JOIN fact_financials AS f ON f.hospital_id = h.hospital_id AND f.month = v.month)
SELECT private,
       CAST(round(CAST(avg(wait) AS DECIMAL(38,10)), 1) AS DOUBLE) AS wait_time,
       CAST(round(CAST(avg(burnout) AS DECIMAL(38,10)), 3) AS DOUBLE) AS burnout,
       CAST(round(CAST(try_divide(100.0D * count_if(again), count(*)) AS DECIMAL(38,10)), 2) AS DOUBLE) AS readmission,
       CAST(round(CAST(100.0D * avg(margin) AS DECIMAL(38,10)), 1) AS DOUBLE) AS profit_margin
FROM product GROUP BY private
"""
