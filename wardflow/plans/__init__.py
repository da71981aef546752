"""Reports as DataFrame -> DataFrame functions over a ``Star``: overview,
outliers, sector, finance, thresholds, page-side shapes, audits and SQL."""
