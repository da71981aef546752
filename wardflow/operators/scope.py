"""Filter operators shared by the reports.

The dashboard filter (region, trust type, hospital) is a predicate on the
hospital dimension.  It is applied to the dimension *before* any join, and
facts are reduced to in-scope hospitals with a semi join on the filtered
dimension (broadcast by Spark when its size is under the threshold), so the aggregation only sees in-scope rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Optional equality filters on ``dim_hospital``; empty means no filter."""

    region: str | None = None
    trust_type: str | None = None
    hospital_id: str | None = None

    def predicate(self) -> Column:
        cond = F.lit(True)
        if self.region:
            cond = cond & (F.col("region_id") == F.lit(self.region))
        if self.trust_type:
            cond = cond & (F.col("nhs_trust_type") == F.lit(self.trust_type))
        if self.hospital_id:
            cond = cond & (F.col("hospital_id") == F.lit(self.hospital_id))
        return cond

    def without_hospital(self) -> "Scope":
        return Scope(self.region, self.trust_type, None)


ALL = Scope()


def hospital_scope(hospitals: DataFrame, scope: Scope | None = None) -> DataFrame:
    """B1: the hospital dimension restricted to the filter."""
    scope = scope or ALL
    return hospitals.filter(scope.predicate())


def in_scope(fact: DataFrame, hospitals_in_scope: DataFrame) -> DataFrame:
    """Keep fact rows of in-scope hospitals (semi join on the small dim)."""
    return fact.join(hospitals_in_scope.select("hospital_id"), "hospital_id", "left_semi")


def half_year(fact: DataFrame, period: str | None) -> DataFrame:
    """``H1`` -> month <= 6, ``H2`` -> month > 6, anything else -> all."""
    if period == "H1":
        return fact.filter(F.col("month") <= 6)
    if period == "H2":
        return fact.filter(F.col("month") > 6)
    return fact


def search(df: DataFrame, text: str | None, *cols: str) -> DataFrame:
    """Case-insensitive literal substring match on any of ``cols``."""
    if not text:
        return df
    needle = F.lit(text.lower())
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    return df.filter(cond)


def focus_flag(df: DataFrame, focus_id: str | None, key: str = "hospital_id") -> DataFrame:
    """Mark the highlighted hospital (the rest is the complement)."""
    flag = F.col(key) == F.lit(focus_id) if focus_id else F.lit(False)
    return df.withColumn("is_focus", F.coalesce(flag, F.lit(False)))
