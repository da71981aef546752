"""Eager aggregation of the fan-out reports.

The source SQL of the radar and regional reports LEFT JOINs visits to shifts
and to financial rows of the same hospital and month and then averages over
the product.  Materialising that product is quadratic in the fact sizes (2
billion rows at sf 0.1).  The same numbers come out of aggregating each fact
to (hospital, month) first and weighting every partial sum by the row counts
of the *other* facts that share its (hospital, month):

    AVG(visit measure) = sum(sum_v * n_s * n_f) / sum(cnt_v * n_s * n_f)
    AVG(shift measure) = sum(sum_s * n_v * n_f) / sum(cnt_s * n_v * n_f)
    COUNT(*)           = sum(n_v * n_s * n_f)

where a missing side counts as one row (LEFT JOIN keeps the left row once).
Each fact is shuffled once, on its (hospital, month) partial aggregate; the
joins are between frames of at most hospitals x months rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow.functions.numeric import count_true

COUNT_TYPE = "decimal(38,0)"


@dataclass
class FactSide:
    """One fact of the fan-out: its frame, measures to average, flags to count.

    ``frame`` holds rows, or with ``states`` partial states by (hospital, month):
    the columns of the number of rows, of each measure's sum and count, and of each flag's count.
    """

    name: str
    frame: DataFrame  # must hold hospital_id, month and the measures/flags
    measures: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    states: dict[str, str] | None = None

    def partial(self) -> DataFrame:
        p = self.name
        if self.states is not None:
            return self.frame.select(
                "hospital_id", "month", F.col(self.states["rows"]).alias(f"{p}__n"),
                *[F.col(f"{self.states[m]}_{kind}").alias(f"{p}__{name}__{m}")
                  for m in self.measures for kind, name in (("sum", "sum"), ("n", "cnt"))],
                *[F.col(self.states[flag]).alias(f"{p}__hits__{flag}") for flag in self.flags])
        aggs: list[Column] = [F.count(F.lit(1)).alias(f"{p}__n")]
        for m in self.measures:
            aggs.append(F.sum(m).alias(f"{p}__sum__{m}"))
            aggs.append(F.count(m).alias(f"{p}__cnt__{m}"))
        for flag in self.flags:
            aggs.append(count_true(flag).alias(f"{p}__hits__{flag}"))
        return self.frame.groupBy("hospital_id", "month").agg(*aggs)


def fanout_sums(hospitals: DataFrame, driver: FactSide, others: list[FactSide],
                group_cols: list[str]) -> DataFrame:
    """Grouped weighted sums equal to those over the naive LEFT-JOIN product.

    ``hospitals`` is the (already filtered) dimension, one row per hospital,
    holding ``group_cols``.  ``driver`` is the fact joined on hospital only;
    ``others`` join on (hospital, driver.month).  Returns one row per group
    with columns ``rows`` (COUNT(*)), ``sum__<m>``, ``cnt__<m>`` for every
    measure and ``hits__<flag>`` for every flag.
    """
    d = driver.partial().withColumnRenamed("month", "__month")
    joined = hospitals.join(d, "hospital_id", "left")
    for side in others:
        o = side.partial().withColumnRenamed("month", "__month")
        joined = joined.join(o, ["hospital_id", "__month"], "left")

    # Row multiplicities are products of per-(hospital, month) counts; at
    # 100 TB they exceed bigint (1e10 visits x 1e9 shifts), so they are
    # carried as exact decimal(38,0).  The frames are hospitals x months.
    sides = [driver, *others]
    mult = {s.name: F.coalesce(F.col(f"{s.name}__n"), F.lit(1)).cast(COUNT_TYPE) for s in sides}

    def weight_without(name: str) -> Column:
        w = F.lit(1).cast(COUNT_TYPE)
        for s in sides:
            if s.name != name:
                w = w * mult[s.name]
        return w

    aggs: list[Column] = []
    total = F.lit(1).cast(COUNT_TYPE)
    for s in sides:
        total = total * mult[s.name]
    aggs.append(F.sum(total).alias("rows"))
    for s in sides:
        w = weight_without(s.name)
        for m in s.measures:
            aggs.append(F.sum(F.col(f"{s.name}__sum__{m}") * w).alias(f"sum__{m}"))
            aggs.append(F.sum(F.col(f"{s.name}__cnt__{m}").cast(COUNT_TYPE) * w).alias(f"cnt__{m}"))
        for flag in s.flags:
            aggs.append(F.coalesce(F.sum(F.col(f"{s.name}__hits__{flag}").cast(COUNT_TYPE) * w),
                                   F.lit(0).cast(COUNT_TYPE)).alias(f"hits__{flag}"))
    return joined.groupBy(*group_cols).agg(*aggs)


def weighted_mean(measure: str) -> Column:
    """Mean of a measure from the columns ``fanout_sums`` returns."""
    return F.try_divide(F.col(f"sum__{measure}").cast("double"),
                        F.col(f"cnt__{measure}").cast("double"))
