"""Bivariate moments that merge: correlations and regression lines from partial states.

A state is (n, mean_x, mean_y, m_xx, m_yy, m_xy): the pairs' number, their
means and their centred sums of squares and products.  States of disjoint
sets of pairs merge exactly, so a line over a year comes from the months'
states without the rows.  Pairs with a null take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("n", "mean_x", "mean_y", "m_xx", "m_yy", "m_xy")


def state_of(x: Column, y: Column, prefix: str = "") -> list[Column]:
    """Aggregates that make the state of the pairs (x, y) of a group."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    parts = {"n": n, "mean_x": F.avg(a), "mean_y": F.avg(b), "m_xx": F.var_pop(a) * n, "m_yy": F.var_pop(b) * n,
             "m_xy": F.covar_pop(a, b) * n}
    return [value.alias(prefix + name) for name, value in parts.items()]


def merge(states: DataFrame, *keys: str, where: Column | None = None, prefix: str = "") -> DataFrame:
    """The states of ``keys`` from finer ones (those with ``where``); no row of theirs gives n = 0.

    Centred sums add up, plus each part's number times the squared distance of
    its mean from the common mean; the common mean is that of the group's means by number.
    """
    c = {name: F.col(prefix + name) for name in STATE}
    use = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    n = F.when(use & (c["n"] > 0), c["n"])
    parts = F.collect_list(F.when(n.isNotNull(), F.struct(*[c[s].alias(s) for s in STATE])))
    grouped = states.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n"), (F.sum(n * c["mean_x"]) / F.sum(n)).alias("mean_x"),
        (F.sum(n * c["mean_y"]) / F.sum(n)).alias("mean_y"), parts.alias("parts"))

    def centred(a: str, b: str) -> Column:
        def add(total: Column, p: Column) -> Column:
            return total + p[f"m_{a}{b}"] + p["n"] * (p[f"mean_{a}"] - F.col(f"mean_{a}")) * (p[f"mean_{b}"] - F.col(f"mean_{b}"))
        return F.when(F.col("n") > 0, F.aggregate("parts", F.lit(0.0), add))

    return grouped.select(*keys, *[F.col(s).alias(prefix + s) for s in STATE[:3]],
                          *[centred(*s[2:]).alias(prefix + s) for s in STATE[3:]])


def correlation(prefix: str = "") -> Column:
    """Pearson's r of a state; null below two pairs or when either side is constant."""
    xx, yy, xy = (F.col(prefix + s) for s in STATE[3:])
    return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))


def slope(prefix: str = "") -> Column:
    """Least-squares slope of y over x; null when x is constant (one point, too)."""
    return F.when(F.col(prefix + "m_xx") > 0, F.col(prefix + "m_xy") / F.col(prefix + "m_xx"))


def r_squared(prefix: str = "") -> Column:
    """Coefficient of determination: null when x is constant, 1 when only y is."""
    xx, yy, xy = (F.col(prefix + s) for s in STATE[3:])
    return F.when(xx > 0, F.when(yy > 0, xy * xy / (xx * yy)).otherwise(F.lit(1.0)))
