"""Banding and classification rules of the dashboard pages (§2.9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow.functions.text import char_code_bucket, first_underscore_to_space

# Daily-visit intensity band upper limits (P2), band 0..4.
INTENSITY_LIMITS = [2, 6, 11, 16]

# Wait band limits in minutes.
WAIT_LIMITS = [50, 75, 95]

# Staffing-stress score rules.
STRESS_BURNOUT = (0.62, 0.60)
STRESS_WAIT = (90, 60)
STRESS_READMISSION_FRACTION = (0.19, 0.15)
STRESS_LEVELS = [(5, "CRITICAL"), (3, "HIGH"), (1, "MODERATE")]

PRIVATE_TRUST_TYPE = "Independent / Private"   # P13
READMISSION_TARGET = 11.0                       # P5, percent
REGIONAL_ALARM = 17.0                           # P16, percent
READMISSION_BAND_MARGIN = 0.8                   # P14, points

# Outcome nodes placed in the last flow stage (P7) and the
# targets drawn as warnings.
OUTCOME_NODES = ["Discharged", "Deceased", "Readmitted", "Transfer", "Referred", "AMA"]
WARNING_TARGETS = ["Readmitted", "Deceased"]

# Department families by name substring, first match wins.
DEPARTMENT_FAMILIES = [
    (["emergency", "accident"], "emergency"),
    (["icu", "intensive", "critical"], "critical care"),
    (["pediatrics", "child"], "paediatrics"),
    (["cardiology", "heart"], "cardiology"),
    (["oncology", "cancer"], "oncology"),
    (["general medicine", "internal"], "general medicine"),
]

# Alert type -> summary label (P21); others fall back to the
# type with its first "_" turned into a space.
ALERT_LABELS = {
    "CRITICAL_BURNOUT": "Staffing stress",
    "FINANCIAL_SQUEEZE": "Financial squeeze",
    "READMISSION_SPIKE": "Readmission spike",
    "STAFFING_STRESS": "Staffing stress",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def intensity_band(count: Column | str) -> Column:
    """0 for <=2 visits, 1 for <=6, 2 for <=11, 3 for <=16, else 4."""
    c = _col(count)
    out = F.lit(len(INTENSITY_LIMITS))
    for band, limit in reversed(list(enumerate(INTENSITY_LIMITS))):
        out = F.when(c <= limit, F.lit(band)).otherwise(out)
    return out


def wait_band(wait: Column | str) -> Column:
    """P11: "none" for null/0, then "<50", "<75", "<95", ">=95"."""
    c = _col(wait)
    return (F.when(c.isNull() | (c == 0), F.lit("none"))
            .when(c < WAIT_LIMITS[0], F.lit(f"<{WAIT_LIMITS[0]}"))
            .when(c < WAIT_LIMITS[1], F.lit(f"<{WAIT_LIMITS[1]}"))
            .when(c < WAIT_LIMITS[2], F.lit(f"<{WAIT_LIMITS[2]}"))
            .otherwise(F.lit(f">={WAIT_LIMITS[2]}")))


def _two_step(c: Column, limits: tuple[float, float]) -> Column:
    high, low = limits
    return F.when(c > high, F.lit(2)).when(c > low, F.lit(1)).otherwise(F.lit(0))


def stress_score(burnout: Column | str, wait: Column | str, readmission_pct: Column | str) -> Column:
    """0-6 points from burnout, wait and readmission fraction."""
    return (_two_step(_col(burnout), STRESS_BURNOUT)
            + _two_step(_col(wait), STRESS_WAIT)
            + _two_step(_col(readmission_pct) / F.lit(100.0), STRESS_READMISSION_FRACTION))


def stress_level(burnout: Column | str, wait: Column | str, readmission_pct: Column | str,
                 stored: Column | str) -> Column:
    """CRITICAL / HIGH / MODERATE / LOW; a null burnout keeps ``stored``."""
    score = stress_score(burnout, wait, readmission_pct)
    level = F.lit("LOW")
    for limit, name in reversed(STRESS_LEVELS):
        level = F.when(score >= limit, F.lit(name)).otherwise(level)
    return F.when(_col(burnout).isNull(), _col(stored)).otherwise(level)


def is_private_trust(trust_type: Column | str) -> Column:
    """The sector flag read from the trust type text."""
    return F.coalesce(_col(trust_type) == F.lit(PRIVATE_TRUST_TYPE), F.lit(False))


def target_gap(rate: Column | str, target: float = READMISSION_TARGET) -> Column:
    """P5: points above target (2 dp) or null when within target."""
    c = _col(rate)
    return F.when(c > target, F.round((c - F.lit(target)).cast("decimal(38,10)"), 2).cast("double"))


def readmission_band(rate: Column | str, mean: Column, margin: float = READMISSION_BAND_MARGIN) -> Column:
    """P14: "high" above mean+margin, "low" below mean-margin, else "normal"."""
    c = _col(rate)
    return (F.when(c > mean + F.lit(margin), F.lit("high"))
            .when(c < mean - F.lit(margin), F.lit("low"))
            .otherwise(F.lit("normal")))


def regional_alarm(rate: Column | str, limit: float = REGIONAL_ALARM) -> Column:
    """Region over the readmission alarm line."""
    return F.coalesce(_col(rate) > F.lit(limit), F.lit(False))


def flow_warning(target_name: Column | str) -> Column:
    """Flows into a warning outcome."""
    return _col(target_name).isin(*WARNING_TARGETS)


def department_family(name: Column | str) -> Column:
    """Family by ordered substring rules, else ``other-<bucket>``."""
    c = _col(name)
    low = F.lower(c)
    out = F.concat(F.lit("other-"), char_code_bucket(c).cast("string"))
    for needles, family in reversed(DEPARTMENT_FAMILIES):
        cond = F.lit(False)
        for n in needles:
            cond = cond | F.contains(low, F.lit(n))
        out = F.when(cond, F.lit(family)).otherwise(out)
    return out


def alert_label(alert_type: Column | str) -> Column:
    """Display label of an alert type with a fallback."""
    c = _col(alert_type)
    out = first_underscore_to_space(c)
    for kind, label in reversed(list(ALERT_LABELS.items())):
        out = F.when(c == F.lit(kind), F.lit(label)).otherwise(out)
    return out
