"""Text functions: header/value normalisation and display-name rules.

All value-level rules are native Column expressions (no Python UDF).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the header normalisation turns into "_".
SEPARATORS = [" ", "-", ".", "·", "/"]

# Facility-name clean-up rules, applied in this order,
# case-insensitively (pattern, replacement).
FACILITY_NAME_RULES = [
    (r"\s+NHS\s+Foundation\s+Trust", ""),
    (r"\s+NHS\s+FT", ""),
    (r"\s+NHS\s+Trust", ""),
    (r"\s+University\s+Hospital", ""),
    (r"\s+Hospitals", ""),
    (r"\s+Hospital", ""),
    (r"\s+Infirmary", ""),
    (r"Nuffield Health", "Nuffield"),
    (r"University College London", "UCL"),
    (r"Leeds General", "Leeds Gen"),
    (r"Alder Hey Children's", "Alder Hey Childrens"),
    (r"Harrogate District", "Harrogate Dist"),
]

# Suffixes dropped (first occurrence each, in this order) from
# hospital names in the department stack.
SHORT_NAME_SUFFIXES = [" Hospital", " Infirmary", " NHS FT"]

# Short month names.
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def clean_column_name(name: object) -> str:
    """A3: trim, separators -> ``_``, lower case, collapse ``__``, strip ``_``.

    Used on headers (metadata), so it is a plain Python function.
    """
    s = str(name).strip()
    for sep in SEPARATORS:
        s = s.replace(sep, "_")
    s = s.lower()
    s = re.sub(r"_{2,}", "_", s)
    return s.strip("_")


def clean_name_col(c: Column | str) -> Column:
    """A4: the same normalisation applied to the values of a column."""
    col = F.col(c) if isinstance(c, str) else c
    sep_class = "[" + "".join(re.escape(s) for s in SEPARATORS) + "]"
    s = F.lower(F.regexp_replace(F.trim(col), sep_class, "_"))
    s = F.regexp_replace(s, "_{2,}", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def clean_facility_name(c: Column | str) -> Column:
    """Shorten a facility name with the ordered rules, then trim."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.coalesce(col, F.lit(""))
    for pattern, replacement in FACILITY_NAME_RULES:
        out = F.regexp_replace(out, "(?i)" + pattern, replacement)
    return F.trim(out)


def remove_first(c: Column, literal: str) -> Column:
    """Remove the first occurrence of a literal (JavaScript ``replace``)."""
    pos = F.instr(c, literal)
    return F.when(pos > 0, F.overlay(c, F.lit(""), pos, F.lit(len(literal)))).otherwise(c)


def short_hospital_name(c: Column | str) -> Column:
    """Drop the first " Hospital", " Infirmary" and " NHS FT"."""
    out = F.col(c) if isinstance(c, str) else c
    for suffix in SHORT_NAME_SUFFIXES:
        out = remove_first(out, suffix)
    return out


def first_underscore_to_space(c: Column | str) -> Column:
    """Replace only the first ``_`` with a space."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, "^([^_]*)_", "$1 ")


def month_short_name(month: Column | str) -> Column:
    """Month number 1-12 -> Jan..Dec; anything else -> null."""
    m = F.col(month) if isinstance(month, str) else month
    names = F.array(*[F.lit(x) for x in MONTH_SHORT])
    return F.when(m.between(1, 12), F.element_at(names, m.cast("int")))


def weekday_short(c: Column | str) -> Column:
    """First three characters of a weekday name."""
    col = F.col(c) if isinstance(c, str) else c
    return F.substring(col, 1, 3)


def char_code_bucket(c: Column | str, buckets: int = 6) -> Column:
    """Sum of character codes modulo ``buckets`` (stable per name)."""
    col = F.col(c) if isinstance(c, str) else c
    codes = F.transform(F.split(col, ""), lambda ch: F.coalesce(F.ascii(ch), F.lit(0)))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, x: acc + x) % F.lit(buckets)


def py_str(c: Column) -> Column:
    """A double as Python ``str`` prints it, for values in [0.001, 1e7)
    (every rounded metric of the alerts); null prints ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def fixed(c: Column | str, places: int) -> Column:
    """Thousands-separated text with a fixed number of decimals."""
    col = F.col(c) if isinstance(c, str) else c
    return F.format_number(col, places)


def currency(c: Column | str, symbol: str = "£", places: int = 0) -> Column:
    """A money amount as text, sign before the symbol."""
    col = F.col(c) if isinstance(c, str) else c
    body = F.format_number(F.abs(col), places)
    return F.when(col < 0, F.concat(F.lit("-" + symbol), body)).otherwise(F.concat(F.lit(symbol), body))
