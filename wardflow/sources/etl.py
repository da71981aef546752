"""Load job: read source tables, conform them, stage, audit, publish.

    tables = read_sources(spark, "/shared/in", fmt="csv")   # A1, A2, A3
    conformed = conform(tables)                              # A4-A9
    result = load(spark, conformed, "/shared/star")          # A10-A18

``load`` writes every table once into a new version folder under the target,
counts rows, null keys and unparsable timestamps while it writes, runs the key,
reference and headline audits on that copy (so the audits read files, not the
source lineage), stores the rollup next to it, and then publishes the version
by a commit to a small log (``sources.commits``), which two loads may do at
once.  A failed audit or write leaves the published star as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType
from pyspark.sql.utils import AnalysisException

from wardflow.functions.flags import strict_flag, truthy
from wardflow.functions.text import clean_column_name, clean_name_col
from wardflow.plans import audit
from wardflow.schemas import FOREIGN_KEYS, LAYOUT, LOAD_ORDER, PRIMARY_KEYS, SCHEMAS
from wardflow.sources import commits, rollup
from wardflow.sources.star import PublishedStar, Star

# Source table (sheet) names and the star table each becomes.
SOURCE_TABLES = {
    "Dim_Region": "dim_region",
    "Dim_Hospital": "dim_hospital",
    "Dim_Department": "dim_department",
    "Dim_Date": "dim_date",
    "Dim_Patient": "dim_patient",
    "Dim_Doctor": "dim_doctor",
    "Dim_Diagnosis": "dim_diagnosis",
    "Fact_Patient_Visits": "fact_patient_visits",
    "Fact_Staffing": "fact_staffing",
    "Fact_Financials": "fact_financials",
    "Vocabulary": "data_dictionary",
}

# Flag columns forced to boolean (A5).
FLAG_COLUMNS = {
    "dim_hospital": ["teaching_hospital", "private"],
    "dim_department": ["icu_capable"],
    "dim_date": ["is_weekend", "is_holiday", "is_winter", "is_flu_season"],
    "dim_doctor": ["part_time_flag"],
    "fact_patient_visits": ["icu_required_flag", "mortality_flag", "readmission_30_days_flag",
                            "complaint_flag", "ambulance_arrival_flag"],
    "fact_financials": ["expansion_projects_flag"],
}
# Date columns that must parse (A6) and timestamps where bad values become null.
STRICT_DATES = {"dim_date": ["full_date"], "fact_staffing": ["shift_date"]}
COERCED_TIMESTAMPS = {"fact_patient_visits": ["arrival_datetime", "triage_datetime",
                                              "treatment_start_datetime", "discharge_datetime"]}
# Columns repeated from dim_hospital that the facts drop if present.
DENORMALISED = {t: ["hospital_name", "latitude", "longitude"]
                for t in ("fact_patient_visits", "fact_staffing", "fact_financials")}
# Columns of the vocabulary sheet, by position.
VOCABULARY_COLUMNS = ["table_name", "column_name", "data_type", "description", "uk_context", "notes"]


class SourceMissing(FileNotFoundError):
    """A2: a source table could not be found."""


class LoadRejected(RuntimeError):
    """An audit found a blocking violation; nothing was published."""

    def __init__(self, message: str, findings: dict[str, list]):
        super().__init__(message)
        self.findings = findings


# ------------------------------------------------------------------ read
def normalise_headers(df: DataFrame) -> DataFrame:
    """A3: rename every column with ``clean_column_name`` (metadata only)."""
    return df.toDF(*[clean_column_name(c) for c in df.columns])


def read_sources(spark: SparkSession, root: str, fmt: str = "parquet",
                 tables: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """A1 + A2: one DataFrame per source table found at ``root/<name>``.

    CSV sources are read as text (no inference) and typed by ``conform``.
    """
    tables = tables or SOURCE_TABLES
    out = {}
    for source, target in tables.items():
        path = f"{root.rstrip('/')}/{source}"
        reader = spark.read
        if fmt == "csv":
            reader = reader.option("header", True).option("inferSchema", False)
        try:
            df = reader.format(fmt).load(path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
                raise SourceMissing(f"Source table not found: {path}") from exc
            raise
        out[target] = df if target == "data_dictionary" else normalise_headers(df)
    return out


# --------------------------------------------------------------- conform
def conform_vocabulary(raw: DataFrame) -> DataFrame:
    """A9 + A4: drop the embedded header row, name the six columns by
    position, drop rows without table or column, normalise the names."""
    first = raw.columns[0]
    df = raw.filter(F.col(first).isNull() | (F.col(first).cast("string") != F.lit("Table")))
    df = df.toDF(*VOCABULARY_COLUMNS[: len(df.columns)])
    df = df.dropna(subset=["table_name", "column_name"])
    return df.select(
        clean_name_col(F.col("table_name").cast("string")).alias("table_name"),
        clean_name_col(F.col("column_name").cast("string")).alias("column_name"),
        *[F.col(c).cast("string").alias(c) for c in VOCABULARY_COLUMNS[2:] if c in df.columns])


def conform_table(name: str, df: DataFrame, strict_flags: bool = False,
                  coerced: Observation | None = None) -> DataFrame:
    """A5-A8 for one table: flags, dates, timestamps, dropped columns,
    declared types for the measures.  Ids keep the source's type, other
    unknown columns are kept.  A value that its type can't hold fails the load
    (ANSI cast); a whole number may be written as ``3.0``.  ``coerced`` counts, by
    column, the timestamps that did not parse, in whichever job reads the frame."""
    if name == "data_dictionary":
        return conform_vocabulary(df)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    declared = {f.name: f.dataType for f in SCHEMAS[name].fields}
    ids = {PRIMARY_KEYS.get(name), *(col for t, col, _, _ in FOREIGN_KEYS if t == name)}
    ids = {c for c in ids if c and not isinstance(declared.get(c), DateType)}
    exprs, lost = [], []
    for c in df.columns:
        if c in DENORMALISED.get(name, []):
            continue
        col = F.col(f"`{c}`")
        if c in FLAG_COLUMNS.get(name, []):
            col = strict_flag(col) if strict_flags else truthy(col, dtypes[c])
        elif c in STRICT_DATES.get(name, []):
            col = F.to_date(col)  # ANSI: an unparsable date fails the load
        elif c in COERCED_TIMESTAMPS.get(name, []):
            raw = col
            col = (F.try_to_timestamp(col.cast("string")) if dtypes[c].simpleString() == "string"
                   else col).cast("timestamp_ntz")
            if dtypes[c].simpleString() == "string":
                lost.append(F.count_if(raw.isNotNull() & (F.trim(raw) != "") & col.isNull()).alias(c))
        elif c in declared and c not in ids:
            if dtypes[c].simpleString() == "string":
                col = F.when(F.trim(col) != "", col)  # an empty cell
                if declared[c].simpleString() in ("int", "bigint", "smallint"):
                    col = F.regexp_replace(F.trim(col), r"\.0+$", "")
            col = col.cast(declared[c])
        exprs.append(col.alias(c))
    if coerced is not None and lost:
        df = df.observe(coerced, *lost)
    return df.select(*exprs)


def conform(tables: dict[str, DataFrame], strict_flags: bool = False,
            coerced: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    """All tables; ``coerced`` gets an observation for each table with timestamps (give it to ``load``)."""
    out = {}
    for name, df in tables.items():
        seen = None
        texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
        if coerced is not None and texts & set(COERCED_TIMESTAMPS.get(name, [])):
            seen = coerced[name] = Observation(f"coerced {name} {uuid.uuid4().hex}")
        out[name] = conform_table(name, df, strict_flags, seen)
    return out


# -------------------------------------------------------- write / publish
def _write(df: DataFrame, path: str, name: str) -> dict[str, int]:
    """Write a table and return what its write counted: rows, and nulls of its key."""
    # Cluster by the columns reports filter and join on so Parquet
    # min/max statistics prune row groups.  ``rebalance`` lets AQE size
    # the output partitions from the measured shuffle bytes (advisory
    # partition size) and split a hot hospital's partition into several,
    # so file sizes hold at any scale; the sort makes each file's row
    # groups cover narrow (hospital, time) ranges.
    cols = [c for c in LAYOUT.get(name, ()) if c in df.columns]
    if cols:
        df = df.hint("rebalance", cols[0]).sortWithinPartitions(*cols)
    counted = [F.count(F.lit(1)).alias("rows")]
    key = PRIMARY_KEYS.get(name)
    if key in df.columns:
        counted.append(F.count_if(F.col(key).isNull()).alias("null_keys"))
    # after the sort: the writing tasks count, each of which commits once
    seen = Observation(f"write {name} {uuid.uuid4().hex}")
    df.observe(seen, *counted).write.parquet(path)
    return seen.get


@dataclass
class LoadResult:
    staged_at: str
    published_to: str | None
    findings: dict[str, list] = field(default_factory=dict)


def audit_findings(star: Star, expected_rows: dict[str, int] | None = None,
                   written: dict[str, dict[str, int]] | None = None) -> dict[str, list]:
    """Run the audits; the results are per-table summaries (tens of rows).

    ``written``: what the writes counted; then no table is read for its count.
    """
    if written is None:
        counts = [r.asDict() for r in audit.row_counts(star, expected_rows).collect()]
    else:
        counts = [_counted(t, (written.get(t) or {"rows": 0})["rows"], (expected_rows or {}).get(t)) for t in PRIMARY_KEYS]
    return {
        "keys": [r.asDict() for r in audit.key_audit(star).collect()],
        "references": [r.asDict() for r in audit.reference_audit(star).collect()],
        "row_counts": counts,
        "headline": [r.asDict() for r in audit.headline_check(star).collect()],
    }


def _counted(table: str, rows: int, expected: int | None) -> dict:
    status = "n/a" if expected is None else "ok" if rows == expected else "mismatch"
    return {"table_name": table, "rows": rows, "expected": expected, "status": status}


def finding_name(kind: str, row: dict) -> str:
    """``audit:table:column``, by which a finding is allowed."""
    return f"{kind}:{row['table_name']}:{row.get('key_column') or row.get('column_name') or '*'}"


def blocking(findings: dict[str, list], allow: set[str] | frozenset = frozenset()) -> list[str]:
    """Findings that stop a load: keys, references and row counts other than expected.

    The headline metric is a benchmark of one data set; it is reported only.
    """
    bad = []
    for kind in ("keys", "references", "row_counts"):
        for row in findings.get(kind, []):
            if row["status"] not in ("ok", "n/a") and finding_name(kind, row) not in allow:
                bad.append(f"{finding_name(kind, row)}: {row}")
    return bad


def load(spark: SparkSession, tables: dict[str, DataFrame], target: str,
         run_id: str | None = None, allow_violations: set[str] | frozenset = frozenset(),
         publish: bool = True, expected_rows: dict[str, int] | None = None,
         coerced: dict[str, Observation] | None = None) -> LoadResult:
    """A10 + A18: write a version in dependency order, audit it, publish it.

    Every table is written once, below ``_versions/<run_id>``; the audits read
    those files, the rollup is made from them; then one commit makes the
    whole version current.  Until that commit readers see the old star, after
    it the new one; loads that run at once commit one after the other.
    ``allow_violations`` names findings (``finding_name``)
    that are reported but do not block; ``expected_rows`` is the number of
    rows that each table must have (A15).  ``coerced`` are the observations of
    ``conform``: timestamps that did not parse are listed in the findings (A7).
    """
    run_id = run_id or uuid.uuid4().hex[:12]
    root = target.rstrip("/")
    version = f"{root}/_versions/{run_id}"
    written = {name: _write(tables[name], f"{version}/{name}", name) for name in LOAD_ORDER if name in tables}
    findings = audit_findings(PublishedStar(spark, version), expected_rows, written)
    findings["coerced"] = [{"table_name": t, "column_name": c, "rows": n, "status": "ok" if n == 0 else "coerced"}
                           for t, seen in (coerced or {}).items() for c, n in sorted(seen.get.items())]
    bad = blocking(findings, allow_violations)
    if bad:
        raise LoadRejected(f"{len(bad)} blocking audit finding(s); nothing published: {bad[0]}", findings)
    rollup.write(PublishedStar(spark, version), version)
    if not publish:
        return LoadResult(version, None, findings)
    commits.publish(spark, root, run_id)
    return LoadResult(version, root, findings)


def star_tables(star: Star) -> dict[str, DataFrame]:
    """All tables of a star source (to load a derived star as-is)."""
    return {name: star.table(name) for name in LOAD_ORDER}
