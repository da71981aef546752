"""Declared schema of the hospital star, with its key metadata as data.

Every published table has a StructType here; keys, unique columns and
references are listed once and drive the audits (A11-A13).  ``ROW_BOUND``
is the size that a dimension is expected to stay under; ``audit.dimension_bounds``
reports it, no plan or load depends on it.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 2)


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, StructType] = {
    "dim_region": _struct(("region_id", StringType()), ("region_name", StringType())),
    "dim_hospital": _struct(
        ("hospital_id", StringType()),
        ("hospital_name", StringType()),
        ("region_id", StringType()),
        ("nhs_trust_type", StringType()),
        ("private", BooleanType()),
        ("teaching_hospital", BooleanType()),
        ("city", StringType()),
        ("staffing_stress", StringType()),
        ("total_beds", IntegerType()),
        ("icu_beds", IntegerType()),
    ),
    "dim_department": _struct(
        ("department_id", StringType()),
        ("department_name", StringType()),
        ("icu_capable", BooleanType()),
    ),
    "dim_date": _struct(
        ("date_key", IntegerType()),
        ("full_date", DateType()),
        ("day_of_week", StringType()),
        ("day_number", IntegerType()),
        ("month_name", StringType()),
        ("is_weekend", BooleanType()),
        ("is_holiday", BooleanType()),
        ("is_winter", BooleanType()),
        ("is_flu_season", BooleanType()),
    ),
    "dim_patient": _struct(("patient_id", LongType()), ("patient_segment", StringType())),
    "dim_doctor": _struct(
        ("doctor_id", LongType()),
        ("primary_hospital_id", StringType()),
        ("part_time_flag", BooleanType()),
    ),
    "dim_diagnosis": _struct(("diagnosis_id", StringType()), ("diagnosis_name", StringType())),
    "fact_patient_visits": _struct(
        ("visit_id", LongType()),
        ("patient_id", LongType()),
        ("hospital_id", StringType()),
        ("department_id", StringType()),
        ("doctor_id", LongType()),
        ("diagnosis_category", StringType()),
        ("arrival_datetime", TimestampNTZType()),
        ("triage_datetime", TimestampNTZType()),
        ("treatment_start_datetime", TimestampNTZType()),
        ("discharge_datetime", TimestampNTZType()),
        ("month", IntegerType()),
        ("severity_level", IntegerType()),
        ("admission_type", StringType()),
        ("outcome", StringType()),
        ("wait_time_minutes", DoubleType()),
        ("satisfaction_score", DoubleType()),
        ("icu_required_flag", BooleanType()),
        ("mortality_flag", BooleanType()),
        ("readmission_30_days_flag", BooleanType()),
        ("complaint_flag", BooleanType()),
        ("ambulance_arrival_flag", BooleanType()),
    ),
    "fact_staffing": _struct(
        ("shift_id", LongType()),
        ("hospital_id", StringType()),
        ("department_id", StringType()),
        ("shift_date", DateType()),
        ("month", IntegerType()),
        ("staff_absence_count", IntegerType()),
        ("overtime_hours", DoubleType()),
        ("burnout_risk_index", DoubleType()),
    ),
    "fact_financials": _struct(
        ("financial_record_id", StringType()),
        ("hospital_id", StringType()),
        ("year", IntegerType()),
        ("month", IntegerType()),
        ("revenue", MONEY),
        ("staffing_cost", MONEY),
        ("operational_cost", MONEY),
        ("icu_cost", MONEY),
        ("visit_count", LongType()),
        ("profit_margin", DoubleType()),
        ("readmission_rate", DoubleType()),
        ("avg_burnout_index", DoubleType()),
        ("expansion_projects_flag", BooleanType()),
    ),
    "data_dictionary": _struct(
        ("table_name", StringType()),
        ("column_name", StringType()),
        ("data_type", StringType()),
        ("description", StringType()),
        ("uk_context", StringType()),
        ("notes", StringType()),
    ),
}

# Load order: dimensions before the facts that reference them (A10).
LOAD_ORDER = [
    "dim_region",
    "dim_hospital",
    "dim_department",
    "dim_date",
    "dim_patient",
    "dim_doctor",
    "dim_diagnosis",
    "fact_patient_visits",
    "fact_staffing",
    "fact_financials",
    "data_dictionary",
]

# Primary keys (A11) and extra unique columns.
PRIMARY_KEYS = {
    "dim_region": "region_id",
    "dim_hospital": "hospital_id",
    "dim_department": "department_id",
    "dim_date": "date_key",
    "dim_patient": "patient_id",
    "dim_doctor": "doctor_id",
    "dim_diagnosis": "diagnosis_id",
    "fact_patient_visits": "visit_id",
    "fact_staffing": "shift_id",
    "fact_financials": "financial_record_id",
}
UNIQUE_KEYS = {"dim_date": ["full_date"]}

# References (A13): (table, column, referenced table, referenced column).
FOREIGN_KEYS = [
    ("dim_hospital", "region_id", "dim_region", "region_id"),
    ("dim_doctor", "primary_hospital_id", "dim_hospital", "hospital_id"),
    ("fact_patient_visits", "patient_id", "dim_patient", "patient_id"),
    ("fact_patient_visits", "hospital_id", "dim_hospital", "hospital_id"),
    ("fact_patient_visits", "department_id", "dim_department", "department_id"),
    ("fact_patient_visits", "doctor_id", "dim_doctor", "doctor_id"),
    ("fact_patient_visits", "diagnosis_category", "dim_diagnosis", "diagnosis_id"),
    ("fact_staffing", "hospital_id", "dim_hospital", "hospital_id"),
    ("fact_staffing", "department_id", "dim_department", "department_id"),
    ("fact_staffing", "shift_date", "dim_date", "full_date"),
    ("fact_financials", "hospital_id", "dim_hospital", "hospital_id"),
]

# Physical layout of the published facts (A14): the columns the reports
# filter and join on, so Parquet min/max statistics can skip row groups.
LAYOUT = {
    "fact_patient_visits": ("hospital_id", "arrival_datetime"),
    "fact_staffing": ("hospital_id", "shift_date"),
    "fact_financials": ("hospital_id", "month"),
}

# Rows that a dimension is expected to stay under; ``audit.dimension_bounds`` reports it.
ROW_BOUND = {
    "dim_region": 10_000,
    "dim_hospital": 100_000,
    "dim_department": 10_000,
    "dim_date": 100_000,
}
