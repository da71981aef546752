"""Untidy source sheets derived from the driver tables.

A workbook's cells are text under headers of any spelling, some empty or
wrong.  These sheets hold every row of their driver table in that form, so the
conforming step of the load (A3-A9) runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.sources.star import DriverStar


def visit_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a visits sheet: flags in several spellings, a wrong date in
    each sixth line, an empty wait in each fifth, ids and an extra column as text."""
    n = F.col("l_linenumber")
    flag = (F.when(n == 1, "").when(n == 2, "No").when(n == 4, " YES ").when(n == 5, "0").when(n == 6, "t")
            .when(n == 7, "maybe"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + n).cast("string").alias(" Visit-ID"),
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("Doctor ID"),
        F.col("l_returnflag").alias("Hospital Name"),
        F.when(n == 6, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("Arrival.DateTime"),
        F.concat(F.month("l_shipdate").cast("string"), F.lit(".0")).alias("Month "),
        F.when(n == 5, " ").otherwise((F.col("l_quantity") * 2).cast("string")).alias("Wait Time / Minutes"),
        flag.alias("ICU Required Flag"),
        (F.col("l_discount") >= 0.09).cast("int").alias("Complaint--Flag"),
        F.lit(None).cast("boolean").alias("mortality_flag"),
        F.col("l_returnflag").alias("Ward - Notes"))


def vocabulary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a vocabulary sheet: each tenth row repeats the header, the next lacks a name."""
    k, size = F.col("p_partkey") % 10, F.col("p_size") % 3
    table = (F.when(size == 0, F.concat(F.lit(" Fact "), "p_type")).when(size == 1, F.concat("p_type", F.lit("-")))
             .otherwise(F.concat("p_type", F.lit(" . Dim"))))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.when(k == 0, "Table").otherwise(table).alias("Data Vocabulary"),
        F.when(k != 1, F.concat(F.lit("/"), "p_name")).alias("_c1"),
        F.col("p_brand").alias("_c2"), F.col("p_size").alias("_c3"),
        F.lit(None).cast("string").alias("_c4"), F.col("p_type").alias("_c5"))


def shift_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a shifts sheet: dates as text that must parse, whole numbers written as ``3.0``."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("Shift ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Shift Date"),
        F.concat(F.month("o_orderdate").cast("string"), F.lit(".0")).alias("Month"),
        F.concat((F.col("o_custkey") % 6).cast("string"), F.lit(".0")).alias("Staff-Absence-Count"),
        F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 121 / F.lit(10.0)).cast("string")).otherwise("").alias("Overtime.Hours"),
        F.lit("x").alias("Hospital Name"))


# Names under which ``NamedStar`` lists the driver tables' part types and, by key modulo 7, nations.
DEPARTMENT_NAMES = {
    "ECONOMY": "Emergency Department", "LARGE": "Intensive Care Unit", "MEDIUM": "Cardiology", "PROMO": "Ward_7 Annex",
    "SMALL": "General Medicine", "STANDARD": "Physiotherapy",
}
HOSPITAL_NAMES = [
    ("", " University Hospital NHS Foundation Trust"), ("", " Royal Infirmary"), ("Nuffield Health ", " Hospital"),
    ("Leeds General ", " Hospitals NHS Trust"), ("Harrogate District ", " hospital"), ("Alder Hey Children's ", " NHS FT"),
    ("University College London ", " Hospital Infirmary"),
]
MARGIN_SHIFT = 0.16


class NamedStar(DriverStar):
    """The driver star under names that the display rules know, and with losses.

    Part types are departments, nations carry hospital names, and margins lie
    lower, so that name rules, the business order, department families and the
    deficit list have something to do.
    """

    def _dim_department(self) -> DataFrame:
        names = F.create_map(*[F.lit(x) for pair in DEPARTMENT_NAMES.items() for x in pair])
        return super()._dim_department().withColumn("department_name", F.coalesce(
            F.try_element_at(names, F.col("department_name")), F.col("department_name")))

    def _dim_hospital(self) -> DataFrame:
        nth = F.substring("hospital_id", 2, 20).cast("int") - 1
        before, after = (F.array(*[F.lit(x[i]) for x in HOSPITAL_NAMES]) for i in (0, 1))
        return super()._dim_hospital().withColumn("hospital_name", F.concat(
            F.get(before, nth % len(HOSPITAL_NAMES)), F.col("hospital_name"), F.get(after, nth % len(HOSPITAL_NAMES))))

    def financials(self, *cols: str) -> DataFrame:
        rows = super().financials(*cols)
        return rows.withColumn("profit_margin", F.col("profit_margin") - F.lit(MARGIN_SHIFT)) if "profit_margin" in rows.columns else rows
