"""The hospital star schema as lazily built DataFrames.

Two sources implement the same interface:

* ``DriverStar`` derives the star from the TPC-H-style driver tables (the
  mapping is specified in FIXTURES.md §2).  Each fact is built from only the
  driver tables its requested columns need, so a report that only needs
  ``hospital_id`` and ``month`` never joins ``part`` or ``orders``.
* ``PublishedStar`` reads the Parquet tables written by ``sources.etl``.

Reports ask for the columns they use (``star.visits("hospital_id", ...)``);
with Parquet that becomes the scan's ReadSchema.
"""

from __future__ import annotations

from decimal import Decimal
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wardflow.operators import states
from wardflow.operators.scope import half_year, in_scope
from wardflow.schemas import SCHEMAS
from wardflow.sources import commits

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the fixture mapping (FIXTURES.md §2), in natural order.
TRUST_TYPE_BY_NATION_MOD4 = {0: "Independent / Private", 1: "NHS Trust"}
TRUST_TYPE_OTHER = "NHS Foundation Trust"
ADMISSION_BY_LINESTATUS = {"O": "Emergency", "F": "Elective"}
OUTCOME_BY_RETURNFLAG = {"R": "Readmitted", "A": "Discharged", "N": "Transfer"}


def coded_id(prefix: str, key: Column) -> Column:
    """'H' and key + 1 in two digits or more: the hospital / region code of a key."""
    number = (key + F.lit(1)).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))


def _lookup(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(col == F.lit(key), F.lit(value)) if expr is None
                else expr.when(col == F.lit(key), F.lit(value)))
    return expr.otherwise(F.lit(default))


def _years(time: str) -> list[Column]:
    return [F.min(F.year(time)).alias("first"), F.max(F.year(time)).alias("last")]


def date_spine(*dates: DataFrame) -> DataFrame:
    """(full_date): every day of the years that the frames' one column of dates or times reaches.

    The bounds are aggregates and the days a ``sequence``, all inside the plan;
    without any date there is no day.
    """
    spans = reduce(DataFrame.unionAll, [df.agg(*_years(df.columns[0])) for df in dates])
    span = spans.agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first is not null")
    return span.select(F.explode(F.expr(
        "sequence(make_date(first, 1, 1), make_date(last, 12, 31), interval 1 day)")).alias("full_date"))


class Star:
    """Interface every star source implements."""

    spark: SparkSession

    def dim(self, name: str) -> DataFrame:
        raise NotImplementedError

    def visits(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def staffing(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def financials(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def table(self, name: str) -> DataFrame:
        if name == "fact_patient_visits":
            return self.visits()
        if name == "fact_staffing":
            return self.staffing()
        if name == "fact_financials":
            return self.financials()
        return self.dim(name)

    def columns(self, name: str, *cols: str) -> DataFrame:
        """Only ``cols`` of a table (a fact builds only the joins they need)."""
        if name == "fact_patient_visits":
            return self.visits(*cols)
        if name == "fact_staffing":
            return self.staffing(*cols)
        if name == "fact_financials":
            return self.financials(*cols)
        return self.dim(name).select(*cols)

    # Partial states of the row-level facts: by one aggregate over the rows.
    def visit_states(self, hospitals: DataFrame, *keys: str, period: str | None = None) -> DataFrame:
        """States of the visits of ``hospitals`` (and a half-year) by ``keys`` (``operators.states``)."""
        more = {"department_id": "department_id", "month_text": "arrival_datetime"}
        rows = self.visits(*states.VISIT_COLUMNS, *[c for k, c in more.items() if k in keys])
        return states.of_visits(half_year(in_scope(rows, hospitals), period), *keys)

    def shift_states(self, hospitals: DataFrame, *keys: str, period: str | None = None) -> DataFrame:
        """States of the shifts of ``hospitals`` (and a half-year) by ``keys``."""
        rows = self.staffing(*states.SHIFT_COLUMNS, *[k for k in keys if k == "department_id"])
        return states.of_shifts(half_year(in_scope(rows, hospitals), period), *keys)

    # Convenience accessors used by most reports.
    def hospitals(self) -> DataFrame:
        return self.dim("dim_hospital")

    def regions(self) -> DataFrame:
        return self.dim("dim_region")

    def calendar(self) -> DataFrame:
        return self.dim("dim_date")


def _all(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields]


class _Derived:
    """A fact whose columns are expressions over a set of joined sources."""

    def __init__(self, base: Callable[[], DataFrame],
                 joins: dict[str, Callable[[DataFrame], DataFrame]],
                 columns: dict[str, tuple[tuple[str, ...], Callable[[], Column]]]):
        self.base, self.joins, self.columns = base, joins, columns

    def build(self, table: str, cols: Iterable[str]) -> DataFrame:
        cols = list(cols) or _all(table)
        unknown = [c for c in cols if c not in self.columns]
        if unknown:
            raise ValueError(f"{table} has no column(s) {unknown}")
        needed = set()
        for c in cols:
            needed.update(self.columns[c][0])
        df = self.base()
        for name, join in self.joins.items():  # fixed join order
            if name in needed:
                df = join(df)
        schema = {f.name: f.dataType for f in SCHEMAS[table].fields}
        return df.select([self.columns[c][1]().cast(schema[c]).alias(c) for c in cols])


class DriverStar(Star):
    """The star derived from the driver tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """The driver table as a (lazy) relation, listed anew for each star."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    # ---------------------------------------------------------- dimensions
    def dim(self, name: str) -> DataFrame:
        builder = getattr(self, f"_{name}", None)
        if builder is None:
            raise KeyError(name)
        df = builder()
        schema = {f.name: f.dataType for f in SCHEMAS[name].fields}
        return df.select([F.col(c).cast(t).alias(c) for c, t in schema.items()])

    def _dim_region(self) -> DataFrame:
        r = self.read("region")
        return r.select(coded_id("R", F.col("r_regionkey")).alias("region_id"),
                        F.col("r_name").alias("region_name"))

    def _dim_hospital(self) -> DataFrame:
        n = self.read("nation")
        k = F.col("n_nationkey")
        return n.select(
            coded_id("H", k).alias("hospital_id"),
            F.col("n_name").alias("hospital_name"),
            coded_id("R", F.col("n_regionkey")).alias("region_id"),
            _lookup(k % 4, TRUST_TYPE_BY_NATION_MOD4, TRUST_TYPE_OTHER).alias("nhs_trust_type"),
            (k % 4 == 0).alias("private"),
            (k % 3 == 0).alias("teaching_hospital"),
            F.concat(F.lit("CITY_"), k.cast("string")).alias("city"),
            F.lit("MODERATE").alias("staffing_stress"),
            (F.lit(100) + F.lit(10) * k).alias("total_beds"),
            (F.lit(10) + k).alias("icu_beds"),
        )

    def _dim_department(self) -> DataFrame:
        # part is a large table at scale; the distinct is a partial
        # aggregate per task, so only a handful of rows are shuffled.
        p = self.read("part").select("p_type").distinct()
        return p.select(
            F.concat(F.lit("D_"), F.col("p_type")).alias("department_id"),
            F.col("p_type").alias("department_name"),
            (F.col("p_type") == F.lit("LARGE")).alias("icu_capable"),
        )

    def _dim_date(self) -> DataFrame:
        cal = date_spine(self.read("lineitem").select("l_shipdate"), self.read("orders").select("o_orderdate"))
        m = F.month("full_date")
        return cal.select(
            F.date_format("full_date", "yyyyMMdd").cast("int").alias("date_key"),
            "full_date",
            F.date_format("full_date", "EEEE").alias("day_of_week"),
            (F.weekday("full_date") + F.lit(1)).alias("day_number"),
            F.date_format("full_date", "MMMM").alias("month_name"),
            (F.weekday("full_date") >= 5).alias("is_weekend"),
            (F.date_format("full_date", "MM-dd").isin("01-01", "12-25", "12-26")).alias("is_holiday"),
            m.isin(11, 12, 1).alias("is_winter"),
            m.isin(10, 11, 12, 1, 2, 3).alias("is_flu_season"),
        )

    def _dim_patient(self) -> DataFrame:
        c = self.read("customer")
        return c.select(F.col("c_custkey").alias("patient_id"),
                        F.col("c_mktsegment").alias("patient_segment"))

    def _dim_doctor(self) -> DataFrame:
        s = self.read("supplier")
        return s.select(F.col("s_suppkey").alias("doctor_id"),
                        coded_id("H", F.col("s_nationkey")).alias("primary_hospital_id"),
                        (F.col("s_suppkey") % 5 == 0).alias("part_time_flag"))

    def _dim_diagnosis(self) -> DataFrame:
        p = self.read("part").select("p_brand").distinct()
        return p.select(F.col("p_brand").alias("diagnosis_id"),
                        F.col("p_brand").alias("diagnosis_name"))

    def _data_dictionary(self) -> DataFrame:
        rows = [(t, f.name, f.dataType.simpleString(), None, None, None)
                for t in SCHEMAS if t != "data_dictionary" for f in SCHEMAS[t].fields]
        return self.spark.createDataFrame(rows, SCHEMAS["data_dictionary"])

    def expected_rows(self) -> DataFrame:
        """(table_name, expected): what the mapping must give, counted in the driver tables alone."""
        rows = F.count(F.lit(1))
        nation_months = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            "c_nationkey", F.trunc("o_orderdate", "month").alias("first_day")).distinct()
        counts = {
            "dim_region": self.read("region").agg(rows), "dim_hospital": self.read("nation").agg(rows),
            "dim_department": self.read("part").agg(F.countDistinct("p_type")),
            "dim_date": self.read("lineitem").agg(*_years("l_shipdate")).unionAll(
                self.read("orders").agg(*_years("o_orderdate"))).agg(F.coalesce(F.datediff(
                    F.make_date(F.max("last") + 1, F.lit(1), F.lit(1)), F.make_date(F.min("first"), F.lit(1), F.lit(1))), F.lit(0))),
            "dim_patient": self.read("customer").agg(rows), "dim_doctor": self.read("supplier").agg(rows),
            "dim_diagnosis": self.read("part").agg(F.countDistinct("p_brand")),
            "fact_patient_visits": self.read("lineitem").agg(rows), "fact_staffing": self.read("orders").agg(rows),
            "fact_financials": nation_months.agg(rows),
        }
        return reduce(DataFrame.unionAll, [df.toDF("expected").select(F.lit(t).alias("table_name"), F.col("expected").cast("long"))
                                           for t, df in counts.items()])

    # --------------------------------------------------------------- facts
    def visits(self, *cols: str) -> DataFrame:
        return self._visits.build("fact_patient_visits", cols)

    def staffing(self, *cols: str) -> DataFrame:
        return self._staffing.build("fact_staffing", cols)

    def financials(self, *cols: str) -> DataFrame:
        return self._financials.build("fact_financials", cols)

    @property
    def _visits(self) -> _Derived:
        def base() -> DataFrame:
            return self.read("lineitem")

        # Derived keys are computed on the lookup side of each join, once
        # per supplier / part / order, not once per line item.
        def with_supplier(df: DataFrame) -> DataFrame:
            s = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                             coded_id("H", F.col("s_nationkey")).alias("s_hospital_id"))
            return df.join(s, "l_suppkey")

        def with_part(df: DataFrame) -> DataFrame:
            p = self.read("part").select(F.col("p_partkey").alias("l_partkey"),
                                         F.concat(F.lit("D_"), F.col("p_type")).alias("p_department_id"),
                                         "p_brand")
            return df.join(p, "l_partkey")

        def with_orders(df: DataFrame) -> DataFrame:
            o = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                           F.substring("o_orderpriority", 1, 1).cast("int").alias("o_severity"))
            return df.join(o, "l_orderkey")

        col = F.col
        hours = ((col("l_orderkey") * 7 + col("l_linenumber")) % 24).cast("int")
        arrival = col("l_shipdate").cast("timestamp_ntz") + F.make_interval(hours=hours)
        wait = col("l_quantity") * 2
        arrival_plus = lambda minutes: arrival + F.make_interval(
            mins=minutes.cast("int"))
        columns = {
            "visit_id": ((), lambda: col("l_orderkey") * 10 + col("l_linenumber")),
            "patient_id": (("o",), lambda: col("o_custkey")),
            "hospital_id": (("s",), lambda: col("s_hospital_id")),
            "department_id": (("p",), lambda: col("p_department_id")),
            "doctor_id": ((), lambda: col("l_suppkey")),
            "diagnosis_category": (("p",), lambda: col("p_brand")),
            "arrival_datetime": ((), lambda: arrival),
            "triage_datetime": ((), lambda: arrival_plus(F.lit(5))),
            "treatment_start_datetime": ((), lambda: arrival_plus(wait)),
            "discharge_datetime": ((), lambda: arrival_plus(wait + F.lit(60) * col("l_linenumber"))),
            "month": ((), lambda: F.month("l_shipdate")),
            "severity_level": (("o",), lambda: col("o_severity")),
            "admission_type": ((), lambda: _lookup(col("l_linestatus"), ADMISSION_BY_LINESTATUS)),
            "outcome": ((), lambda: _lookup(col("l_returnflag"), OUTCOME_BY_RETURNFLAG)),
            "wait_time_minutes": ((), lambda: wait),
            "satisfaction_score": ((), lambda: F.lit(100) - col("l_quantity")),
            "icu_required_flag": ((), lambda: col("l_linenumber") == 7),
            "mortality_flag": ((), lambda: F.lit(False)),
            "readmission_30_days_flag": ((), lambda: (col("l_returnflag") == "R") & (col("l_linestatus") == "O")),
            "complaint_flag": ((), lambda: col("l_discount") >= 0.09),
            "ambulance_arrival_flag": ((), lambda: col("l_linenumber") == 1),
        }
        return _Derived(base, {"s": with_supplier, "p": with_part, "o": with_orders}, columns)

    @property
    def _staffing(self) -> _Derived:
        def base() -> DataFrame:
            return self.read("orders")

        def with_customer(df: DataFrame) -> DataFrame:
            c = self.read("customer").select(F.col("c_custkey").alias("o_custkey"),
                                             coded_id("H", F.col("c_nationkey")).alias("c_hospital_id"))
            return df.join(c, "o_custkey")

        col = F.col
        columns = {
            "shift_id": ((), lambda: col("o_orderkey")),
            "hospital_id": (("c",), lambda: col("c_hospital_id")),
            "department_id": ((), lambda: F.lit(None).cast("string")),
            "shift_date": ((), lambda: F.to_date("o_orderdate")),
            "month": ((), lambda: F.month("o_orderdate")),
            "staff_absence_count": ((), lambda: col("o_custkey") % 6),
            "overtime_hours": ((), lambda: (col("o_orderkey") % 121) / F.lit(10.0)),
            "burnout_risk_index": ((), lambda: (F.lit(500) + col("o_orderkey") % 200) / F.lit(1000.0)),
        }
        return _Derived(base, {"c": with_customer}, columns)

    @property
    def _financials(self) -> _Derived:
        def base() -> DataFrame:
            # hospital x calendar month: an aggregate of orders, small at
            # any scale (hospitals x months), built with a partial aggregate.
            o = self.read("orders").select("o_custkey", "o_orderdate", "o_totalprice")
            c = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
            return (o.join(c, "o_custkey")
                    .groupBy("c_nationkey",
                             F.year("o_orderdate").alias("f_year"),
                             F.month("o_orderdate").alias("f_month"))
                    .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("f_revenue"),
                         F.count(F.lit(1)).alias("f_count")))

        col = F.col
        money = lambda share: (col("f_revenue") * F.lit(Decimal(share))).cast("decimal(18,2)")
        hosp = lambda: coded_id("H", col("c_nationkey"))
        columns = {
            "financial_record_id": ((), lambda: F.concat_ws(
                "-", hosp(), col("f_year").cast("string"), F.lpad(col("f_month").cast("string"), 2, "0"))),
            "hospital_id": ((), hosp),
            "year": ((), lambda: col("f_year")),
            "month": ((), lambda: col("f_month")),
            "revenue": ((), lambda: col("f_revenue").cast("decimal(18,2)")),
            "staffing_cost": ((), lambda: money("0.04")),
            "operational_cost": ((), lambda: money("0.68")),
            "icu_cost": ((), lambda: money("0.05")),
            "visit_count": ((), lambda: col("f_count")),
            "profit_margin": ((), lambda: ((col("c_nationkey") * 7 + col("f_month")) % 30) / F.lit(100.0)),
            "readmission_rate": ((), lambda: (F.lit(14) + col("c_nationkey") % 6) / F.lit(100.0)),
            "avg_burnout_index": ((), lambda: (F.lit(580) + (col("c_nationkey") % 8) * 10) / F.lit(1000.0)),
            "expansion_projects_flag": ((), lambda: col("c_nationkey") % 5 == 0),
        }
        return _Derived(base, {}, columns)


class PublishedStar(Star):
    """The star that ``sources.etl.load`` last published under ``target``.

    The version is looked up once, so one star never mixes two loads; its
    stored rollup, if any, answers what it can.  A
    folder without published versions is read as a version itself.  Tables
    have the columns and types they were written with; declared columns that
    the source lacks are null.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        last = commits.current(spark, self.target)
        self.root = f"{self.target}/_versions/{last.version}" if last else self.target
        folder = commits.Folder(spark, self.root)
        self.has_rollup = folder.exists("rollup_visits/_SUCCESS") and folder.exists("rollup_shifts/_SUCCESS")

    def _read(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        declared = {f.name: f.dataType for f in SCHEMAS[name].fields}
        missing = [c for c in declared if c not in df.columns]
        if missing:
            df = df.withColumns({c: F.lit(None).cast(declared[c]) for c in missing})
        cols = list(cols)
        return df.select(*cols) if cols else df

    def dim(self, name: str) -> DataFrame:
        return self._read(name)

    def visits(self, *cols: str) -> DataFrame:
        return self._read("fact_patient_visits", cols)

    def staffing(self, *cols: str) -> DataFrame:
        return self._read("fact_staffing", cols)

    def financials(self, *cols: str) -> DataFrame:
        return self._read("fact_financials", cols)

    def _rollup(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as exc:  # the rollup of a fact without rows has no files
            if "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def visit_states(self, hospitals: DataFrame, *keys: str, period: str | None = None) -> DataFrame:
        """From the version's rollup, where it has one: no fact is read."""
        if not self.has_rollup:
            return super().visit_states(hospitals, *keys, period=period)
        stored = self._rollup("rollup_visits", states.VISIT_SCHEMA)
        return states.merged(half_year(in_scope(stored, hospitals), period), *keys)

    def shift_states(self, hospitals: DataFrame, *keys: str, period: str | None = None) -> DataFrame:
        if not self.has_rollup:
            return super().shift_states(hospitals, *keys, period=period)
        stored = self._rollup("rollup_shifts", states.SHIFT_SCHEMA)
        return states.merged(half_year(in_scope(stored, hospitals), period), *keys)


class FrameStar(Star):
    """A star over given DataFrames (hand-made fixtures, other sources).

    Missing star columns are added as typed nulls, so a fixture only needs
    the columns a test is about.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def _get(self, name: str, cols: Iterable[str] = ()) -> DataFrame:
        schema = {f.name: f.dataType for f in SCHEMAS[name].fields}
        df = self.tables.get(name)
        if df is None:
            df = self.spark.createDataFrame([], SCHEMAS[name])
        wanted = list(cols) or list(schema)
        present = set(df.columns)
        return df.select([(F.col(c) if c in present else F.lit(None)).cast(schema[c]).alias(c)
                          for c in wanted])

    def dim(self, name: str) -> DataFrame:
        return self._get(name)

    def visits(self, *cols: str) -> DataFrame:
        return self._get("fact_patient_visits", cols)

    def staffing(self, *cols: str) -> DataFrame:
        return self._get("fact_staffing", cols)

    def financials(self, *cols: str) -> DataFrame:
        return self._get("fact_financials", cols)
