"""Incremental (Structured Streaming) runs of the visit reports.

The dashboard recomputes its figures on every request.  When visits arrive
as files in a shared folder, the same aggregates can be kept up to date
incrementally instead: the visit stream is reduced to in-scope hospitals
with a stream-static semi join on the hospital dimension and aggregated in
``complete`` mode.  State is one row per group (hospitals, hours), so it
stays small however long the stream runs, and no row is dropped for being
late (no watermark: the figures equal the batch reports over the same files).

Checkpoints go to the shared folder named by ``spark.checkpoint.dir`` so a
restarted driver or lost executor resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardflow.functions.numeric import mean, rate_pct
from wardflow.operators.scope import Scope, hospital_scope, in_scope
from wardflow.plans import finance
from wardflow.schemas import SCHEMAS
from wardflow.session import ensure_checkpoint_dir
from wardflow.sources.star import FrameStar


def visit_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Visit rows from Parquet files landing under ``path`` (declared schema)."""
    reader = spark.readStream.schema(SCHEMAS["fact_patient_visits"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def financial_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Monthly financial rows from Parquet files landing under ``path``."""
    reader = spark.readStream.schema(SCHEMAS["fact_financials"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def live_alerts(financials: DataFrame, hospitals: DataFrame, scope: Scope | None = None) -> DataFrame:
    """The CFO alerts (R17) kept current as financial rows arrive.

    The batch report itself runs on the stream: its per-hospital averages
    are a streaming aggregate (state: one row per hospital) and the alert
    rules are a projection of it.
    """
    star = FrameStar(financials.sparkSession, {"fact_financials": financials, "dim_hospital": hospitals})
    return finance.cfo_alerts(star, scope)


def live_hospital_metrics(visits: DataFrame, hospitals: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Running per-hospital visit metrics (the visit half of R6)."""
    v = in_scope(visits, hospital_scope(hospitals, scope))
    return v.groupBy("hospital_id").agg(
        F.count("visit_id").cast("bigint").alias("total_visits"),
        rate_pct("readmission_30_days_flag").alias("readmission_rate"),
        mean("wait_time_minutes", 1).alias("avg_wait_time"),
        mean("satisfaction_score", 1).alias("avg_satisfaction"))


def live_hourly_arrivals(visits: DataFrame, hospitals: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Running visits per arrival hour."""
    v = in_scope(visits, hospital_scope(hospitals, scope))
    return (v.groupBy(F.hour("arrival_datetime").cast("bigint").alias("hour"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("count")))


def start(df: DataFrame, name: str, sink: str = "memory", path: str | None = None,
          available_now: bool = True) -> StreamingQuery:
    """Start a complete-mode query with its checkpoint in the shared folder.

    ``sink="memory"`` exposes the result as table ``name`` (tests, notebooks);
    ``sink="parquet"`` rewrites the current result to ``path`` each batch.
    """
    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    writer = (df.writeStream.queryName(name).outputMode("complete")
              .option("checkpointLocation", f"{root}/streams/{name}"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    if sink == "memory":
        return writer.format("memory").start()
    if sink == "parquet":
        if not path:
            raise ValueError("a parquet sink needs a path")

        def overwrite(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        return writer.foreachBatch(overwrite).start()
    raise ValueError(f"unknown sink {sink!r}")
