"""Streaming runs give the batch figures over the same files."""

from __future__ import annotations

import tempfile

from support import rows
from wardflow.operators.scope import Scope
from wardflow.plans import outliers, overview
from wardflow.sources.star import DriverStar
from wardflow.streaming import live


def test_streaming_matches_batch(spark, sf0001):
    star = DriverStar(spark, sf0001)
    landing = tempfile.mkdtemp(prefix="wardflow-landing-")
    # land the visits as several files, as an upstream writer would
    star.visits().repartition(4).write.mode("overwrite").parquet(landing)
    stream = live.visit_stream(spark, landing, max_files_per_trigger=1)
    hospitals = star.hospitals()

    q1 = live.start(live.live_hospital_metrics(stream, hospitals), "live_hospital_metrics")
    q2 = live.start(live.live_hourly_arrivals(stream, hospitals, Scope(region="R01")), "live_hourly")
    q1.awaitTermination(300)
    q2.awaitTermination(300)

    got = rows(spark.table("live_hospital_metrics"))
    want = rows(outliers.visit_metrics(star, hospitals))
    assert got == want
    got_h = rows(spark.table("live_hourly"))
    want_h = rows(overview.hourly_arrivals(star, Scope(region="R01")))
    assert got_h == want_h


def test_live_alerts_match_batch(spark, sf0001):
    from wardflow.plans import finance

    star = DriverStar(spark, sf0001)
    landing = tempfile.mkdtemp(prefix="wardflow-landing-")
    star.financials().repartition(3).write.mode("overwrite").parquet(landing)
    stream = live.financial_stream(spark, landing, max_files_per_trigger=1)
    q = live.start(live.live_alerts(stream, star.hospitals()), "live_cfo_alerts")
    q.awaitTermination(300)
    assert rows(spark.table("live_cfo_alerts")) == rows(finance.cfo_alerts(star))
