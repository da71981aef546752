from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from wardflow.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app_name="wardflow-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="session")
def sf0001():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def published_sf0001(spark, sf0001):
    """The sf0.001 star published once by the load job: (derived, published)."""
    import tempfile

    from wardflow.sources import etl
    from wardflow.sources.star import DriverStar, PublishedStar

    src = DriverStar(spark, sf0001)
    target = tempfile.mkdtemp(prefix="wardflow-published-") + "/star"
    res = etl.load(spark, etl.star_tables(src), target, allow_violations={"keys:fact_patient_visits:visit_id"})
    return src, PublishedStar(spark, res.published_to)
