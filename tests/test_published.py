"""Every registered query gives the same rows over the published star as over
the star derived from the driver tables (the production path)."""

from __future__ import annotations

import pytest

from support import rows
from wardflow import catalog

QUERIES = catalog.star_queries()


@pytest.fixture(scope="module")
def stars(published_sf0001):
    return published_sf0001


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_published_equals_derived(stars, name):
    src, pub = stars
    report = QUERIES[name].on
    assert rows(report(pub)) == rows(report(src))
