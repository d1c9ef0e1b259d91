"""Each core query against its SQL twin on the smallest tables; every query runs."""

from __future__ import annotations

import os

import harness
import pytest

from notelake.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return harness.duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, con, name):
    assert harness.compare(catalog.queries()[name](spark, DATA), con, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    data = DATA.replace("0.001", "0.01") if name == "knn_indexed" else DATA  # the smallest tables have no concept to ask for
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
