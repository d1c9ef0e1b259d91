"""The registered queries of this subpackage against their SQL twins on the smallest tables; every query runs."""

from __future__ import annotations

import os

import harness
import pytest

from notelake.llm import queries, sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_twin(spark, name):
    assert harness.compare(queries.QUERIES[name](spark, DATA), harness.duck(DATA), sql.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
