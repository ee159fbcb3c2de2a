"""Every registered query against its SQL twin, on the smallest supplied tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from assaykit.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) == set(entry.oracle_sql()) & set(QUERIES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row.total_rows, row.duplicate_rows, row.health_score, row.health_label) == (6061, 61, 75.42, "Warning")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []
