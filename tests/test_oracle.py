"""Every registered query equals its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402
from parley.plans import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLE[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_twin(spark, name):
    """Stemmers and the location rules are held against golden cases in test_annotation.py; here they only run."""
    assert QUERIES[name](spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
