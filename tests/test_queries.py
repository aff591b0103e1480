"""Every registered query with SQL agrees with it; the others give rows of a stable schema."""

from pathlib import Path

import pytest

from corvane.plans.registry import ORACLES, QUERIES
from tests.oracle import compare

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], str(DATA))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    """Tested against brute force elsewhere; over the test tables, rows of a stable schema and every row twice the same."""
    found = QUERIES[name](spark, str(DATA))
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert rows and len(set(rows)) == len(rows) and rows == sorted(map(tuple, QUERIES[name](spark, str(DATA)).collect()), key=repr)


@pytest.mark.parametrize("name", ["group_leakage", "input_overlap", "prompt_leakage", "unknown_references", "duplicate_inputs", "replay_changes", "manifest_check"])
def test_violations_are_there_to_be_found(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
