"""Every registered query against its SQL oracle on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry
import tools_check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not mounted")


@pytest.fixture(scope="module")
def duck():
    return tools_check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    state, rows, _, note = tools_check.compare(spark, duck, name, SF_DIR)
    assert state in ("ok", "EMPTY", "rows-only"), note
    if state == "rows-only":
        assert rows > 0


def test_entry_is_a_frame(spark):
    assert entry.entry(spark).columns[0] == "column"


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("str_")))
def test_no_pairwise_joins(spark, name):
    """No plan holds a cross or nested-loop join."""
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
