"""Pages far down a table."""

import datetime as dt
import random

import pytest

from tablescope.operators import results as rs

SCHEMA = "a double, s string, d date, i long"


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(12)
    rows = [
        (rnd.choice([None, 1.5, rnd.random(), rnd.gauss(0, 1e6)]), rnd.choice([None, "", "naïve", "same prefix", "same prefix " + str(rnd.randrange(40)), "z"]),
         dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(5)), i)
        for i in range(4000)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def ordered(rows, order):
    for column, ascending in reversed(order):
        k = "asdi".index(column)
        rows = sorted(rows, key=lambda r: (r[k] is not None, r[k].encode() if isinstance(r[k], str) else r[k] or 0 if r[k] is None else r[k]), reverse=not ascending)
    return rows


@pytest.mark.parametrize("order", [[("a", True), ("i", True)], [("a", False), ("i", True)], [("s", True), ("d", False), ("i", False)], [("d", False), ("i", True)]])
@pytest.mark.parametrize("offset", [0, 1234, 3990, 5000])
def test_pages_equal_a_full_sort(table, order, offset):
    rows, df = table
    got = rs.deep_page(df, order, offset, 15, ranges=8, small=60).collect()
    assert [tuple(r)[:4] for r in got] == ordered(rows, order)[offset : offset + 15]
    assert all(r["total"] == 4000 for r in got)


def test_a_deep_page_sorts_one_range(spark):
    df = spark.range(200_000).selectExpr("id % 4 AS k", "reverse(cast(id AS string)) AS s", "id")
    rows, skip = rs.page_range(df, [("k", True), ("s", True), ("id", True)], 150_000, 20, small=2000)
    assert rows.count() < 5000 and skip < 5000


def test_pages_of_an_empty_table(spark):
    assert rs.deep_page(spark.createDataFrame([], SCHEMA), [("a", True)], 10, 5).collect() == []
