"""Steps that must not gather a key's rows, or run code per row or per group where the data is large."""

import datetime as dt
import types

import numpy as np
import pandas as pd

from tablescope.operators import events as evt
from tablescope.operators import feedback as fb
from tablescope.operators import results as rs
from tablescope.sources import properties
from tablescope.streaming import streams as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_merged_before_the_join(spark):
    votes = spark.createDataFrame([(1, "down"), (2, "down"), (3, "up"), (-1, "down")], "message_id long, vote string")
    links = spark.range(5000).selectExpr("CASE WHEN id % 50 = 2 THEN id ELSE -1 END AS message_id")
    out = fb.unlinked_downvotes(votes, links)
    assert [tuple(r) for r in out.collect()] == [(1, "down")]
    assert "HashAggregate(keys=[message_id" in plan(out)


def test_property_names_are_merged_without_a_sort(spark):
    rows = [(2, '{"A":{"type":"number"},"T":{"type":"title"}}'), (1, '{"B":{"type":"url"},"A":{"type":"number"}}'), (None, '{"C":{}}'), (3, None), (4, "no")]
    found = properties.collect_columns(spark.createDataFrame(rows, "id long, j string"), "j", "id")
    assert {r["name"]: r["position"] for r in found.collect()} == {"T": 0, "C": 1, "B": 2, "A": 3}
    deepest = [line for line in plan(found).splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in deepest


def test_page_ranges_compare_with_two_borders(spark):
    df = spark.range(60_000).selectExpr("CASE WHEN id % 100 < 3 THEN null WHEN id % 100 < 90 THEN 1 ELSE 2 END AS k", "id")
    for order, k in (([("k", True), ("id", True)], 30_000), ([("k", False), ("id", True)], 6_100), ([("k", False), ("id", False)], 59_000)):
        rows, skip = rs.page_range(df, order, k, 20, small=500)
        assert "lambda" not in plan(rows) and rows.count() <= 4000
        want = df.orderBy(*[getattr(df[c], "asc" if up else "desc")() for c, up in order]).offset(k).limit(20)
        assert [tuple(r)[:2] for r in rs.deep_page(df, order, k, 20, small=500).collect()] == [tuple(r) for r in want.collect()]


def test_islands_are_not_groups_of_python(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=s), 1000 * k + s) for k in range(3) for s in range(0, 40_000, 50 + 13 * k) if s // 700 % 3]
    df = spark.createDataFrame(rows, "k long, ts timestamp, id long")
    out = evt.throttle(df, ["k"], "ts", "id", 120)
    assert "FlatMapGroups" not in plan(out)
    want, last = set(), {}
    for k, ts, i in rows:
        if k not in last or ts - last[k] > dt.timedelta(seconds=120):
            last[k] = ts
            want.add(i)
    assert {r["id"] for r in out.collect()} == want


class Cell(list):
    get = lambda self: iter(list(self))
    appendList = list.extend

    def put(self, rows):
        self[:] = rows


def test_streamed_throttle_keeps_blocks(monkeypatch):
    """A thousand events that wait are one entry of state; ids are whole, missing ones stay so."""
    value = types.SimpleNamespace(get=lambda: None, update=lambda v: None, clear=lambda: None)
    waiting, timers = Cell(), []
    handle = types.SimpleNamespace(getValueState=lambda *a: value, getListState=lambda *a: waiting, registerTimer=timers.append)
    throttle = st._Throttle(1_800_000_000)
    throttle.init(handle)
    big = 2**60
    rows = pd.DataFrame({"at": np.arange(1000) * 1_000_000_000, "unnamed": np.arange(1000) == 2, "event_id": big + np.arange(1000)})
    list(throttle.handleInputRows(("k",), iter([rows.sample(frac=1, random_state=1)]), None))
    assert len(waiting) == 1 and timers == [0]
    passed = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 9_500_000)
    out = [i for part in throttle.handleExpiredTimer(("k",), passed, None) for i in part["event_id"]]
    assert out[0] == big and out[1] is pd.NA and out[2:] == [big + 4, big + 6, big + 8] and len(waiting) == 1
