import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablescope.functions import dates
from tablescope.functions.text import natural_key, title_label
from tablescope.operators import activity as act
from tablescope.operators import assets as ast
from tablescope.sources import shared
from tablescope.operators import chats as cr
from tablescope.operators import feedback as fb
from tablescope.operators import usage as us
from tablescope.operators import views as vw

NOW = dt.datetime(2024, 5, 31, 15, 20)


@pytest.mark.parametrize("unit, value, want", [
    ("hour", 24, "hour"), ("hour", 25, "day"), ("hour", 24 * 40, "month"), ("day", 30, "day"), ("day", 31, "month"), ("month", 48, "month")])
def test_granularity(unit, value, want):
    assert dates.chart_granularity(unit, value, NOW) == want


def test_bucket_counts():
    assert dates.bucket_count("hour", 30, "day", NOW) == 2
    assert dates.bucket_count("hour", 48, "day", NOW) == 3
    assert dates.bucket_count("day", 31, "month", NOW) == 1
    assert dates.bucket_count("day", 32, "month", NOW) == 2
    assert dates.bucket_count("month", 14, "month", NOW) == 14
    assert dates.bucket_count("month", 2, "day", NOW) == 61
    with pytest.raises(ValueError):
        dates.check_bucket_count("day", 100, "hour", NOW)
    assert dates.check_bucket_count("day", 100, "hour", NOW, most=5000) > 2000


def test_too_many_buckets_are_an_error(spark):
    usage = spark.createDataFrame([("2024-01-01", 3)], "date string, n long")
    now = F.to_timestamp(F.lit("2024-01-31 12:00:00"))
    assert us.fill_buckets(usage, now, "day", 31, "day", most=31).count() == 31
    with pytest.raises(Exception, match="31 day buckets asked for, at most 30 are allowed"):
        us.fill_buckets(usage, now, "day", 31, "day", most=30).collect()


def test_views_of_two_projects_side_by_side(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, x string")
    one, two = (vw.scoped_sql(spark, "SELECT x FROM {v_rows}", {"v_rows": vw.project_view(rows, p, ["x"])}) for p in (1, 2))
    assert [r.x for r in one.collect()] == ["a"] and [r.x for r in two.collect()] == ["b"]
    assert not spark.catalog.tableExists("v_rows")


def reconcile(spark, existing=(), recorded=(), resolved=(), dismissed=()):
    made = fb.reconcile(
        spark.createDataFrame(list(existing), "fingerprint string, rec_id long, status string"),
        spark.createDataFrame(list(recorded), "fingerprint string, seq long, impact_score long"),
        spark.createDataFrame([(f,) for f in resolved], "fingerprint string"),
        spark.createDataFrame([(f,) for f in dismissed], "fingerprint string"))
    return sorted(((r["action"], r["fingerprint"], r["impact_score"], r["reopen"]) for r in made.collect()), key=str)


def test_reconcile(spark):
    assert reconcile(spark, recorded=[("a", 1, 5), ("b", 1, 4)]) == [("insert", "a", 5, None)]
    assert reconcile(spark, recorded=[("a", 1, 50), ("a", 2, 6)]) == [("insert", "a", 6, None)]
    assert reconcile(spark, [("a", 1, "open")], [("a", 1, 0)]) == [("update", "a", 0, False)]
    assert reconcile(spark, [("a", 1, "applied")], [("a", 1, 9)]) == [("update", "a", 9, True)]
    assert reconcile(spark, [("a", 1, "dismissed")], [("a", 1, 9)], dismissed=["a"]) == []
    assert reconcile(spark, [("a", 1, "open")], resolved=["a"]) == [("resolve", "a", None, None)]
    assert reconcile(spark, [("a", 1, "applied")], resolved=["a"]) == []
    assert reconcile(spark, [("a", 1, "open")], [("a", 1, 9)], resolved=["a"]) == [("update", "a", 9, False)]
    assert reconcile(spark, [("a", 1, "open")]) == []


def test_folders_survive_cycles(spark):
    rows = [(1, None, "public"), (2, 1, "private"), (3, 2, "public"), (4, 3, "public"), (5, 6, "public"), (6, 5, "public"), (7, 99, "public")]
    df = spark.createDataFrame(rows, "id long, parent long, visibility string")
    one = (lambda k: spark.createDataFrame([(k,)], "node long"))
    assert {r["node"] for r in ast.descendants(df, "id", "parent", one(1)).collect()} == {2, 3, 4}
    assert {r["node"] for r in ast.descendants(df, "id", "parent", one(5)).collect()} == {6}
    assert ast.move_makes_cycle(df, "id", "parent", one(2), one(4)).first()["cycle"]
    assert not ast.move_makes_cycle(df, "id", "parent", one(4), one(1)).first()["cycle"]
    got = {r["id"]: r["is_private"] for r in ast.private_context(df, "id", "parent", F.col("visibility") == "private").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert {r["node"] for r in ast.folder_cycles(df, "id", "parent").collect()} == {5, 6}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ast, "cut_lineage", lambda df, label: written.append(1) or shared.cut_lineage(df, label))
    chain = spark.range(1000).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    one = (lambda k: spark.createDataFrame([(k,)], "node long"))
    assert ast.descendants(chain, "id", "parent", one(4)).count() == 995
    assert len(written) <= 12
    assert ast.move_makes_cycle(chain, "id", "parent", one(3), one(999)).first()["cycle"]
    assert ast.folder_cycles(chain, "id", "parent").count() == 0
    ring = chain.selectExpr("id", "(id + 999) % 1000 AS parent")
    del written[:]
    assert ast.folder_cycles(ring, "id", "parent").count() == 1000
    assert len(written) <= 12
    assert ast.descendants(ring, "id", "parent", one(4)).count() == 999


def test_latest_failure_hidden_by_success(spark):
    runs = spark.createDataFrame([("a", 1, 10, "failed"), ("a", 2, 20, "done"), ("b", 3, 5, "done"), ("b", 4, 6, "failed")],
                                 "k string, run_id long, started_at long, status string")
    runs = runs.withColumns({"error": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("long")})
    assert [(r["k"], r["error"], r["failed_at"]) for r in act.latest_failures(runs, "k").collect()] == [("b", "Refresh failed.", 6)]


def test_prices_merge_per_field(spark):
    schema = "provider string, model_id string, input_no_cache double, input_cache_read double, input_cache_write double, output double"
    merged = us.merge_prices(spark.createDataFrame([("p", "m", 1.0, 2.0, None, 4.0)], schema),
                             spark.createDataFrame([("p", "m", None, 9.0, None, None), ("q", "n", 1.0, None, None, None)], schema))
    got = {r["provider"]: tuple(r)[2:] for r in merged.collect()}
    assert got == {"p": (1.0, 9.0, 0.0, 4.0), "q": (1.0, 0.0, 0.0, 0.0)}


def test_text_keys(spark):
    rows = spark.createDataFrame([("item 10",), ("Item 9",), ("item 010b",), ("apple",)], "t string")
    assert [r["t"] for r in rows.orderBy(natural_key(F.col("t"))).collect()] == ["apple", "Item 9", "item 10", "item 010b"]
    assert rows.select(title_label(F.lit("_order  totalUSD_x"))).first()[0] == "Order TotalUSD X"


def test_date_groups(spark):
    stamps = ["2024-01-31 00:00:00", "2024-01-30 23:59:59", "2024-01-29 00:00:00", "2024-01-28 23:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").withColumn("u", F.col("s").cast("timestamp"))
    labels = [r[0] for r in df.select(cr.date_group(F.col("u"), F.lit("2024-01-31 10:00:00").cast("timestamp"))).collect()]
    assert labels == ["Today", "Yesterday", "This week", "Older"]


def test_messages_of_one_instant(spark):
    """Answers must come after the question; sources count from the same instant on."""
    rows = [(7, 1, 10, "user", "web", None), (8, 1, 10, "assistant", None, "p2"), (5, 2, 10, "assistant", None, "p1"),
            (6, 2, 10, "user", "slack", None), (9, 3, 1, "user", "a", None), (10, 3, 2, "user", "b", None), (11, 3, 2, "assistant", None, "p3")]
    df = spark.createDataFrame(rows, "message_id int, chat_id int, s int, role string, source string, provider string")
    df = df.withColumn("created_at", F.timestamp_seconds("s"))
    got = {r["message_id"]: r["usage_provider"] for r in us.with_message_provider(df).collect()}
    assert got == {7: None, 8: "p2", 5: "p1", 6: None, 9: "p3", 10: None, 11: "p3"}
    got = {r["message_id"]: r["usage_source"] for r in us.with_message_source(df).collect()}
    assert got[8] == "web" and got[5] == "slack" and got[11] == "b"


def test_own_chats_leave_out_others_deleted_and_runs(spark):
    chats = spark.createDataFrame(
        [(1, 7, False), (2, 7, None), (3, 7, True), (4, 8, False), (5, 7, False), (6, None, False)], "chat_id long, user_id long, deleted boolean"
    )
    runs = spark.createDataFrame([(5,), (5,), (None,)], "chat_id long")
    assert sorted(r.chat_id for r in cr.own_chats(chats, 7, runs).collect()) == [1, 2]
    assert cr.own_chats(chats, 9, runs).count() == 0
