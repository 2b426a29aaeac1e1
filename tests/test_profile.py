from pyspark.sql import functions as F

from tablescope.operators import catalog as cat
from tablescope.operators import profile as prf


def profile(df, **kw):
    return {r["column"]: r.asDict() for r in prf.profile_table(df, **kw).collect()}


def users(spark):
    return spark.createDataFrame(
        [(1, "Alice", "alice@example.com", True), (2, "Bob", None, False), (3, "Charlie", "charlie@example.com", True)],
        "id int, name string, email string, active boolean",
    )


def test_golden_users(spark):
    for approx in (False, True):
        got = profile(users(spark), approx_distinct=approx)
        i = got["id"]
        assert (i["total_count"], i["null_count"], i["null_percentage"], i["distinct_count"]) == (3, 0, 0.0, 3)
        assert (i["min"], i["max"], i["mean"], i["stddev"]) == (1, 3, 2.0, 0.8165)
        e = got["email"]
        assert (e["null_count"], e["null_percentage"], e["distinct_count"], len(e["top_values"])) == (1, 33.33, 2, 2)
        assert [(v["value"], v["count"]) for v in got["active"]["top_values"]] == [("true", 2), ("false", 1)]


def test_foreign_keys_have_no_numeric_stats(spark):
    got = profile(spark.createDataFrame([(1, 1, 99.99), (2, 1, 24.5)], "id int, user_id int, amount double"))
    assert got["user_id"]["min"] is None and got["user_id"]["distinct_count"] == 1
    assert got["id"]["max"] == 2 and got["amount"]["mean"] == 62.245


def test_empty_table(spark):
    got = profile(spark.createDataFrame([], "id int, price double, name string"))
    assert got["price"]["total_count"] == 0 and got["price"]["null_percentage"] is None
    assert got["name"]["distinct_count"] == 0 and got["name"]["top_values"] is None


def test_complex_columns(spark):
    df = spark.sql("""SELECT * FROM VALUES (array('a', 'b'), named_struct('x', 1), map('k', 2)),
        (array('a', NULL), named_struct('x', 1), NULL), (NULL, NULL, map('k', 2)) AS v(tags, s, m)""")
    got = profile(df)
    assert got["tags"]["null_count"] == 1 and got["tags"]["distinct_count"] == 2
    assert [(v["value"], v["count"]) for v in got["tags"]["top_values"]] == [("a", 2), ("b", 1)]
    assert got["s"]["top_values"][0]["value"] == '{"x":1}' and got["m"]["distinct_count"] == 1


def test_blank_and_null_leave_after_the_cut(spark):
    rows = [("",)] * 20 + [(None,)] * 19 + [(f"v{i:02d}",) for i in range(12)]
    top = profile(spark.createDataFrame(rows, "c string"))["c"]["top_values"]
    assert [v["value"] for v in top] == [f"v{i:02d}" for i in range(8)]


def test_interval_is_not_numeric_and_dates_have_bounds(spark):
    got = profile(spark.sql("SELECT INTERVAL '1' DAY AS i, DATE '2024-02-03' AS d, TIMESTAMP '2024-02-03 04:05:06' AS t"))
    assert got["i"]["min"] is None
    assert got["d"]["min_date"] == "2024-02-03 00:00:00" and got["t"]["max_date"] == "2024-02-03T04:05:06"


def test_hot_value_reaches_the_shuffle_merged(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("c"))
    counts = prf.value_counts(df)
    assert counts.filter("value = 'hot'").first()["cnt"] == 3000
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2


def test_scalar_statistics_scan_once(spark):
    plan = prf.scalar_statistics(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1


def test_globs():
    import re

    assert re.match(cat.glob_regex("main.*_[ab]?"), "main.orders_a1")
    assert not re.match(cat.glob_regex("main.[!x]*"), "main.xyz")
    assert not re.match(cat.glob_regex("a.b"), "aXb")


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], "Amount int, other int")
    assert cat.resolve_column(df, "amount") == "Amount"


def test_hidden_columns_cannot_be_queried(spark):
    view = cat.register_governed(users(spark), "main", "people", ["main.people.e*"])
    assert view.columns == ["id", "name", "active"]
    assert "email" not in spark.sql("SELECT * FROM people").columns


def test_rules_of_values(spark):
    rows = [(0.0, [""], None), (-0.0, ["", "a"], None)] + [(1.0, None, (i,)) for i in range(12)]
    df = spark.createDataFrame(rows, "d double, a array<string>, s struct<x:int>")
    counts = prf.value_counts(df)
    assert {r["column"]: r["distinct_count"] for r in prf.distinct_counts(counts).collect()} == {"d": 2, "a": 2, "s": 12}
    top = prf.top_values(counts).collect()
    assert sum(r["column"] == "s" for r in top) == 10 and ("", 2) in {(r["value"], r["cnt"]) for r in top if r["column"] == "a"}


def test_a_failing_column_is_left_out(spark):
    df = spark.createDataFrame([("1", 5), ("x", 6)], "t string, n int").withColumn("bad", F.col("t").cast("int"))
    assert sorted(r["column"] for r in prf.profile_table(df).collect()) == ["n", "t"]
    window = F.col("n") > 5
    assert {r["total_count"] for r in prf.profile_table(df.drop("bad"), window=window).collect()} == {1}
    ids = spark.range(5000).selectExpr("id", "cast(id as string) AS s")
    assert prf.profile_table(ids, approx_distinct=True).count() == 2


def test_profiles_of_several_tables_keep_their_windows(spark):
    small = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    got = prf.profile_many({"a": small, "b": small}, windows={"b": F.col("x") > 1}).collect()
    assert {r.table: (r.total_count, r.min) for r in got} == {"a": (3, 1.0), "b": (2, 2.0)}
