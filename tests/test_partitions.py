import random

from pyspark.sql import functions as F

from tablescope.operators import partitions as pt
from tablescope.operators import profile as prf

SHARED = ["column", "type", "total_count", "null_count", "null_percentage", "min", "max", "mean", "stddev", "min_date", "max_date"]


def table(spark, parts=(1, 2, 3, None), n=400):
    pick = random.Random(4)
    rows = []
    for p in parts:
        for _ in range(n if p != 3 else 1):
            x = None if pick.random() < 0.2 or p == 2 else 1e9 + pick.random()
            rows.append((p, x, pick.choice(["a", "b", "", None]), f"2024-0{p or 9}-0{pick.randrange(1, 9)}", pick.choice([[1], None]), p))
    made = spark.createDataFrame(rows, "part int, x double, `s.t` string, d string, arr array<int>, total int")
    return made.withColumn("d", F.to_date("d"))


def rows_of(frame, columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and abs(x - y) <= 1e-4 + 1e-12 * abs(y), (a, b)


def test_merged_partitions_are_the_profile(spark):
    """Columns called as those of the result, a dot in a name, nulls, a partition of nulls, one of a single row."""
    df = table(spark)
    got = pt.merge_statistics(pt.partition_statistics(df, F.col("part")))
    want = prf.profile_table(df)
    near(rows_of(got, SHARED), rows_of(want, SHARED))
    plain = [r for r in rows_of(want, ["column", "distinct_count"]) if r[0] != "arr"]
    few = dict(rows_of(got, ["column", "distinct_count"]))
    assert few.pop("arr") is None
    assert all(abs(few[c] - n) <= 0.05 * n for c, n in plain) and few["s.t"] == 3
    exact = pt.merge_statistics(pt.partition_statistics(df, F.col("part")), exact=df)
    assert rows_of(exact, ["column", "distinct_count"]) == rows_of(want, ["column", "distinct_count"])


def test_refresh_reads_new_partitions_only(spark):
    df = table(spark)
    ids = df.select("part").distinct()
    stored = pt.partition_statistics(df.filter("part IN (1, 2)"), F.col("part")).cache()
    changed = df.withColumn("x", F.when(F.col("part") == 1, -1.0).otherwise(F.col("x")))
    near(rows_of(pt.merge_statistics(pt.refresh_statistics(stored, changed, F.col("part"), ids)), SHARED), rows_of(prf.profile_table(df), SHARED))
    gone = pt.refresh_statistics(stored, df, F.col("part"), ids.filter("part = 2"))
    assert {r.part for r in gone.collect()} == {2}


def test_empty_table(spark):
    empty = table(spark).limit(0)
    stats = pt.partition_statistics(empty, F.col("part"))
    assert stats.count() == 0 and pt.merge_statistics(stats).count() == 0
    assert pt.refresh_statistics(stats, empty, F.col("part"), empty.select("part")).count() == 0
