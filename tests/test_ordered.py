import random

from pyspark.sql import functions as F

from tablescope.operators.ordered import (
    even_chunk,
    neighbours,
    number_chunk,
    running,
    top_per_key,
    with_chunks,
    with_row_number,
)


def skewed(spark, n=600):
    """A third of the rows share one key; null keys and values occur."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None])
        rows.append((key, i, rnd.randint(0, 300), None if rnd.random() < 0.2 else rnd.randint(0, 9)))
    return rows, spark.createDataFrame(rows, "k string, id long, t long, v long")


def test_running_matches_a_plain_scan_over_many_chunks(spark):
    rows, df = skewed(spark)
    specs = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "newest": ("last", F.col("v"))}
    for inclusive in (True, False):
        for backward in (True, False):
            out = running(df, ["k"], ["t", "id"], number_chunk("t", 7), specs, inclusive, backward)
            got = {r["id"]: (r["total"], r["top"], r["low"], r["newest"]) for r in out.collect()}
            for key in ("hot", "a", "b", None):
                seen = []
                for _, i, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]), reverse=backward):
                    window = [x for x in seen + ([v] if inclusive else []) if x is not None]
                    want = (sum(window), max(window), min(window), window[-1]) if window else (None,) * 4
                    assert got[i] == want
                    seen.append(v)


def test_neighbours_carry_nulls(spark):
    rows, df = skewed(spark)
    out = neighbours(df, ["k"], ["t", "id"], even_chunk(df, "t", 50), ["v"])
    got = {r["id"]: (r["prev_v"], r["next_v"]) for r in out.collect()}
    for key in ("hot", "a", "b", None):
        line = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for at, r in enumerate(line):
            before = line[at - 1][3] if at else None
            after = line[at + 1][3] if at + 1 < len(line) else None
            assert got[r[1]] == (before, after)


def test_row_number_is_gapless_when_one_value_dominates(spark):
    df = spark.range(0, 3000, numPartitions=6).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("v"))
    out = with_row_number(df, [F.col("v").asc()]).collect()
    assert sorted(r["rn"] for r in out) == list(range(1, 3001))
    by_rn = sorted(out, key=lambda r: r["rn"])
    assert [r["v"] for r in by_rn] == sorted(r["v"] for r in out)


def test_top_per_key_cuts_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = top_per_key(df, ["k"], [F.col("t")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_chunks_by_rows(spark):
    """A key with a third of the rows, all inside one hour, is cut into chunks of about the rows asked for."""
    rnd = random.Random(8)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, i, 5_000 + int(rnd.random() ** 3 * 3600e6) if i % 11 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, id long, t long")
    got = with_chunks(df, ["k"], "t", 200, "c").collect()
    assert sorted((r["k"] or "", r["id"]) for r in got) == sorted((k or "", i) for k, i, _ in rows)
    sizes = {}
    for r in got:
        sizes[r["k"], r["c"]] = sizes.get((r["k"], r["c"]), 0) + (r["t"] is not None)
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) >= 8 and max(hot) < 300
    assert {c for (k, c) in sizes if k == "k1"} == {0}
    # the number rises with the value, and nulls, which sort first, are in the first chunk
    for key in ("hot", None):
        of = sorted(((-1 if r["t"] is None else r["t"]), r["c"]) for r in got if r["k"] == key)
        assert [c for _, c in of] == sorted(c for _, c in of) and of[0][1] == 0


def test_running_by_rows_equals_running_by_width(spark):
    rows, df = skewed(spark)
    specs = {"total": ("sum", F.col("v")), "newest": ("last", F.col("v"))}
    for inclusive, backward in ((True, False), (False, True)):
        want, got = (
            {r["id"]: (r["total"], r["newest"]) for r in running(df, ["k"], ["t", "id"], chunk, specs, inclusive, backward).collect()}
            for chunk in (number_chunk("t", 7), 9)
        )
        assert got == want


def test_chunks_of_a_whole_table(spark):
    df = spark.range(5000).withColumn("d", F.expr("date_add(date'2024-01-01', cast(id % 100 as int))"))
    sizes = with_chunks(df, [], "d", 500, "c").groupBy("c").count().collect()
    assert len(sizes) >= 8 and sum(r["count"] for r in sizes) == 5000
    assert with_chunks(df.limit(0), [], "d").count() == 0
