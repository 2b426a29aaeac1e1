import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import charts as ch
from tablescope.operators import maps as mp
from tablescope.operators.ordered import number_chunk


def pie(spark, rows):
    df = spark.createDataFrame(rows, "label string, v double")
    return {(r["label"], round(r["v"], 6)) for r in ch.bucket_pie(df, "label", "v").collect()}


def test_pie(spark):
    ten = [(f"s{i}", float(i)) for i in range(10)]
    assert pie(spark, ten) == {(n, v) for n, v in ten}
    twelve = [(f"s{i:02d}", float(20 - i)) for i in range(12)]
    assert pie(spark, twelve) == {*twelve[:10], ("Other", 19.0)}
    kept = [("Other", 50.0), *twelve]
    assert ("Other", 50.0 + 11 + 10 + 9) in pie(spark, kept)
    odd = [*twelve, ("bad", float("nan")), ("worse", None)]
    assert ("Other", 19.0) in pie(spark, odd)
    late = [*twelve, ("Other", 1.0)]
    assert ("Other", 20.0) in pie(spark, late)


def brute_extremum(values, i):
    v, left = values[i], values[i - 1] if i else None
    right = values[i + 1] if i + 1 < len(values) else None
    sign = (lambda x: (x > 0) - (x < 0))
    if v is None:
        return False
    if left is None:
        return right is None or v != right
    if right is None:
        return v != left
    return sign(v - left) != 0 and sign(v - left) == sign(v - right)


def brute_even(points, count):
    if count <= 0:
        return []
    if len(points) <= count:
        return list(points)
    first, last, taken = points[0][0], points[-1][0], []
    for position in range(count):
        target = first + (last - first) * (0.5 if count == 1 else position / (count - 1))
        taken.append(min((p for p in points if p not in taken), key=lambda p: (abs(p[0] - target), p[0])))
    return taken


def brute_downsample(points, n=12):
    values = [p[1] for p in points]
    known = [p for p in points if p[1] is not None]
    chosen = {min(known, key=lambda p: (p[1], p[0])), max(known, key=lambda p: (p[1], -p[0]))}
    extrema = [p for i, p in enumerate(points) if p not in chosen and brute_extremum(values, i)]
    chosen |= set(brute_even(extrema, n - len(chosen)))
    rest = [p for p in known if p not in chosen]
    return chosen | set(brute_even(rest, n - len(chosen)))


@pytest.mark.parametrize("seed", range(4))
def test_downsample_equals_the_turn_by_turn_choice(spark, seed):
    rnd = random.Random(seed)
    series = {
        "noisy": [(i * 3 + rnd.randint(0, 2), float(rnd.randint(0, 50))) for i in range(200)],
        "steady": [(i, float(i)) for i in range(100)],
        "wavy": [(i, float(abs(i % 40 - 20))) for i in range(150)],
        "short": [(i, float(rnd.randint(0, 5))) for i in range(6)],
        "flat": [(i, 1.0) for i in range(30)],
        "holes": [(i, None if i % 7 == 0 else float(i % 11)) for i in range(80)],
    }
    df = spark.createDataFrame([(k, x, y) for k, ps in series.items() for x, y in ps], "s string, x long, y double")
    got = ch.downsample(df, "s", "x", "y", number_chunk("x", 16)).collect()
    for name, points in series.items():
        assert {(r["x"], r["y"]) for r in got if r["s"] == name} == brute_downsample(points), name


def test_extremum(spark):
    values = [1.0, 1.0, 3.0, 2.0, 2.0, None, 4.0, 0.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, x long, y double")
    got = {r["x"]: r["is_extremum"] for r in ch.with_extremum(df, ["s"], "x", "y", number_chunk("x", 2)).collect()}
    assert [got[i] for i in range(8)] == [brute_extremum(values, i) for i in range(8)]


def test_kpi_percentage_is_null_from_zero(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 0.0), ("a", "2024-01-02", 5.0), ("b", "2024-01-01", 1.0)], "k string, d string, v double")
    rows = ch.kpi_comparison(df.withColumn("d", F.col("d").cast("timestamp")), ["k"], "d", "v").collect()
    assert [(r["k"], r["delta"], r["direction"], r["percent"], r["period"]) for r in rows] == [("a", 5.0, "up", None, "yesterday")]


def test_percent_stack_clamps_and_survives_zero(spark):
    df = spark.createDataFrame([(1.0, -2.0, 9.0), (0.0, 0.0, 0.0), (None, 4.0, 4.0)], "a double, b double, total double")
    got = [(r["a_share"], r["b_share"]) for r in ch.percent_stack(df, ["a", "b", "total"], ["total"]).collect()]
    assert got == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_flat_scales(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [r["ratio"] for r in ch.scale_ratio(df, "v").collect()] == [1.0, 1.0, None]
    assert [r["scaled"] for r in mp.scale_sqrt(df, "v", 4.0, 28.0).collect()] == [28.0, 28.0, 4.0]
    assert [r["scaled"] for r in mp.scale_linear(df, "v", 0.0, 1.0).collect()] == [0.5, 0.5, 0.5]


@pytest.mark.parametrize("lons, west, east", [
    ([179.0, -179.0], 179.0, 181.0), ([10.0], 10.0, 10.0), ([-10.0, 0.0, 20.0], -10.0, 20.0),
    ([-170.0, 160.0, 175.0], 160.0, 190.0), ([-90.0, 90.0], -90.0, 90.0), ([0.01, 0.02, 0.5], 0.01, 0.5),
])
def test_bounds(spark, lons, west, east):
    df = spark.createDataFrame([(1.0, x) for x in lons], "latitude double, longitude double")
    row = mp.map_bounds(df).first()
    assert (row["west"], row["east"]) == (west, east)


def test_no_points_no_bounds(spark):
    df = spark.createDataFrame([], "latitude double, longitude double")
    assert mp.map_bounds(df).count() == 0


def test_points_at_the_limits(spark):
    rows = [("85.051129", "180"), ("-85.06", "0"), ("1", "180.1"), ("x", "1"), (None, "1"), ("1e1", " 2 ")]
    df = spark.createDataFrame(rows, "lat string, lon string")
    assert [(r["latitude"], r["longitude"]) for r in mp.map_points(df, "lat", "lon").collect()] == [(85.051129, 180.0), (10.0, 2.0)]
    report = mp.point_report(df, "lat", "lon").first()
    assert (report["point_count"], report["dropped_row_count"], report["too_many"]) == (2, 4, False)


def test_small_rest_beside_large_slices(spark):
    rows = [(f"c{i}", 1e16) for i in range(10)] + [("x", 1.0), ("y", 1.0)]
    got = {r["c"]: r["v"] for r in ch.bucket_pie(spark.createDataFrame(rows, "c string, v double"), "c", "v").collect()}
    assert got[ch.OTHER] == 2.0 and len(got) == 11
    equal = [(f"c{i}", 5.0) for i in range(13)] + [("c3", 5.0), (None, 5.0)]
    got = ch.bucket_pie(spark.createDataFrame(equal, "c string, v double"), "c", "v", 4).collect()
    assert sum(r["v"] for r in got) == 75.0 and {r["v"] for r in got if r["c"] == ch.OTHER} == {55.0}
