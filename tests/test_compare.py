import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import compare as ev

#: Per style: the mark between groups of three digits, the mark before decimals.
STYLES = {"us": (",", "."), "eu": (".", ","), "spaced": (" ", ","), "narrow": ("\u202f", "."), "bare": ("", ".")}


def spelled(value: int, decimals: str, group: str, point: str) -> str:
    return f"{value:_}".replace("_", group) + (point + decimals if decimals else "")


def generated_numbers(count=400):
    """Random numbers in every style, with signs, currency signs and blanks around; where a mark could mean either, the first
    spelling that fits is expected."""
    rnd = random.Random(31)
    for i in range(count):
        style = sorted(STYLES)[i % len(STYLES)]
        group, point = STYLES[style]
        value = rnd.randrange(10 ** rnd.randrange(1, 11))
        decimals = "".join(rnd.choices("0123456789", k=rnd.randrange(4)))
        if style == "eu" and not decimals and value < 1_000_000:
            decimals = "5"  # one dot alone reads as a decimal point
        if style == "spaced" and decimals:
            want = float(f"{value}{decimals}")  # without dots a comma parts groups, and groups may have any length
        else:
            want = float(f"{value}.{decimals or 0}")
        if style == "eu" and decimals and value < 1000:
            want = float(f"{value}{decimals}")
        sign, currency, blank = rnd.choice(["", "-"]), rnd.choice(["", "", "£", "₹"]), rnd.choice(["", " ", "\u00a0"])
        yield blank + currency + sign + spelled(value, decimals, group, point) + blank, -want if sign else want


REFUSED = ["", "n/a", "1-2", "12%", "3 apples", "0x1f", "1..2", "¥", "Infinity"]


def test_numbers_are_read_back(spark):
    cases = [*generated_numbers(), *((t, None) for t in REFUSED)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", ev.formatted_number(F.col("t")).alias("n")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases


def frame(spark, rows, schema="k string, v double"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("actual, expected, verdict", [
    ([("a", 1.001), ("b", 2.0)], [("b", 2.0), ("a", 1.004)], (True, "match")),
    ([("a", 100000.0)], [("a", 100000.5)], (True, "match (approximate)")),
    ([("a", 1.0)], [("a", 1.02)], (False, "values differ")),
    ([("a", 1.0)], [("a", 1.0), ("a", 1.0)], (False, "row count: 1 vs 2")),
    ([("a", float("nan")), (None, None)], [(None, None), ("a", float("nan"))], (True, "match")),
    ([("a", 1.0), ("a", 1.0), ("b", 1.0)], [("a", 1.0), ("b", 1.0), ("b", 1.0)], (False, "values differ")),
])
def test_verdicts(spark, actual, expected, verdict):
    got = ev.compare_tables(frame(spark, actual), frame(spark, expected), ["k", "v"])
    assert (got.passed, got.message) == verdict


def test_extra_actual_columns_are_ignored_and_missing_ones_named(spark):
    wide = frame(spark, [("a", 1.0)]).withColumn("extra", F.lit(1))
    assert ev.compare_tables(wide, frame(spark, [("a", 1.0)]), ["k", "v"]).passed
    assert ev.compare_tables(frame(spark, [("a", 1.0)]).drop("v"), frame(spark, [("a", 1.0)]), ["k", "v"]).message == "missing columns: v"


def test_text_numbers_equal_numbers(spark):
    spelled = spark.createDataFrame([("a", "1,234.50"), ("b", "$2")], "k string, v string")
    assert ev.compare_tables(spelled, frame(spark, [("a", 1234.5), ("b", 2.0)]), ["k", "v"]).message == "match"


def test_differing_cells(spark):
    got = ev.differing_cells(frame(spark, [("a", 1.0), ("b", 2.0)]), frame(spark, [("a", 1.0), ("b", 3.0)]), ["k", "v"]).collect()
    assert [(r["rn"], r["column"], r["actual"], r["expected"]) for r in got] == [(2, "v", "2.0", "3.0")]


def test_model_summary(spark):
    runs = spark.createDataFrame(
        [(1, "t1", "m", True, 10, 0.5, 1500, 2), (2, "t2", "m", False, None, None, 1000, 1), (3, "t1", None, True, 5, 0.1, 10, 0)],
        "seq int, test string, model string, passed boolean, tokens long, cost double, duration_ms long, tool_call_count long")
    got = [(r["model"], r["pass_rate"], r["total_tokens"], r["avg_tool_calls"]) for r in ev.summarize_by_model(runs).collect()]
    assert got == [("unknown", 100.0, 5, 0.0), ("m", 50.0, 10, 1.5)]
    matrix = {r["test"]: (r["m"], r["x"]) for r in ev.model_matrix(runs, ["m", "x"]).collect()}
    assert matrix == {"t1": ("pass", "-"), "t2": ("fail", "-")}
