"""Tolerant comparison of result sets and summaries of evaluation runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.types import is_integer, is_numeric
from tablescope.operators.ordered import with_row_number

# fixed values: number spellings in the order they are tried
US_NUMBER = r"^-?[\d,]+(\.\d+)?$"
EU_NUMBER = r"^-?[\d.]+,\d+$"
EU_THOUSANDS = r"^-?\d{1,3}(\.\d{3})+$"


def formatted_number(text: Column) -> Column:
    """The number a locale-formatted text spells, else null."""
    blank = r"[\s\u00a0\u202f]"
    t = F.regexp_replace(F.regexp_replace(text, rf"^{blank}+", ""), r"^[$€£¥₹]", "")
    t = F.regexp_replace(t, blank, "")
    body = F.regexp_replace(t, r"^-?\+?", "")
    nothing = F.lit("")
    plain = (
        F.when(body.rlike(US_NUMBER), F.replace(body, F.lit(","), nothing))
        .when(body.rlike(EU_NUMBER), F.replace(F.replace(body, F.lit("."), nothing), F.lit(","), F.lit(".")))
        .when(body.rlike(EU_THOUSANDS), F.replace(body, F.lit("."), nothing))
    )
    number = plain.try_cast("double")
    return F.when(t.startswith("-"), -number).otherwise(number)


def normalise_text_number(text: Column) -> Column:
    """Canonical text: the number in one spelling, or the text as it is."""
    return F.coalesce(formatted_number(text).cast("string"), text)


@dataclass(frozen=True)
class Tolerance:
    rtol: float = 1e-5
    atol: float = 1e-8
    decimals: int = 2


def _all_numbers(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which text columns hold only numbers, in one scan."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return {}
    test = [
        F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), formatted_number(F.col(c)).isNotNull())), F.lit(False)).alias(c)
        for c in texts
    ]
    return df.agg(*test).first().asDict()


def _prepared(df: DataFrame, columns: list[str], t: Tolerance) -> tuple[DataFrame, set[str]]:
    """Comparable columns: numbers as rounded doubles, whole numbers unrounded, the rest as text."""
    parsed = _all_numbers(df, columns)
    out, numeric = [], set()
    for c in columns:
        kind, col = df.schema[c].dataType, F.col(c)
        if is_integer(kind):
            value = col.cast("double")
            numeric.add(c)
        elif is_numeric(kind):
            value = F.bround(col.cast("double"), t.decimals)
            numeric.add(c)
        elif isinstance(kind, T.StringType) and parsed[c]:
            value = F.bround(formatted_number(col), t.decimals)
            numeric.add(c)
        elif isinstance(kind, T.StringType):
            value = normalise_text_number(col)
        else:
            value = col.cast("string")
        out.append(value.alias(c))
    return df.select(*out), numeric


def _close(a: Column, b: Column, t: Tolerance) -> Column:
    near = F.abs(a - b) <= F.lit(t.atol) + F.lit(t.rtol) * F.abs(b)
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def _aligned(actual: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides paired by their place in the sort over all columns."""
    order = [F.col(c).asc_nulls_last() for c in columns]
    a = with_row_number(actual, order).select("rn", *[F.col(c).alias(f"a_{c}") for c in columns])
    e = with_row_number(expected, order).select("rn", *[F.col(c).alias(f"e_{c}") for c in columns])
    return a.join(e, "rn", "full_outer")


def _differs(c: str, both: set[str], t: Tolerance) -> Column:
    a, e = F.col(f"a_{c}"), F.col(f"e_{c}")
    return ~_close(a, e, t) if c in both else ~a.eqNullSafe(e)


@dataclass(frozen=True)
class Verdict:
    passed: bool
    message: str


def compare_tables(
    actual: DataFrame, expected: DataFrame, columns: list[str] | None = None, t: Tolerance = Tolerance()
) -> Verdict:
    """Whether two results agree, whatever their row order.

    Equal multisets are found by counting equal rows, which merges duplicates in the map tasks and needs
    no sort. Only otherwise are both sides sorted by their rounded values and compared row by row.
    """
    n_actual, n_expected = actual.count(), expected.count()
    if not n_actual and not n_expected:
        return Verdict(True, "both empty")
    if not n_actual or not n_expected:
        return Verdict(False, ("actual" if not n_actual else "expected") + " is empty")
    if columns:
        missing = sorted(set(columns) - set(actual.columns))
        if missing:
            return Verdict(False, f"missing columns: {', '.join(missing)}")
    columns = sorted(columns or actual.columns)
    if n_actual != n_expected:
        return Verdict(False, f"row count: {n_actual} vs {n_expected}")
    if set(columns) - set(expected.columns):
        return Verdict(False, "values differ")
    a, numeric_a = _prepared(actual, columns, t)
    e, numeric_e = _prepared(expected, columns, t)
    both = numeric_a & numeric_e
    if numeric_a == numeric_e:
        tally = a.withColumn("_n", F.lit(1)).unionByName(e.withColumn("_n", F.lit(-1)))
        if tally.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0).isEmpty():
            return Verdict(True, "match")
    elif any((c in numeric_a) != (c in numeric_e) for c in columns):
        return Verdict(False, "values differ")
    off = reduce(lambda x, y: x | y, [_differs(c, both, t) for c in columns])
    if _aligned(a, e, columns).filter(off).isEmpty():
        return Verdict(True, "match (approximate)")
    return Verdict(False, "values differ")


def differing_cells(
    actual: DataFrame, expected: DataFrame, columns: list[str], t: Tolerance = Tolerance()
) -> DataFrame:
    """(rn, column, actual, expected) of every cell that differs after sorting both sides."""
    columns = sorted(columns)
    a, numeric_a = _prepared(actual, columns, t)
    e, numeric_e = _prepared(expected, columns, t)
    both = numeric_a & numeric_e
    cells = [
        F.when(
            _differs(c, both, t),
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"a_{c}").cast("string").alias("actual"),
                F.col(f"e_{c}").cast("string").alias("expected"),
            ),
        )
        for c in columns
    ]
    found = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return _aligned(a, e, columns).select("rn", F.inline(found))


# ---- evaluation runs: test, model, seq, passed, tokens, cost, duration_ms, tool_call_count


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _mean(c: str, places: int) -> Column:
    mean = F.try_divide(_total(c).cast("double"), F.count(F.lit(1)).cast("double"))
    return F.coalesce(F.bround(mean, places), F.lit(0.0))


def _summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"),
        _total("tokens").alias("total_tokens"),
        F.round(_total("cost"), 6).alias("total_cost"),
        _total("duration_ms").alias("total_duration_ms"),
        _mean("duration_ms", 0).alias("avg_duration_ms"),
        _total("tool_call_count").alias("total_tool_calls"),
        _mean("tool_call_count", 1).alias("avg_tool_calls"),
    ]


def summarize(runs: DataFrame) -> DataFrame:
    seconds = F.bround(_total("duration_ms") / 1000, 2).alias("total_duration_s")
    return runs.agg(*_summary(), seconds)


def summarize_by_model(runs: DataFrame) -> DataFrame:
    """Summary per model with its pass rate, best and cheapest first."""
    rate = F.bround(F.count_if("passed") / F.count(F.lit(1)) * 100, 1)
    named = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model")
    out = runs.groupBy(named).agg(*_summary(), rate.alias("pass_rate"))
    return out.orderBy(F.col("pass_rate").desc(), "total_cost", "model")


def model_matrix(runs: DataFrame, models: list[str]) -> DataFrame:
    """Tests by models: the outcome of each run in run order, ``-`` where a model did not run."""
    outcome = F.when(F.col("passed"), "pass").otherwise("fail")
    rows = runs.select(
        "test", "seq", *[F.when(F.col("model") == m, outcome).alias(f"_m{i}") for i, m in enumerate(models)]
    )
    cells = [
        F.coalesce(F.expr(f"listagg(_m{i}, ' ') WITHIN GROUP (ORDER BY seq)"), F.lit("-")).alias(m)
        for i, m in enumerate(models)
    ]
    return rows.groupBy("test").agg(*cells)
