"""Dashboard filters as predicates: an inactive filter simply is not there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.types import is_date

OPTIONS_LIMIT = 100


@dataclass(frozen=True)
class Filter:
    """``kind`` is select, multi_select, search or date_range."""

    name: str
    column: str
    kind: str


def _filled(v) -> bool:
    return isinstance(v, str) and v.strip() != ""


def is_active(kind: str, selection) -> bool:
    if kind in ("select", "search"):
        return _filled(selection)
    if not isinstance(selection, (list, tuple)):
        return False
    if kind == "multi_select":
        return any(_filled(v) for v in selection)
    return len(selection) >= 2 and _filled(selection[0]) and _filled(selection[1])


def predicate(df: DataFrame, f: Filter, selection) -> Column:
    c = F.col(f.column)
    if f.kind == "select":
        return c == selection
    if f.kind == "multi_select":
        return c.isin([v for v in selection if _filled(v)])
    if f.kind == "search":
        # a literal substring: no wildcard to escape
        return c.contains(selection)
    kind = df.schema[f.column].dataType
    low, high = (F.lit(v).cast(kind) if is_date(kind) else F.lit(v) for v in selection[:2])
    return c.between(low, high)


def apply_filters(df: DataFrame, filters: list[Filter], selections: dict) -> DataFrame:
    for f in filters:
        chosen = selections.get(f.name)
        if is_active(f.kind, chosen):
            df = df.filter(predicate(df, f, chosen))
    return df


def options_cut(df: DataFrame, column: str, limit: int = OPTIONS_LIMIT) -> DataFrame:
    """One row: how many distinct values there are and whether ``filter_options`` leaves some out."""
    n = F.count_distinct(F.col(column))
    return df.agg(n.alias("options"), (n > limit).alias("truncated"))


def filter_options(df: DataFrame, column: str, limit: int | None = OPTIONS_LIMIT) -> DataFrame:
    """Distinct values to offer: ordered, cut at ``limit`` (none: all), then blanks dropped."""
    c = F.col(column)
    distinct = df.filter(c.isNotNull()).select(c.alias("option")).distinct()
    cut = distinct if limit is None else distinct.orderBy("option").limit(limit)
    return cut.select(F.trim(F.col("option").cast("string")).alias("option")).filter(F.col("option") != "")


def filter_all(frames: dict[str, DataFrame], filters: list[Filter], selections: dict) -> dict[str, DataFrame]:
    """Every dashboard query under one selection; a filter touches the frames that have its column."""
    return {
        name: apply_filters(df, [f for f in filters if f.column in df.columns], selections)
        for name, df in frames.items()
    }


def _months(n: int):
    return lambda latest: latest - F.make_interval(months=F.lit(n))


DATE_PRESETS = {
    "7d": lambda latest: latest - F.make_dt_interval(F.lit(7)),
    "30d": lambda latest: latest - F.make_dt_interval(F.lit(30)),
    "3m": _months(3),
    "6m": _months(6),
    "1y": _months(12),
}


def date_preset(df: DataFrame, column: str, preset: str) -> DataFrame:
    """Rows within a preset of the latest date in the data; invalid dates go.

    Month presets clamp to the month's last day (31 May minus 3 months is 29 February).
    """
    if preset == "all":
        return df
    c = F.col(column)
    when = c if is_date(df.schema[column].dataType) else F.try_to_timestamp(c)
    latest = df.agg(F.max(when)).scalar()
    return df.filter(when >= DATE_PRESETS[preset](latest))


def sort_by_date(df: DataFrame, column: str, tie_break: list[str] = ()) -> DataFrame:
    """Chronological, unparseable dates last."""
    return df.orderBy(F.try_to_timestamp(F.col(column).cast("string")).asc_nulls_last(), *tie_break)
