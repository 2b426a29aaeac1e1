"""Declared metrics: an aggregation at a time grain, by dimensions, under filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATIONS = {
    "SUM": F.sum,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.countDistinct,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
}
GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Metric:
    """A metric over one table; ``filters`` are SQL predicates."""

    name: str
    column: str
    aggregation: str
    date: str
    grain: str
    dimensions: tuple[str, ...] = ()
    filters: tuple[str, ...] = field(default=())


def period(date: str, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"grain {grain!r} is not one of {GRAINS}")
    return F.date_format(F.date_trunc(grain, date), "yyyy-MM-dd").alias("period")


def metric(df: DataFrame, spec: Metric) -> DataFrame:
    for predicate in spec.filters:
        df = df.filter(F.expr(predicate))
    value = AGGREGATIONS[spec.aggregation](F.col(spec.column))
    return df.groupBy(period(spec.date, spec.grain), *spec.dimensions).agg(value.alias(spec.name))


def cohort_ratio(
    df: DataFrame,
    name: str,
    entity: str,
    anchor: str,
    converted: str,
    days: int,
    grain: str,
    dimensions: tuple[str, ...] = (),
) -> DataFrame:
    """Share of distinct entities converted within ``days`` of the anchor, in the anchor's period."""
    in_time = F.col(converted).isNotNull() & (F.datediff(converted, anchor) <= days)
    anchored = df.filter(F.col(anchor).isNotNull())
    # one row per entity and group first, so the distinct counts become plain counts
    once = anchored.groupBy(period(anchor, grain), *dimensions, entity).agg(F.max(in_time).alias("_done"))
    ratio = F.try_divide(F.count_if("_done").cast("double"), F.count(entity).cast("double"))
    return once.groupBy("period", *dimensions).agg(ratio.alias(name))
