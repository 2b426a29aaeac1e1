"""Chart data shaping: bucketing, shares, comparisons, ranges, extrema, downsampling, cell rules."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.text import finite
from tablescope.operators.ordered import neighbours, top_per_key

MAX_SLICES = 10
OTHER = "Other"
MAX_POINTS = 12


def bucket_pie(df: DataFrame, category: str, value: str, max_slices: int = MAX_SLICES) -> DataFrame:
    """Largest slices plus one ``Other`` holding the sum of the rest.

    Few rows pass unchanged. A kept slice already called Other takes the rest. Equal values are ordered
    by category. The rest is summed directly, from the rows after the last kept one, as a difference of large sums
    would lose small values; only the kept rows meet in one task.
    """
    number = F.coalesce(finite(F.col(value)), F.lit(0.0))
    rows = df.select(F.col(category).cast("string").alias(category), number.alias(value))
    best = [F.col(value).desc(), F.col(category).asc_nulls_last()]
    top = rows.orderBy(*best).limit(max_slices).withColumn("_n", F.lit(None).cast("long"))
    # the last kept row; rows equal to it may lie on either side of the cut
    last = top.agg(F.max(F.struct((-F.col(value)).alias("v"), F.col(category).isNull().alias("n"), category))).scalar()
    lowest, blank, named = -last["v"], last["n"], last[category]
    equal = (F.col(value) == lowest) & F.col(category).eqNullSafe(named)
    after = (F.col(value) < lowest) | ((F.col(value) == lowest) & ~blank & (F.col(category).isNull() | (F.col(category) > named)))
    kept_equal = top.agg(F.count_if(equal)).scalar()
    rest = F.coalesce(F.sum(F.when(after, F.col(value))), F.lit(0.0)) + (F.count_if(equal) - kept_equal) * lowest
    total = rows.agg(rest.alias(value), F.count(F.lit(1)).alias("_n"))
    # from here on there are at most max_slices rows and the rest
    few = top.unionByName(total.withColumn(category, F.lit(OTHER)))
    is_total, every = F.col("_n").isNotNull(), Window.partitionBy()
    ranked = few.withColumn("_rank", F.row_number().over(Window.orderBy(is_total, *best)))
    first_other = F.min(F.when(~is_total & (F.col(category) == OTHER), F.col("_rank"))).over(every)
    merged = ranked.select(
        category,
        value,
        F.when(is_total, F.coalesce(first_other, F.col("_rank"))).otherwise(F.col("_rank")).alias("_rank"),
        "_n",
    ).filter(F.col("_n").isNull() | (F.col("_n") > max_slices))
    return merged.groupBy("_rank", category).agg(F.sum(value).alias(value)).select(category, value)


def percent_stack(df: DataFrame, series: list[str], totals: list[str] = ()) -> DataFrame:
    """Share of each part in its row; negative parts count as 0, total series stay out of the base."""
    parts = [s for s in series if s not in totals]
    clamped = {s: F.greatest(F.coalesce(F.col(s).cast("double"), F.lit(0.0)), F.lit(0.0)) for s in parts}
    base = reduce(lambda a, b: a + b, clamped.values())
    shares = {f"{s}_share": F.when(base == 0, 0.0).otherwise(c / base) for s, c in clamped.items()}
    return df.withColumns(shares)


def stack_total(series: list[str]) -> Column:
    """Sum of the numeric parts of a row; null when there is none."""
    numbers = [finite(F.col(s)) for s in series]
    total = reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in numbers])
    some = reduce(lambda a, b: a | b, [n.isNotNull() for n in numbers])
    return F.when(some, total)


def period_label(previous: Column, current: Column) -> Column:
    """Name of the gap between two dates."""
    gap = F.round((F.unix_seconds(current.cast("timestamp")) - F.unix_seconds(previous.cast("timestamp"))) / 86400.0)
    return (
        F.when(gap == 1, "yesterday")
        .when(gap.between(6, 8), "last week")
        .when(gap.between(26, 33), "last month")
        .when(gap.between(80, 100), "last quarter")
        .when(gap.between(330, 400), "last year")
        .otherwise("previous period")
    )


def kpi_comparison(df: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    """Last row against the one before, per key: delta, direction, percentage, period name."""
    latest = top_per_key(df.select(*keys, x, value), keys, [F.col(x).desc()], 2, "_rank")

    def at(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    pair = latest.groupBy(*keys).agg(
        finite(at(1, value)).alias("current"), finite(at(2, value)).alias("previous"),
        at(1, x).alias("_x1"), at(2, x).alias("_x2"),
    )
    delta = F.col("current") - F.col("previous")
    percent = F.when(F.col("previous") != 0, F.round(F.abs(delta / F.abs("previous")) * 100, 1))
    return pair.filter(delta.isNotNull()).select(
        *keys, "current", "previous", delta.alias("delta"),
        F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat").alias("direction"),
        percent.alias("percent"), period_label(F.col("_x2"), F.col("_x1")).alias("period"),
    )


def latest_row(df: DataFrame, keys: list[str], x: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(x).alias(x), F.max_by(value, x).alias(value))


def axis_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """Extremes over all values of all columns."""
    numbers = [finite(F.col(c)) for c in columns]
    low = [F.min(n) for n in numbers]
    high = [F.max(n) for n in numbers]
    pick = (lambda f, cs: cs[0] if len(cs) == 1 else f(*cs))
    return df.agg(pick(F.least, low).alias("axis_min"), pick(F.greatest, high).alias("axis_max"))


def stacked_axis_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """Extremes of stacked rows: positive and negative parts add up apart; zero totals do not count."""
    zero = F.lit(0.0)
    numbers = [F.coalesce(finite(F.col(c)), zero) for c in columns]
    up = reduce(lambda a, b: a + b, [F.greatest(n, zero) for n in numbers])
    down = reduce(lambda a, b: a + b, [F.least(n, zero) for n in numbers])
    both = df.select(F.explode(F.array(up, down)).alias("v")).filter(F.col("v") != 0)
    return both.agg(F.min("v").alias("axis_min"), F.max("v").alias("axis_max"))


def with_extremum(df: DataFrame, keys: list[str], x: str, y: str, chunk: Column) -> DataFrame:
    """Flag peaks and troughs; an end point counts when it differs from its neighbour."""
    out = neighbours(df, keys, [x], chunk, [y])
    v, left, right = F.col(y), F.col(f"prev_{y}"), F.col(f"next_{y}")
    turn = (F.signum(v - left) != 0) & (F.signum(v - left) == F.signum(v - right))
    flag = (
        F.when(v.isNull(), False)
        .when(left.isNull(), right.isNull() | (v != right))
        .when(right.isNull(), v != left)
        .otherwise(turn)
    )
    return out.withColumn("is_extremum", flag).drop(f"prev_{y}", f"next_{y}")


def _nearest_in_turn(xs: list, low, high, slots: int) -> list:
    """Each of ``slots`` even targets from ``low`` to ``high``, left to right, takes the nearest point not yet taken."""
    taken: list = []
    for position in range(slots):
        target = low + (high - low) * (0.5 if slots == 1 else position / (slots - 1))
        taken.append(min((x for x in xs if x not in taken), key=lambda x: (abs(x - target), x)))
    return taken


def downsample(df: DataFrame, key: str, x: str, y: str, chunk: Column, points: int = MAX_POINTS) -> DataFrame:
    """At most ``points`` labelled points per series: minimum, maximum, extrema, then evenly spread ones.

    The targets cut a class of points into cells, found by arithmetic. Of each cell the first and last ``points`` rows are
    kept (cut inside the map tasks), which always hold the row that the turn-by-turn choice takes, as no target has more
    than ``points`` rows taken around it; that choice then sees a bounded set per series.
    """
    rows = with_extremum(df.select(key, x, y), [key], x, y, chunk).filter(F.col(y).isNotNull())
    ends = rows.groupBy(key).agg(
        F.min_by(x, F.struct(F.col(y), F.col(x))).alias("_min_x"),
        F.min_by(x, F.struct(-F.col(y), F.col(x))).alias("_max_x"),
        F.count(F.lit(1)).alias("_n"),
    )
    tagged = rows.join(ends, key).withColumn(
        "cls",
        F.when((F.col(x) == F.col("_min_x")) | (F.col(x) == F.col("_max_x")), "ends")
        .when(F.col("is_extremum"), "extrema")
        .otherwise("rest"),
    )
    spans = tagged.groupBy(key, "cls").agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_count")
    )
    sizes = spans.groupBy(key).agg(
        F.sum(F.when(F.col("cls") == "ends", F.col("_count"))).alias("_ends"),
        F.coalesce(F.sum(F.when(F.col("cls") == "extrema", F.col("_count"))), F.lit(0)).alias("_extrema"),
    )
    free = F.lit(points) - F.col("_ends")
    slots = (
        F.when(F.col("cls") == "ends", F.col("_ends"))
        .when(F.col("cls") == "extrema", free)
        .otherwise(F.greatest(free - F.least(F.col("_extrema"), free), F.lit(0)))
    )
    plan = spans.join(sizes, key).select(
        F.col(key).alias("_key"), F.col("cls").alias("_cls"), "_lo", "_hi", "_count",
        slots.cast("int").alias("slots"),
    ).filter(F.col("slots") > 0)
    near = tagged.join(plan, (F.col(key) == F.col("_key")) & (F.col("cls") == F.col("_cls"))).select(
        F.col(key), "cls", F.col(x).alias("x"), F.col(y).alias("y"), "_lo", "_hi", "slots", "_count"
    )
    part = (F.col("x") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    cell = F.when(F.col("slots") == 1, (part > 0.5).cast("int")).otherwise(F.floor(part * (F.col("slots") - 1)).cast("int"))
    near = near.withColumn("cell", F.coalesce(cell, F.lit(0)))
    # a class that fits has no more rows than ``points``, so all of them are kept
    near = top_per_key(near, [key, "cls", "cell"], [F.col("x")], points).unionByName(
        top_per_key(near, [key, "cls", "cell"], [F.col("x").desc()], points)
    )
    schema = near.select(F.col(key), F.col("x").alias(x), F.col("y").alias(y)).schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, part in pdf.groupby("cls"):
            slots, count = int(part["slots"].iloc[0]), int(part["_count"].iloc[0])
            xs = sorted(part["x"].unique())
            chosen = xs if count <= slots else _nearest_in_turn(xs, part["_lo"].iloc[0], part["_hi"].iloc[0], slots)
            kept.append(part[part["x"].isin(chosen)].drop_duplicates("x"))
        out = pd.concat(kept).sort_values("x")
        return out[[key, "x", "y"]].rename(columns={"x": x, "y": y})

    return near.groupBy(key).applyInPandas(choose, schema)


def top_bars(df: DataFrame, label: str, value: str, n: int = 10) -> DataFrame:
    """Largest rows with their share of the largest value."""
    top = df.orderBy(F.col(value).desc(), F.col(label).asc()).limit(n)
    # n rows at most
    return top.withColumn("share", F.col(value) / F.max(value).over(Window.partitionBy()))


def long_to_wide(df: DataFrame, x: str, series: str, value: str, names: list[str]) -> DataFrame:
    """One column per named series; naming them saves a scan for the distinct values."""
    return df.groupBy(x).pivot(series, names).agg(F.sum(value))


def column_range(df: DataFrame, column: str) -> DataFrame:
    v = finite(F.col(column))
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"))


def matches_threshold(c: Column, operator: str, bound: float) -> Column:
    v = finite(c)
    test = {
        ">=": lambda: v >= bound,
        ">": lambda: v > bound,
        "<=": lambda: v <= bound,
        "<": lambda: v < bound,
        "=": lambda: v == bound,
    }[operator]()
    return F.coalesce(test, F.lit(False))


def matches_text(c: Column, operator: str, wanted: str | list[str]) -> Column:
    text = c.cast("string")
    test = {
        "equals": lambda: text == wanted,
        "in": lambda: text.isin(list(wanted)),
        "like": lambda: F.contains(F.lower(text), F.lit(wanted.lower())),
    }[operator]()
    return F.coalesce(test, F.lit(False))


def scale_ratio(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Position of each value between the bounds, 0..1; 1 on a flat range; given bounds win."""
    v = finite(F.col(column))
    lo = F.lit(low) if low is not None else df.agg(F.min(v)).scalar()
    hi = F.lit(high) if high is not None else df.agg(F.max(v)).scalar()
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - lo, hi - lo)))
    return df.withColumn("ratio", F.when(v.isNotNull(), F.when(lo == hi, 1.0).otherwise(ratio)))
