"""Profiles of partitioned tables from stored statistics that merge: a new partition costs one scan of itself.

A table of statistics has one row per partition and column: counts, bounds, mean, sum of squared deviations and a sketch
of distinct values. It can be written as it is; ``merge_statistics`` makes the table's profile of it without a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.types import has_numeric_stats, is_complex, is_date, type_label
from tablescope.operators.profile import date_text, distinct_counts, percentage, value_counts, value_text

#: Base-2 logarithm of the sketch's registers: 4,096 of them, an error of about 1.6%; counts of some hundred are exact.
SKETCH_SIZE = 12


def partition_statistics(df: DataFrame, partition: Column, sketch_size: int = SKETCH_SIZE) -> DataFrame:
    """``part, column, type, total, filled, min, max, mean, deviation, min_date, max_date, sketch`` in one scan of ``df``.

    ``partition`` names the partition of a row; null is one of its own. Rows are merged inside every map task, so a
    partition with a third of the table shuffles as little as another. Complex columns have counts only, an empty
    table no rows.
    """
    aggs, rows = [F.count(F.lit(1)).alias("total")], []
    nothing, no_text, no_sketch = (F.lit(None).cast(t) for t in ("double", "string", "binary"))
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        numeric, dated, plain = has_numeric_stats(f), is_date(f.dataType), not is_complex(f.dataType)
        if numeric:
            d = c.cast("double")
            aggs += [F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.avg(d).alias(f"mean{i}"), F.var_pop(d).alias(f"var{i}")]
        elif dated:
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if plain:
            value = F.base64(c) if isinstance(f.dataType, T.BinaryType) else value_text(f)
            # the sketch passes over empty strings, so a sign goes before each value
            aggs.append(F.hll_sketch_agg(F.concat(F.lit("="), value), sketch_size).alias(f"sketch{i}"))
        rows.append(F.struct(
            F.lit(f.name).alias("column"),
            F.lit(type_label(f).removesuffix(" NOT NULL")).alias("type"),
            F.col("total").alias("total"),
            F.col(f"n{i}").alias("filled"),
            (F.col(f"lo{i}") if numeric else nothing).alias("min"),
            (F.col(f"hi{i}") if numeric else nothing).alias("max"),
            (F.col(f"mean{i}") if numeric else nothing).alias("mean"),
            (F.col(f"var{i}") * F.col(f"n{i}") if numeric else nothing).alias("deviation"),
            (date_text(F.col(f"lo{i}"), f.dataType) if dated else no_text).alias("min_date"),
            (date_text(F.col(f"hi{i}"), f.dataType) if dated else no_text).alias("max_date"),
            (F.col(f"sketch{i}") if plain else no_sketch).alias("sketch"),
        ))
    by_part = df.groupBy(partition.alias("part")).agg(*aggs)
    return by_part.select("part", F.inline(F.array(*rows)))


def refresh_statistics(stored: DataFrame, df: DataFrame, partition: Column, parts: DataFrame) -> DataFrame:
    """``stored`` less the partitions that are gone, with the statistics of those it lacks.

    ``parts`` is partition metadata with one row per partition, ``part``. Only rows of new partitions are read: their
    ids, as many as a listing of the table's folders gives, become a predicate on ``partition`` that prunes files.
    """
    known = stored.select("part").distinct()
    same = parts["part"].eqNullSafe(known["part"])
    new = [r["part"] for r in parts.join(known, same, "left_anti").distinct().collect()]
    kept = stored.join(parts.select(F.col("part").alias("_part")).distinct(), F.col("part").eqNullSafe(F.col("_part")), "left_semi")
    if not new:
        return kept
    named = [p for p in new if p is not None]
    wanted = partition.isin(named) if named else F.lit(False)
    if None in new:
        wanted = wanted | partition.isNull()
    return kept.unionByName(partition_statistics(df.filter(wanted), partition))


def merge_statistics(stored: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """One row per column, shaped as a table's profile without top values.

    Deviations are taken about the common mean, so large values lose no digits. ``distinct_count`` is the estimate of the
    merged sketches, null for complex columns; with ``exact``, the whole table, it is counted instead.
    """
    weighted = F.sum(F.col("mean") * F.col("filled")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("filled")))
    totals = stored.groupBy("column").agg(
        F.max("type").alias("type"),
        F.sum("total").alias("total_count"),
        F.sum(F.col("total") - F.col("filled")).alias("null_count"),
        F.sum("filled").alias("filled_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
        F.count("sketch").alias("sketches"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        weighted.alias("_mean"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
    )
    about = stored.select("column", "filled", "mean", "deviation").join(totals.select("column", "_mean"), "column")
    apart = F.col("mean") - F.col("_mean")
    spread = about.groupBy("column").agg(F.sum(F.col("deviation") + F.col("filled") * apart * apart).alias("_deviation"))
    out = totals.join(spread, "column").select(
        "column",
        "type",
        "total_count",
        "null_count",
        percentage(F.col("null_count"), F.col("total_count")).alias("null_percentage"),
        F.when(F.col("sketches") > 0, F.col("estimate")).alias("distinct_count"),
        "min",
        "max",
        F.round("_mean", 4).alias("mean"),
        F.round(F.sqrt(F.try_divide(F.col("_deviation"), F.col("filled_count"))), 4).alias("stddev"),
        "min_date",
        "max_date",
    )
    if exact is None:
        return out
    counted = distinct_counts(value_counts(exact))
    return out.drop("distinct_count").join(counted, "column", "left").withColumn(
        "distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long"))
    )
