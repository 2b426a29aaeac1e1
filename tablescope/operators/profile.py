"""Table profiling: scalar statistics in one scan, value counts in one stacked aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.types import has_numeric_stats, is_complex, is_date, is_numeric, type_label
from tablescope.operators.ordered import top_per_key

TOP_VALUES = 10
TOP_VALUES_MAX_DISTINCT = 50


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def list_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column: position, name, type, nullable, description."""
    rows = [
        (table, i, f.name, type_label(f), f.nullable, (f.metadata or {}).get("comment"))
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return next(iter(tables.values())).sparkSession.createDataFrame(
        rows, "table_name string, position int, name string, type string, nullable boolean, description string"
    )


def preview(df: DataFrame, limit: int = 10, order: list[Column] | None = None) -> DataFrame:
    """First rows with values a JSON reader cannot hold turned to text."""
    picked = (df.orderBy(*order) if order else df).limit(limit)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if is_date(f.dataType):
            c = date_text(c, f.dataType)
        elif is_complex(f.dataType) and not isinstance(f.dataType, T.ArrayType):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.decode(c, "UTF-8")
        cols.append(c.alias(f.name))
    return picked.select(*cols)


def date_text(c: Column, t: T.DataType) -> Column:
    """ISO text; a date gets a midnight time."""
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd 00:00:00")
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def null_count(c: Column) -> Column:
    return F.count(F.lit(1)) - F.count(c)


def percentage(part: Column, total: Column) -> Column:
    """Share in percent, two decimals, null for an empty table."""
    return F.round(F.try_divide(part.cast("double"), total.cast("double")) * 100, 2)


def _stat_columns(df: DataFrame) -> list[T.StructField]:
    return list(df.schema.fields)


def scalar_statistics(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Null count, bounds, mean and population deviation of every column, in a single scan."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, f in enumerate(_stat_columns(df)):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        if has_numeric_stats(f):
            d = c.cast("double")
            aggs += [
                F.min(d).alias(f"lo{i}"),
                F.max(d).alias(f"hi{i}"),
                F.avg(d).alias(f"mean{i}"),
                F.stddev_pop(d).alias(f"sd{i}"),
            ]
        elif is_date(f.dataType):
            aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
        if approx_distinct and not is_complex(f.dataType):
            aggs.append(F.approx_count_distinct(c).alias(f"d{i}"))
    one = df.agg(*aggs)

    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = []
    for i, f in enumerate(_stat_columns(df)):
        numeric, dated = has_numeric_stats(f), is_date(f.dataType)
        nulls = F.col("total") - F.col(f"n{i}")
        fields = [
            F.lit(f.name).alias("column"),
            F.lit(type_label(f).removesuffix(" NOT NULL")).alias("type"),
            F.col("total").alias("total_count"),
            nulls.alias("null_count"),
            percentage(nulls, F.col("total")).alias("null_percentage"),
            (F.col(f"lo{i}") if numeric else nothing).alias("min"),
            (F.col(f"hi{i}") if numeric else nothing).alias("max"),
            (F.round(f"mean{i}", 4) if numeric else nothing).alias("mean"),
            (F.round(f"sd{i}", 4) if numeric else nothing).alias("stddev"),
            (date_text(F.col(f"lo{i}"), f.dataType) if dated else no_text).alias("min_date"),
            (date_text(F.col(f"hi{i}"), f.dataType) if dated else no_text).alias("max_date"),
        ]
        if approx_distinct:
            approx = F.lit(None).cast("long") if is_complex(f.dataType) else F.col(f"d{i}")
            fields.append(approx.alias("approx_distinct"))
        rows.append(F.struct(*fields))
    return one.select(F.inline(F.array(*rows)))


def value_text(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0).cast(f.dataType)  # 0.0 and -0.0 are one value
    return c.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, cnt, plain) of the chosen columns; arrays count their elements, and null counts in plain ones only.

    Stacking then grouping merges equal values inside every map task, so a value held by a third of
    the rows reaches the shuffle as one row per task.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    complex_names = [f.name for f in fields if is_complex(f.dataType)]
    plain = [f for f in fields if not isinstance(f.dataType, T.ArrayType)]
    arrays = [f for f in fields if isinstance(f.dataType, T.ArrayType)]
    parts = []
    if plain:
        pairs = [F.struct(F.lit(f.name).alias("column"), value_text(f).alias("value")) for f in plain]
        parts.append(df.select(F.inline(F.array(*pairs))))
    for f in arrays:
        item = F.explode(F.col(f"`{f.name}`")).alias("value")
        items = df.select(item).select(F.lit(f.name).alias("column"), F.col("value").cast("string"))
        parts.append(items.filter(F.col("value").isNotNull()))
    if not parts:
        parts.append(df.sparkSession.createDataFrame([], "column string, value string"))
    stacked = reduce(DataFrame.unionByName, parts)
    plain_column = ~F.col("column").isin(complex_names or [""])
    counted = stacked.filter(plain_column | F.col("value").isNotNull()).groupBy("column", "value")
    return counted.agg(F.count(F.lit(1)).alias("cnt")).withColumn("plain", plain_column)


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Exact distinct non-null values per column from ``value_counts``."""
    return counts.groupBy("column").agg(F.count("value").alias("distinct_count"))


def top_values(counts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Ten most frequent values per column. Null and '' of plain columns go after the cut; complex columns
    have no null here, and '' is an element like any other.

    ``columns`` names those that passed the gate of 1..50 distinct values.
    """
    if columns is not None:
        counts = counts.filter(F.col("column").isin(columns or [""]))
    ranked = top_per_key(
        counts, ["column"], [F.col("cnt").desc(), F.col("value").asc_nulls_last()], TOP_VALUES, "rank"
    )
    return ranked.filter(F.col("value").isNotNull() & ((F.col("value") != "") | ~F.col("plain"))).drop("plain")


def few_valued(distinct: DataFrame, most: int = TOP_VALUES_MAX_DISTINCT) -> list[str]:
    """Columns whose top values are worth showing (the input has one row per column)."""
    gate = F.col("distinct_count").between(1, most)
    return [r["column"] for r in distinct.filter(gate).collect()]


def top_values_text(ranked: DataFrame) -> DataFrame:
    """One row per column with its top values as an array of (value, count), best first."""
    packed = ranked.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "cnt"))).alias("v")
    )
    return packed.select(
        "column",
        F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["cnt"].alias("count"))).alias(
            "top_values"
        ),
    )


def readable_columns(df: DataFrame) -> list[str]:
    """Columns that can be computed on every row, tried one by one."""
    found = []
    for name in df.columns:
        try:
            df.select(F.xxhash64(F.to_json(F.struct(F.col(f"`{name}`")))).alias("h")).agg(F.max("h")).collect()
        except PySparkException:
            continue
        found.append(name)
    return found


def profile_table(
    df: DataFrame, approx_distinct: bool = False, most_values: int = TOP_VALUES_MAX_DISTINCT, window: Column | None = None
) -> DataFrame:
    """As ``_profile``; a column that fails to compute is left out instead of ending the profile of the others.

    ``window`` is a predicate that keeps the rows to profile, such as ``recent_partition_filter``.
    """
    if window is not None:
        df = df.filter(window)
    try:
        return _profile(df, approx_distinct, most_values)
    except PySparkException:
        good = readable_columns(df)
        if not good or len(good) == len(df.columns):
            raise
        return _profile(df.select(*[F.col(f"`{c}`") for c in good]), approx_distinct, most_values)


def _profile(df: DataFrame, approx_distinct: bool, most_values: int) -> DataFrame:
    """One row per column with counts, bounds, moments, distinct count and top values.

    Columns of up to ``most_values`` distinct values have top values; of others they are null.

    Exact distinct counts shuffle every distinct value once. ``approx_distinct`` replaces that with a
    sketch in the scalar scan, exact only where the sketch says there are few values. Either way the gate
    is read first (one row per column), so top values are counted for few-valued columns alone and
    shuffle next to nothing.
    """
    spark = df.sparkSession
    stats = scalar_statistics(df, approx_distinct)
    gated = [f.name for f in df.schema.fields if not (is_numeric(f.dataType) or is_date(f.dataType))]
    if approx_distinct:
        rows = stats.collect()
        stats = spark.createDataFrame(rows, stats.schema)
        # the sketch error is 5%, so its gate is wider than the exact one
        low = {r["column"] for r in rows if (r["approx_distinct"] or 0) <= 2 * most_values}
        counted = value_counts(df, sorted(low))
    else:
        counted = value_counts(df)
    found = distinct_counts(counted).collect()
    distinct = spark.createDataFrame(found, "column string, distinct_count long")
    few = {r["column"] for r in found if 1 <= r["distinct_count"] <= most_values}
    shown = [c for c in gated if c in few]
    out = stats.join(distinct, "column", "left")
    if shown:
        out = out.join(top_values_text(top_values(value_counts(df, shown))), "column", "left")
    else:
        out = out.withColumn("top_values", F.lit(None).cast("array<struct<value:string,count:long>>"))
    if approx_distinct:
        out = out.withColumn("distinct_count", F.coalesce("distinct_count", "approx_distinct")).drop(
            "approx_distinct"
        )
    return out.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long")))


def recent_partition_filter(column: Column, as_of: Column, days: int = 30) -> Column:
    """Keep the profiling window; on a partition column this prunes files."""
    return column >= F.date_sub(as_of.cast("date"), days)


def partition_summary(parts: DataFrame, table: str, partition: str, rows: str) -> DataFrame:
    """Per table: newest two partition ids, the safe (closed) one and all rows.

    ``parts`` is partition metadata: one row per partition.
    """
    newest = top_per_key(parts.select(table, partition), [table], [F.col(partition).desc()], 2)
    picked = newest.groupBy(table).agg(
        F.max(F.when(F.col("rank") == 1, F.col(partition))).alias("latest"),
        F.max(F.when(F.col("rank") == 2, F.col(partition))).alias("previous"),
    )
    total = parts.groupBy(table).agg(F.sum(rows).alias("total_rows"))
    return total.join(picked, table).select(
        table, "latest", F.coalesce("previous", "latest").alias("safe_partition"), "total_rows"
    )


def closed_partition_filter(column: Column, dtype: T.DataType, partition_id: str) -> Column:
    """Predicate for one partition id: YYYY, YYYYMM, YYYYMMDD or YYYYMMDDHH, else integer, else not null."""
    units = {4: "YEAR", 6: "MONTH", 8: "DAY", 10: "HOUR"}
    if is_date(dtype) and partition_id.isdigit() and len(partition_id) in units:
        start = F.to_timestamp(F.lit(partition_id), "yyyyMMddHH"[: len(partition_id)])
        end = start + F.expr(f"INTERVAL 1 {units[len(partition_id)]}")
        # a half-open range on the bare column, in its own type, reaches the scan as a pushed filter
        return (column >= start.cast(dtype)) & (column < end.cast(dtype))
    if partition_id.lstrip("-").isdigit():
        return column == F.lit(int(partition_id))
    return column.isNotNull()


def metadata_row_count(parts: DataFrame, rows: str) -> DataFrame:
    """Row count from partition metadata, without a table scan."""
    return parts.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("row_count"))


def profile_many(
    tables: dict[str, DataFrame], approx_distinct: bool = False, windows: dict[str, Column] | None = None
) -> DataFrame:
    """Profiles of several tables, stacked under ``table``; ``windows`` has predicates of rows to profile, by table."""
    parts = [
        profile_table(df, approx_distinct, window=(windows or {}).get(name)).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def refresh_due(state: DataFrame, policy: str, interval_days: str, computed_at: str, as_of: Column) -> DataFrame:
    """Flag ``should_refresh``: never computed or ``always``; ``once`` no more; ``interval`` after n days."""
    due = (
        F.when(F.col(computed_at).isNull(), True)
        .when(F.col(policy) == "always", True)
        .when(F.col(policy) == "once", False)
        .otherwise(
            as_of.cast("timestamp") >= F.col(computed_at).cast("timestamp") + F.make_dt_interval(F.col(interval_days))
        )
    )
    return state.withColumn("should_refresh", due)


