"""Access to stored results: paging, output cleaning, summaries, sorting, display text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.text import finite, natural_key, text_number, title_label
from tablescope.functions.types import is_complex, is_date, is_integer, is_numeric
from tablescope.operators.ordered import SKETCH_K
from tablescope.sources.shared import cut_lineage

MAX_SAFE_INTEGER = 9007199254740991
PAGE_SIZE = 20
#: Ranges beside those of a page that are looked at, as a sketch errs by less.
MARGIN = 1


def read_page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    """One page in a total order, each row carrying the total row count."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def _place(df: DataFrame, column: str) -> Column:
    """A number that never falls as ``column`` rises; different values may share one."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        # the first six bytes: strings sort by their bytes
        head = F.substring(F.rpad(F.encode(F.col(column), "UTF-8"), 6, F.unhex(F.lit("00"))), 1, 6)
        return F.conv(F.hex(head), 16, 10).cast("double")
    if is_date(kind):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def page_range(
    df: DataFrame, order: list[tuple[str, bool]], offset: int, limit: int, ranges: int = 256, small: int = 10_000
) -> tuple[DataFrame, int]:
    """The rows among which a page lies, and how many of them come before it.

    A sketch cuts the first order column into ``ranges`` ranges; exact counts at the few borders next to the page, the
    only numbers the driver reads, tell between which of them it lies. Those rows are cut again until they are ``small`` rows
    beside the page; where all are of one value, by the next column. Once they are few of those read, they are written.
    """
    skip, read = offset, None
    for column, ascending in order:
        while True:
            place = _place(df, column)
            ranks = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
            seen = df.agg(
                F.count(F.lit(1)).alias("n"), F.count(column).alias("known"), F.kll_sketch_agg_double(place, SKETCH_K).alias("s"),
                F.min(column).eqNullSafe(F.max(column)).alias("single"),
            )
            some = F.kll_sketch_get_n_double("s") > 0
            seen = seen.select("n", "known", "single", F.when(some, F.kll_sketch_get_quantile_double("s", ranks)).alias("borders")).first()
            n, nulls, read = seen.n, seen.n - seen.known, read or seen.n
            if skip >= n:
                return df.limit(0), skip
            if n <= small + limit:
                return df, skip
            if seen.single and seen.known in (0, n):
                break  # by the next column
            # the page's rows, counted upwards; nulls sort before everything
            begin, end = (skip, min(skip + limit, n)) if ascending else (max(n - skip - limit, 0), n - skip)
            first, last = (math.floor((at - nulls) / max(seen.known, 1) * ranges) for at in (begin, end))
            near = sorted({b for i, b in enumerate(seen.borders or [], 1) if first - MARGIN <= i <= last + 1 + MARGIN})
            cuts = [F.coalesce(before, F.lit(True)) for b in near for before in (place < b, place <= b)] + [F.col(column).isNull()]
            below = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
            low, before = max(((k, c) for k, c in zip(below, cuts) if k <= begin), key=lambda x: x[0], default=(0, F.lit(False)))
            high, upto = min(((k, c) for k, c in zip(below, cuts) if k >= end), key=lambda x: x[0], default=(n, F.lit(True)))
            if high - low == n:
                return df, skip
            df = df.filter(~before & upto)
            skip -= low if ascending else n - high
            if (high - low) * 8 <= read:
                df, read = cut_lineage(df, "page"), high - low
            if high - low <= small + limit:
                return df, skip
    return df, skip


def deep_page(
    df: DataFrame, order: list[tuple[str, bool]], offset: int, limit: int = PAGE_SIZE, ranges: int = 256, small: int = 10_000
) -> DataFrame:
    """One page however far down a total order of columns, each with whether it ascends, and the total row count.

    Only the ranges that the page lies in are sorted, so no task holds all rows before it. Nulls are first where a column
    ascends and last where it descends.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows, skip = page_range(df, order, offset, limit, ranges, small)
    by = [F.col(c).asc() if ascending else F.col(c).desc() for c, ascending in order]
    return rows.orderBy(*by).offset(skip).limit(limit).withColumn("total", total)


def limit_reached(df: DataFrame, limit: int) -> DataFrame:
    """Whether a result capped at ``limit`` is (or may be) cut: looks at no more than ``limit`` rows."""
    return df.limit(limit).agg((F.count(F.lit(1)) >= limit).alias("limit_reached"))


def clean_for_output(df: DataFrame) -> DataFrame:
    """Values any JSON reader can hold: non-finite to null, decimal to double, bytes to text, dates to ISO."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = finite(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(
                F.make_valid_utf8(c.cast("string"))
            )
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif is_date(f.dataType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def split_safe_integer(df: DataFrame, column: str) -> DataFrame:
    """An integer beyond 2^53-1 stays text: ``<c>`` holds the exact number, ``<c>_text`` the others."""
    c = F.col(column)
    safe = F.abs(c) <= MAX_SAFE_INTEGER
    return df.withColumn(f"{column}_text", F.when(~safe, c.cast("string"))).withColumn(column, F.when(safe, c))


def _as_number(f: T.StructField) -> Column | None:
    c = F.col(f"`{f.name}`")
    if is_numeric(f.dataType):
        return finite(c)
    if isinstance(f.dataType, T.StringType):
        return text_number(F.replace(c, F.lit(","), F.lit("")))
    return None


def numeric_summaries(df: DataFrame) -> DataFrame:
    """min, max, avg, sum and count per column over the values that parse; one scan."""
    numbers = {f.name: n for f in df.schema.fields if (n := _as_number(f)) is not None}
    aggs = []
    for i, n in enumerate(numbers.values()):
        aggs += [
            F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.avg(n).alias(f"mean{i}"),
            F.sum(n).alias(f"sum{i}"), F.count(n).alias(f"n{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.col(f"mean{i}").alias("avg"), F.col(f"sum{i}").alias("sum"), F.col(f"n{i}").alias("count"),
        )
        for i, name in enumerate(numbers)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows))).filter(F.col("count") > 0)


def column_kinds(df: DataFrame) -> DataFrame:
    """Kind of each column from its non-null values: numeric, boolean, string or null."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        numeric, kind = F.lit(is_numeric(f.dataType)), None
        if isinstance(f.dataType, T.StringType):
            numeric, kind = F.when(c.isNotNull(), text_number(c).isNotNull()), "string"
        elif isinstance(f.dataType, T.BooleanType):
            kind = "boolean"
        elif is_date(f.dataType):
            kind = "string"
        aggs += [F.count(c).alias(f"n{i}"), F.bool_and(numeric).alias(f"num{i}")]
        label = F.when(F.col(f"n{i}") == 0, None).when(F.col(f"num{i}"), "numeric").otherwise(F.lit(kind))
        rows.append(F.struct(F.lit(f.name).alias("column"), label.alias("kind")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def sort_columns(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """Sort keys of a table column: nulls last either way, text numeric-aware and case-insensitive."""
    f = df.schema[column]
    key = natural_key(F.col(column)) if isinstance(f.dataType, T.StringType) else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last()]


def sort_table(df: DataFrame, column: str, descending: bool = False, tie_break: list[str] = ()) -> DataFrame:
    return df.orderBy(*sort_columns(df, column, descending), *tie_break)


def label_columns(df: DataFrame) -> DataFrame:
    """Rename ``order_total`` to ``Order Total``."""
    labels = [" ".join(w[:1].upper() + w[1:] for w in c.replace("_", " ").split()) for c in df.columns]
    return df.toDF(*labels)


def cell_text(df: DataFrame, date_pattern: str = "dd/MM/yyyy") -> DataFrame:
    """Every cell as display text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            text = F.when(c, "TRUE").otherwise("FALSE")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = finite(c).cast("string")
        elif is_integer(f.dataType):
            text = c.cast("string")
        elif is_date(f.dataType):
            text = F.date_format(c, date_pattern)
        elif is_complex(f.dataType):
            text = F.to_json(c)
        elif isinstance(f.dataType, T.StringType):
            iso = F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), c))
            text = F.coalesce(F.date_format(iso, date_pattern), c)
        else:
            text = c.cast("string")
        out.append(F.coalesce(F.when(c.isNotNull(), text), F.lit("NULL")).alias(f.name))
    return df.select(*out)


def labels_frame(names: DataFrame, column: str) -> DataFrame:
    return names.withColumn("label", title_label(F.col(column)))
