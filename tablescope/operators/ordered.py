"""Ordered computations that do not pull a whole key into one task.

A plain window over ``partitionBy(key).orderBy(t)`` sorts all rows of a key in one task, so a key with
a third of the table becomes the job. Here each key is cut into chunks of the order column. Rows are
scanned inside ``(key, chunk)``; one small row per chunk carries the state across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.sources.shared import cut_lineage

CHUNK = "_chunk"

#: Rows that a chunk should hold, about, and chunks of a key at most.
CHUNK_ROWS, MOST_CHUNKS = 100_000, 1024
#: Precision of the sketches of keys: at 2048 a rank is off by some 0.1% of a key's rows.
SKETCH_K = 2048

AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def time_chunk(column: str | Column, seconds: int = 3600) -> Column:
    """Chunk number of a timestamp column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(F.unix_seconds(column.cast("timestamp")) / F.lit(seconds)).cast("long")


def number_chunk(column: str | Column, width: float) -> Column:
    """Chunk number of a numeric column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(width)).cast("long")


def even_chunk(df: DataFrame, column: str, chunks: int = 1000) -> Column:
    """Chunk number from the column's own range, read by a scalar subquery (no join, no driver trip)."""
    value = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    width = F.greatest((span["high"] - span["low"]) / F.lit(chunks), F.lit(1e-9))
    return F.floor((value - span["low"]) / width).cast("long")


def whole_number(df: DataFrame, column: str) -> Column:
    """A column as a whole number in the same order: times in microseconds."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.floor(F.col(column)).cast("long")


def with_chunks(
    df: DataFrame, keys: list[str], column: str, rows: int = CHUNK_ROWS, name: str = CHUNK, most: int = MOST_CHUNKS
) -> DataFrame:
    """Add a chunk number that rises with ``column`` so that a key's chunks hold about ``rows`` rows each, however dense it is.

    One aggregate keeps a mergeable quantile sketch per key; keys of more than ``rows`` rows get borders from it. There are
    fewer borders than one for each ``rows`` rows of the table, and they are broadcast. Equal values share a chunk, whatever their number;
    nulls are in the first.
    """
    value = whole_number(df, column)
    of_key = F.struct(F.lit(0).alias("_all"), *[F.col(k) for k in keys])
    sketches = df.groupBy(of_key.alias("_key")).agg(F.kll_sketch_agg_bigint(value, SKETCH_K).alias("_sketch"))
    held = F.kll_sketch_get_n_bigint("_sketch")
    parts = F.least(F.ceil(held / rows), F.lit(most)).cast("int")
    # ranks must be constants: all of them for the dense keys, of which as many are kept as there are chunks
    ranks = F.array(*[F.lit(i / most) for i in range(1, most)])
    dense = sketches.filter(held > rows).select("_key", parts.alias("_parts"), F.kll_sketch_get_quantile_bigint("_sketch", ranks).alias("_all"))
    kept = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.get("_all", F.floor(i * most / F.col("_parts")).cast("int") - 1))
    dense = dense.select(F.col("_key").alias("_dense"), F.array_sort(F.array_distinct(kept)).alias("_borders"))
    joined = df.withColumn("_key", of_key).join(F.broadcast(dense), F.col("_key").eqNullSafe(F.col("_dense")), "left")
    # two steps of some 32 comparisons, not one of a thousand
    step = 32
    coarse = F.filter("_borders", lambda b, i: (i % step == step - 1) & (b < value))
    begin = F.size(coarse) * step
    fine = F.size(F.filter(F.slice("_borders", begin + 1, F.lit(step - 1)), lambda b: b < value))
    chunk = F.when(F.col("_borders").isNull() | value.isNull(), 0).otherwise(begin + fine)
    return joined.withColumn(name, chunk.cast("long")).drop("_key", "_dense", "_borders")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | int,
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    backward: bool = False,
) -> DataFrame:
    """Running aggregates per key in ``order``; ``specs`` maps output name to (kind, expression).

    Kinds are sum, max, min, xor and ``last``, the newest non-null expression (wrap it in a struct to carry a
    null inside). ``chunk`` is a chunk number that rises with the order, or the number of rows that chunks should
    hold, borders then come from a sketch of the first order column. ``inclusive`` says whether the current row counts; ``backward`` runs from the last row
    to the first.

    Every chunk gets one head row holding the state carried into it, so the rows themselves are
    shuffled once, by key and chunk, and no join is needed.
    """
    asc = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    chunk_order = F.col(CHUNK).desc() if backward else F.col(CHUNK).asc()
    chunked = with_chunks(df, keys, order[0], chunk) if isinstance(chunk, int) else df.withColumn(CHUNK, chunk)
    rows = chunked.withColumns({f"_in_{name}": expr for name, (_, expr) in specs.items()})

    order_key = F.struct(*[F.col(c) for c in order])
    newest = F.min_by if backward else F.max_by
    totals, carries = [], []
    before = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in specs.items():
        column = f"_in_{name}"
        if kind == "last":
            total = newest(column, F.when(F.col(column).isNotNull(), order_key))
            carry = F.last(column, ignorenulls=True)
        else:
            total, carry = AGGREGATES[kind](column), AGGREGATES[kind](column)
        totals.append(total.alias(column))
        carries.append(carry.over(before).alias(column))
    # one row per key and chunk from here, merged inside the map tasks before the shuffle
    heads = rows.groupBy(*keys, CHUNK).agg(*totals).select(*keys, CHUNK, *carries, F.lit(True).alias("_head"))

    both = rows.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(F.col("_head").desc(), *asc)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = {}
    for name, (kind, _) in specs.items():
        column = f"_in_{name}"
        agg = F.last(column, ignorenulls=True) if kind == "last" else AGGREGATES[kind](column)
        out[name] = agg.over(frame)
    scanned = both.withColumns(out).filter(~F.col("_head"))
    return scanned.drop(CHUNK, "_head", *[f"_in_{n}" for n in specs])


def neighbours(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, columns: list[str]
) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>``: the value in the row before and after, nulls included."""
    box = {f"_box_{c}": ("last", F.struct(F.col(c).alias("v"))) for c in columns}
    out = running(df, keys, order, chunk, box, inclusive=False)
    out = out.withColumns({f"prev_{c}": F.col(f"_box_{c}.v") for c in columns}).drop(*box)
    out = running(out, keys, order, chunk, box, inclusive=False, backward=True)
    return out.withColumns({f"next_{c}": F.col(f"_box_{c}.v") for c in columns}).drop(*box)


def with_row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Global row number 1..n in ``order`` from a distributed sort.

    A tie-break by a hash of the row is added so that a value held by a third of the rows spreads over many range
    partitions, and a task that runs again deals its rows out alike. The sorted rows are written once, so numbers
    stay the same too.
    """
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    tied = df.withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0))
    placed = tied.orderBy(*order, "_tie").withColumn("_place", F.monotonically_increasing_id()).drop("_tie")
    placed = cut_lineage(placed, "rownum")
    # Spark documents the id as partition << 33 | position
    part = F.shiftright("_place", 33)
    placed = placed.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per sort partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # the offsets are as many as sort partitions, whatever the size of the data
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position + 1)
        .drop("_part", "_place", "_offset")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark keep n rows per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
