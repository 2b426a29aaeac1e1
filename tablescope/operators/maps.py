"""Map data shaping: points, bounds, scaled measures and region joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.text import finite, text_number
from tablescope.operators.ordered import neighbours, number_chunk

# fixed values: the Web-Mercator latitude limit and the point count above which a map is cut
MAX_LATITUDE = 85.051129
MAX_POINTS = 5000


def as_number(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return text_number(c) if isinstance(df.schema[column].dataType, T.StringType) else finite(c)


def map_points(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows whose coordinates parse and fit the projection, with ``latitude`` and ``longitude``."""
    pointed = df.withColumns({"latitude": as_number(df, lat), "longitude": as_number(df, lon)})
    return pointed.filter((F.abs("latitude") <= MAX_LATITUDE) & (F.abs("longitude") <= 180))


def map_bounds(points: DataFrame) -> DataFrame:
    """Smallest box around the points: it opens at the largest longitude gap, so east may pass 180."""
    lons = points.select("longitude").distinct()
    first = lons.agg(F.min("longitude")).scalar()
    gaps = neighbours(lons, [], ["longitude"], number_chunk("longitude", 0.1), ["longitude"])
    wraps = F.col("next_longitude").isNull()
    gap = F.when(wraps, first + 360 - F.col("longitude")).otherwise(F.col("next_longitude") - F.col("longitude"))
    # equal gaps: the wrap-around wins, then the westernmost
    best = F.max_by(
        F.struct(
            F.when(wraps, first).otherwise(F.col("next_longitude")).alias("west"),
            F.when(wraps, F.col("longitude")).otherwise(F.col("longitude") + 360).alias("east"),
        ),
        F.struct(gap, wraps, -F.col("longitude")),
    )
    box = gaps.agg(best.alias("b")).filter(F.col("b").isNotNull())
    south = points.agg(F.min("latitude")).scalar()
    north = points.agg(F.max("latitude")).scalar()
    return box.select("b.west", south.alias("south"), "b.east", north.alias("north"))


def point_report(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Kept and dropped row counts, and whether a map would be cut."""
    y, x = as_number(df, lat), as_number(df, lon)
    ok = F.coalesce((F.abs(y) <= MAX_LATITUDE) & (F.abs(x) <= 180), F.lit(False))
    kept = F.count_if(ok)
    return df.agg(
        kept.alias("point_count"), F.count_if(~ok).alias("dropped_row_count"), (kept > MAX_POINTS).alias("too_many")
    )


def _ratio(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))


def scale_sqrt(df: DataFrame, column: str, to_low: float, to_high: float, out: str = "scaled") -> DataFrame:
    """Area-true scaling of a measure; missing values get the low end, a flat domain the high end."""
    v = as_number(df, column)
    low, high = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
    scaled = F.lit(to_low) + (F.lit(to_high) - F.lit(to_low)) * F.sqrt(_ratio(v, low, high))
    return df.withColumn(out, F.when(v.isNull(), to_low).when(low == high, to_high).otherwise(scaled))


def scale_linear(df: DataFrame, column: str, to_low: float, to_high: float, out: str = "scaled") -> DataFrame:
    """Linear scaling; missing values count as the domain minimum, a flat domain gives the midpoint."""
    v = as_number(df, column)
    low, high = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
    scaled = F.lit(to_low) + (F.lit(to_high) - F.lit(to_low)) * _ratio(F.coalesce(v, low), low, high)
    middle = (to_low + to_high) / 2
    flat = low.isNull() | (low == high)
    return df.withColumn(out, F.when(flat, middle).otherwise(scaled))


def region_key(c: Column) -> Column:
    """Trimmed lower case; blank becomes null."""
    return F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))


def boundary_index(features: DataFrame, order: str, properties: str, geometry: str,
                   names: list[str] | None = None) -> DataFrame:
    """Region key -> geometry from a map of feature properties; the first feature wins per key."""
    props = F.col(properties)
    if names:
        props = F.map_filter(props, lambda k, _: k.isin(names))
    keys = features.select(F.col(order), F.col(geometry), F.explode(F.map_values(props)).alias("_v"))
    keyed = keys.withColumn("region", region_key(F.col("_v"))).filter(F.col("region").isNotNull())
    return keyed.groupBy("region").agg(F.min_by(geometry, order).alias(geometry))


def region_join(rows: DataFrame, region: str, value: str, index: DataFrame, geometry: str) -> DataFrame:
    """Each row with its geometry and whether it can be shaded."""
    keyed = rows.withColumn("_region", region_key(F.col(region)))
    bounds = index.select(F.col("region").alias("_key"), F.col(geometry).alias("boundary"), F.lit(True).alias("_hit"))
    joined = keyed.join(bounds, F.col("_region") == F.col("_key"), "left")
    ok = F.coalesce(F.col("_hit") & F.col(value).isNotNull(), F.lit(False))
    return joined.withColumn("matched", ok).drop("_region", "_key", "_hit")


def region_report(joined: DataFrame) -> DataFrame:
    return joined.agg(
        F.count_if("matched").alias("region_count"), F.count_if(~F.col("matched")).alias("dropped_row_count")
    )


def inline_geometry(c: Column) -> Column:
    """Geometry type of GeoJSON text, one Feature level unwrapped; null if it is no geometry."""
    parsed = F.trim(c)
    feature = F.get_json_object(parsed, "$.type") == "Feature"
    geometry = F.when(feature, F.get_json_object(parsed, "$.geometry")).otherwise(parsed)
    kind = F.get_json_object(geometry, "$.type")
    body = F.coalesce(F.get_json_object(geometry, "$.coordinates"), F.get_json_object(geometry, "$.geometries"))
    return F.when(body.isNotNull(), kind)


def value_domain(df: DataFrame, value: str, usable: Column) -> DataFrame:
    """Bounds of a measure over the rows that can be drawn."""
    v = as_number(df, value)
    return df.filter(usable).agg(F.min(v).alias("min"), F.max(v).alias("max"))
