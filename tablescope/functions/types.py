"""Column classification from Spark data types (never from type-name substrings)."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_TYPES = (*INTEGER_TYPES, T.FloatType, T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
COMPLEX_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, INTEGER_TYPES)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC_TYPES)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, DATE_TYPES)


def is_complex(t: T.DataType) -> bool:
    return isinstance(t, COMPLEX_TYPES)


def has_numeric_stats(field: T.StructField) -> bool:
    """Numeric statistics apply, except to integer foreign keys named ``*_id`` (``id`` itself counts)."""
    if not is_numeric(field.dataType):
        return False
    name = field.name.lower()
    return not (is_integer(field.dataType) and name.endswith("_id") and name != "id")


def type_label(field: T.StructField) -> str:
    return field.dataType.simpleString() + ("" if field.nullable else " NOT NULL")
