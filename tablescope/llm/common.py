"""Helpers the operators of this package share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these: the space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever the number of its uses.

    Inside lambda functions Spark evaluates an outer expression anew for each element; a lambda's own
    argument is a value.
    """
    return F.transform(F.array(value), body)[0]


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def span_columns(df: DataFrame, base: Iterable[str], spans: str = "spans") -> DataFrame:
    """Count columns per base kind, the digest of the base spans and all spans as text.

    ``spans`` is an array of ``struct<kind,start,end>`` in order of start and listed kind.
    """
    base = list(base)
    found = F.col(spans)

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select(
        "doc_id",
        *map(count, base),
        F.sha2(span_text(F.filter(found, lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        span_text(found).alias("spans"),
    )


class _Packed:
    """Bytes that are put together again as they are read, so that a worker does not hold them beside the object."""

    def __init__(self, packed: bytes):
        self.packed = packed

    def __reduce__(self):
        return pickle.loads, (self.packed,)


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of a class of this library, with the class, so that workers need not have the package."""
    return spark.sparkContext.broadcast(_Packed(cloudpickle.dumps(value)))


def received(sent: Broadcast):
    """What ``send`` sent, put together once per worker."""
    return sent.value
