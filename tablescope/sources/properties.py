"""Flattening of semi-structured property bags (typed properties per record) to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DATE = "struct<start:string,end:string>"
COMPUTED = f"type:string,string:string,number:string,boolean:string,date:{DATE}"
NAMED = "array<struct<name:string>>"
# the fields a property may carry; scalars are read as text, the way they are written
FIELDS = (
    "type:string,title:array<struct<plain_text:string>>,rich_text:array<struct<plain_text:string>>,number:string,"
    f"select:struct<name:string>,status:struct<name:string>,multi_select:{NAMED},date:{DATE},checkbox:boolean,"
    f"people:{NAMED},files:{NAMED},url:string,email:string,phone_number:string,created_time:string,"
    "last_edited_time:string,created_by:struct<name:string>,last_edited_by:struct<name:string>,"
    "relation:array<struct<id:string>>,has_more:boolean,"
    "place:struct<name:string,address:string,latitude:string,longitude:string>,"
    "verification:struct<state:string,verified_by:struct<name:string>>,"
    f"formula:struct<{COMPUTED}>,unique_id:struct<prefix:string,number:string>"
)
PROPERTY = f"struct<{FIELDS},rollup:struct<{COMPUTED},array:array<struct<{FIELDS}>>>>"


def _names(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.coalesce(i["name"], F.lit(""))), ", ")


def _rich_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.coalesce(i["plain_text"], F.lit(""))), "")


def _date(date: Column) -> Column:
    start, end = F.coalesce(date["start"], F.lit("")), F.coalesce(date["end"], F.lit(""))
    return F.when(end != "", F.concat(start, F.lit(" → "), end)).otherwise(start)


def _computed(c: Column) -> Column:
    """A formula or rollup: its own type says which field holds the value."""
    kind = c["type"]
    return (
        F.when(kind == "date", _date(c["date"]))
        .when(kind == "string", c["string"])
        .when(kind == "number", c["number"])
        .when(kind == "boolean", c["boolean"])
    )


def _pair(first: Column, separator: str, second: Column) -> Column:
    return F.when(first.isNotNull() & second.isNotNull(), F.concat(first, F.lit(separator), second))


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def property_text(p: Column, nested: bool = True) -> Column:
    """Plain text of one parsed property; empty where there is nothing to show."""
    number, prefix = p["unique_id"]["number"], _blank(p["unique_id"]["prefix"])
    place = p["place"]
    named = _blank(F.array_join(F.array(_blank(place["name"]), _blank(place["address"])), ", "))
    spot = _pair(place["latitude"], ", ", place["longitude"])
    state, by = _blank(p["verification"]["state"]), _blank(p["verification"]["verified_by"]["name"])
    linked = F.size(p["relation"])
    kinds = {
        "title": _rich_text(p["title"]),
        "rich_text": _rich_text(p["rich_text"]),
        "number": p["number"],
        "select": p["select"]["name"],
        "status": p["status"]["name"],
        "multi_select": _names(p["multi_select"]),
        "date": _date(p["date"]),
        "checkbox": F.when(p["checkbox"], "true").otherwise("false"),
        "people": _names(p["people"]),
        "files": _names(p["files"]),
        "url": p["url"],
        "email": p["email"],
        "phone_number": p["phone_number"],
        "created_time": p["created_time"],
        "last_edited_time": p["last_edited_time"],
        "created_by": p["created_by"]["name"],
        "last_edited_by": p["last_edited_by"]["name"],
        "relation": F.when(
            linked > 0, F.concat(linked.cast("string"), F.when(p["has_more"], "+ linked").otherwise(" linked"))
        ),
        "place": F.coalesce(named, spot),
        "verification": F.coalesce(_pair(state, " by ", by), state),
        "formula": _computed(p["formula"]),
        "unique_id": F.coalesce(_pair(prefix, "-", number), number),
    }
    if nested:
        rollup = p["rollup"]
        items = F.array_join(F.transform(rollup["array"], lambda i: property_text(i, nested=False)), ", ")
        kinds["rollup"] = F.when(rollup["type"] == "array", items).otherwise(_computed(rollup))
    out = None
    for name, text in kinds.items():
        test = p["type"] == name
        out = F.when(test, text) if out is None else out.when(test, text)
    return F.coalesce(out, F.lit(""))


def with_properties(records: DataFrame, json: str, name: str = "properties") -> DataFrame:
    return records.withColumn(name, F.from_json(json, f"map<string,{PROPERTY}>"))


def collect_columns(records: DataFrame, json: str, order: str) -> DataFrame:
    """Property names over ragged records: the title first, then as first seen.

    Names are merged inside the map tasks, by hash per name and place in the record, as a minimum of structs would sort
    all rows first; the final numbering sees one row per name.
    """
    kinds = records.withColumn("properties", F.from_json(json, "map<string,struct<type:string>>"))
    keys = kinds.select(
        F.col(order), F.posexplode(F.json_object_keys(json)).alias("_pos", "name"), F.col("properties")
    )
    titled = F.coalesce(F.col("properties")[F.col("name")]["type"] == "title", F.lit(False))
    # records without an order are a group of their own: they come before all others
    placed = keys.groupBy("name", "_pos", titled.alias("_is_title"), F.col(order).isNull().alias("_none")).agg(
        F.min(order).alias("_at")
    )
    place = F.struct("_at", "_pos")
    seen = placed.groupBy("name").agg(F.min(place).alias("first"), F.min(F.when(F.col("_is_title"), place)).alias("_title"))
    leads = F.col("_title").isNotNull() & (F.col("_title") == F.min("_title").over(Window.partitionBy()))
    rank = F.row_number().over(Window.orderBy(F.coalesce(leads, F.lit(False)).desc(), "first"))
    return seen.select("name", (rank - 1).alias("position"))


def flatten(records: DataFrame, json: str, names: list[str], keep: list[str]) -> DataFrame:
    """One text column per property name: every property is spelled once, then looked up by name.

    All of it happens inside the row, so there is no shuffle or pivot.
    """
    texts = F.transform_values("properties", lambda _, v: property_text(v))
    rows = with_properties(records, json).withColumn("_texts", texts)
    cells = [F.coalesce(F.try_element_at("_texts", F.lit(n)), F.lit("")).alias(n) for n in names]
    return rows.select(*keep, *cells)
