"""Column catalogs, object globs, column governance and identifier resolution."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob with ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            negated = pattern[i + 1] == "!"
            body = pattern[i + 1 + negated : end]
            # of what a regex gives a meaning in a class, a glob gives one to the range only
            out += "[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def matches_any(name: Column, patterns: list[str], case_insensitive: bool = False) -> Column:
    flag = "(?i)" if case_insensitive else ""
    return reduce(lambda a, b: a | b, [name.rlike(flag + glob_regex(p)) for p in patterns], F.lit(False))


def select_tables(
    tables: DataFrame,
    include: list[str],
    exclude: list[str],
    selection: list[str] | None = None,
    case_insensitive: bool = False,
) -> DataFrame:
    """Catalog rows (schema, table) passing the globs; ``selection`` names tables or whole schemas."""
    full = F.concat_ws(".", "schema", "table")
    keep = matches_any(full, include, case_insensitive) if include else F.lit(True)
    keep = keep & ~matches_any(full, exclude, case_insensitive)
    if selection:
        picked = reduce(lambda a, b: a | b, [(full == s) | (F.col("schema") == s) for s in selection])
        keep = keep & picked
    return tables.filter(keep)


def governed_view(df: DataFrame, schema: str, table: str, hidden: list[str]) -> DataFrame:
    """The table without the columns whose ``schema.table.column`` matches a hidden glob."""
    rules = [re.compile(glob_regex(p)) for p in hidden]
    drop = [c for c in df.columns if any(r.match(f"{schema}.{table}.{c}") for r in rules)]
    return df.drop(*drop)


def register_governed(df: DataFrame, schema: str, table: str, hidden: list[str]) -> DataFrame:
    """Register the governed frame as a temp view named like the table, for SQL users."""
    view = governed_view(df, schema, table, hidden)
    view.createOrReplaceTempView(table)
    return view


def catalog_snapshot(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(schema, table, position, name, type) of each table, from schemas alone."""
    rows = [
        (schema, table, i, f.name, f.dataType.simpleString())
        for (schema, table), df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "schema string, table string, position int, name string, type string")


def merge_catalog(
    existing: DataFrame,
    synced: DataFrame,
    partial: bool,
    preserved_schemas: list[str] = (),
    preserved_tables: list[tuple[str, str]] = (),
) -> DataFrame:
    """Synced tables overwrite; the rest stays if partial, else only failed schemas and tables stay."""
    kept = existing.join(synced.select("schema", "table").distinct(), ["schema", "table"], "left_anti")
    if not partial:
        keep = F.col("schema").isin(list(preserved_schemas) or [""])
        for schema, table in preserved_tables:
            keep = keep | ((F.col("schema") == schema) & (F.col("table") == table))
        kept = kept.filter(keep)
    return kept.unionByName(synced)


def stale_objects(on_record: DataFrame, synced: DataFrame, keys: list[str]) -> DataFrame:
    """Objects on record that the sync did not see."""
    return on_record.join(synced, keys, "left_anti")


def resolve_column(df: DataFrame, name: str) -> str:
    """Exact match first, then a unique case-insensitive one."""
    if name in df.columns:
        return name
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) == 1:
        return found[0]
    raise ValueError(f"column {name!r} is {'ambiguous' if found else 'unknown'} in {df.columns}")
