"""Profiling and catalog queries on the test tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators import catalog as cat
from tablescope.operators import partitions as pt
from tablescope.operators import profile as prf
from tablescope.plans.registry import TABLES, query
from tablescope.sources.shared import cut_lineage

# columns per profiled table: (name, reported type, kind); kind n=numeric d=date s=text k=foreign key
ORDERS = [
    ("o_orderkey", "bigint", "n"),
    ("o_custkey", "bigint", "n"),
    ("o_orderstatus", "string", "s"),
    ("o_totalprice", "double", "n"),
    ("o_orderdate", "timestamp_ntz", "d"),
    ("o_orderpriority", "string", "s"),
]
EVENTS = [
    ("event_id", "bigint", "k"),
    ("ts", "timestamp_ntz", "d"),
    ("user_id", "bigint", "k"),
    ("event_type", "string", "s"),
    ("value", "double", "n"),
    ("props", "string", "s"),
]
CUSTOMER = [
    ("c_custkey", "bigint", "n"),
    ("c_name", "string", "s"),
    ("c_nationkey", "int", "n"),
    ("c_acctbal", "double", "n"),
    ("c_mktsegment", "string", "s"),
]


def top_sql(table, column, rank_only=False):
    return f"""SELECT string_agg(v || ':' || n, ', ' ORDER BY n DESC, v) FROM (
        SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {table}
        GROUP BY 1 ORDER BY n DESC, v NULLS LAST LIMIT 10) WHERE v IS NOT NULL AND v <> ''"""


def profile_sql(table, columns, extra=""):
    parts = []
    for name, label, kind in columns:
        lo = hi = mean = sd = "CAST(NULL AS DOUBLE)"
        dlo = dhi = tops = "CAST(NULL AS VARCHAR)"
        if kind == "n":
            lo, hi = f"CAST(min({name}) AS DOUBLE)", f"CAST(max({name}) AS DOUBLE)"
            mean = f"round(avg(CAST({name} AS DOUBLE)), 4)"
            sd = f"round(stddev_pop(CAST({name} AS DOUBLE)), 4)"
        if kind == "d":
            dlo, dhi = (f"strftime({f}({name}), '%Y-%m-%dT%H:%M:%S')" for f in ("min", "max"))
        if kind == "s":
            tops = f"CASE WHEN count(DISTINCT {name}) <= 50 THEN ({top_sql(table, name)}) END"
        parts.append(f"""SELECT {extra}'{name}' AS "column", '{label}' AS type, count(*) AS total_count,
            count(*) - count({name}) AS null_count,
            round((count(*) - count({name})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage,
            count(DISTINCT {name}) AS distinct_count, {lo} AS min, {hi} AS max, {mean} AS mean,
            {sd} AS stddev, {dlo} AS min_date, {dhi} AS max_date, {tops} AS top_values FROM {table}""")
    return " UNION ALL ".join(parts)


def as_text(profile):
    """Top values as ``value:count`` text, so both engines print them alike."""
    text = F.array_join(F.transform("top_values", lambda x: F.concat_ws(":", x["value"], x["count"])), ", ")
    return profile.withColumn("top_values", text)


@query("prf_table_orders", "PRF-13", "PRF-01", "PRF-04", "PRF-05", "PRF-06", "PRF-07", "PRF-09",
       oracle=profile_sql("orders", ORDERS))
def _(t):
    return as_text(prf.profile_table(t.orders))


@query("prf_table_events", "PRF-13", "PRF-08", oracle=profile_sql("events", EVENTS))
def _(t):
    return as_text(prf.profile_table(t.events))


SKETCHED_SQL = f"""SELECT * REPLACE (CASE WHEN distinct_count <= 50 THEN distinct_count END AS distinct_count)
    FROM ({profile_sql("orders", ORDERS)})"""


@query("prf_table_orders_sketch", "PRF-05", "PRF-13", oracle=SKETCHED_SQL)
def _(t):
    # few-valued columns are exact; the sketched counts of the others are estimates
    out = as_text(prf.profile_table(t.orders, approx_distinct=True))
    return out.withColumn("distinct_count", F.when(F.col("distinct_count") <= 50, F.col("distinct_count")))


@query("prf_partition_refresh", "PRF-13", "PRF-15", oracle=f"""SELECT * EXCLUDE (top_values)
    REPLACE (CASE WHEN distinct_count <= 50 THEN distinct_count END AS distinct_count) FROM ({profile_sql("orders", ORDERS)})""")
def _(t):
    # statistics of all months but the newest are stored; the newest is scanned alone and merged with them
    month = F.date_format("o_orderdate", "yyyyMM")
    months = cut_lineage(t.orders.select(month.alias("part")).distinct(), "months")
    newest = months.agg(F.max("part")).first()[0]
    stored = cut_lineage(pt.partition_statistics(t.orders.filter(month < newest), month), "statistics")
    out = pt.merge_statistics(pt.refresh_statistics(stored, t.orders, month, months))
    return out.withColumn("distinct_count", F.when(F.col("distinct_count") <= 50, F.col("distinct_count")))


@query("prf_many", "PRF-22",
       oracle=" UNION ALL ".join(f"({profile_sql(n, c, extra=repr(n) + ' AS table_name, ')})"
                                 for n, c in [("orders", ORDERS), ("customer", CUSTOMER)]))
def _(t):
    many = prf.profile_many({"orders": t.orders, "customer": t.customer})
    return as_text(many).withColumnRenamed("table", "table_name")


@query("prf_row_count", "PRF-01", "SRC-01", oracle="SELECT count(*) AS row_count FROM lineitem")
def _(t):
    return prf.row_count(t.lineitem)


COLUMN_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
                "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}


def type_case(expr):
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLUMN_TYPES.items()) + " END"


@query("prf_columns", "PRF-02", oracle=f"""SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position,
    column_name AS name, {type_case('data_type')} AS type, true AS nullable FROM duckdb_columns_placeholder"""
       .replace("duckdb_columns_placeholder", "(SELECT table_name, column_index AS ordinal_position, "
                "column_name, data_type FROM duckdb_columns() WHERE table_name IN ("
                + ", ".join(f"'{n}'" for n in TABLES) + "))"))
def _(t):
    return prf.list_columns({n: getattr(t, n) for n in TABLES}).drop("description")


@query("prf_preview", "PRF-03", oracle="""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders ORDER BY o_orderkey LIMIT 10""")
def _(t):
    return prf.preview(t.orders, 10, [F.col("o_orderkey")])


@query("prf_array_elements", "PRF-10", "PRF-11", oracle="""
    WITH e AS (SELECT unnest(embedding) AS val FROM embeddings)
    SELECT 'embedding' AS "column", (SELECT count(*) - count(embedding) FROM embeddings) AS null_count,
      count(DISTINCT val) AS distinct_count FROM e""")
def _(t):
    counts = prf.distinct_counts(prf.value_counts(t.embeddings, ["embedding"]))
    nulls = prf.scalar_statistics(t.embeddings).filter(F.col("column") == "embedding")
    return nulls.select("column", "null_count", counts.select("distinct_count").scalar().alias("distinct_count"))


@query("prf_array_top_values", "PRF-11", oracle="""
    WITH e AS (SELECT unnest([event_type, CASE WHEN value < 10 THEN 'low' ELSE 'high' END,
                              CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'tag' || (user_id % 4) END]) AS val FROM events)
    SELECT val AS value, count(*) AS cnt FROM e WHERE val IS NOT NULL GROUP BY 1
    ORDER BY cnt DESC, val LIMIT 10""")
def _(t):
    tags = t.events.select(F.expr("""array(event_type, CASE WHEN value < 10 THEN 'low' ELSE 'high' END,
        CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('tag', user_id % 4) END)""").alias("tags"))
    counts = prf.value_counts(tags)
    return prf.top_values(counts, prf.few_valued(prf.distinct_counts(counts))).select("value", "cnt")


@query("prf_struct_values", "PRF-12", oracle="""SELECT count(*) - count(s) AS null_count,
    count(DISTINCT s) AS distinct_count, max(n) AS top_count FROM (
      SELECT CASE WHEN o_orderstatus IS NULL THEN NULL ELSE o_orderstatus || '|' || o_orderpriority END AS s,
             count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders)""")
def _(t):
    nested = t.orders.select(F.struct("o_orderstatus", "o_orderpriority").alias("s"))
    counts = prf.value_counts(nested)
    ranked = prf.top_values(counts, prf.few_valued(prf.distinct_counts(counts)))
    top = ranked.agg(F.max("cnt")).scalar()
    distinct = prf.distinct_counts(counts).select("distinct_count").scalar()
    return prf.scalar_statistics(nested).select("null_count", distinct.alias("distinct_count"), top.alias("top_count"))


@query("prf_recent_window", "PRF-14", oracle="""SELECT count(*) AS total_count,
    count(DISTINCT o_orderstatus) AS statuses FROM orders
    WHERE o_orderdate >= (SELECT CAST(max(o_orderdate) AS DATE) - 30 FROM orders)""")
def _(t):
    as_of = t.orders.agg(F.max("o_orderdate")).scalar()
    recent = t.orders.filter(prf.recent_partition_filter(F.col("o_orderdate"), as_of, 30))
    return recent.agg(F.count(F.lit(1)).alias("total_count"), F.countDistinct("o_orderstatus").alias("statuses"))


def order_parts(t):
    """Partition metadata of orders: one table per priority, one partition per day."""
    day = F.date_format("o_orderdate", "yyyyMMdd").alias("part")
    return t.orders.groupBy(F.col("o_orderpriority").alias("tbl"), day).agg(F.count(F.lit(1)).alias("n_rows"))


PARTS_SQL = """SELECT o_orderpriority AS tbl, strftime(o_orderdate, '%Y%m%d') AS part, count(*) AS n_rows
    FROM orders GROUP BY 1, 2"""


@query("prf_partition_summary", "PRF-15", oracle=f"""WITH p AS ({PARTS_SQL}),
    r AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY part DESC) AS rn FROM p)
    SELECT tbl, max(part) AS latest, coalesce(max(CASE WHEN rn = 2 THEN part END), max(part)) AS safe_partition,
      CAST(sum(n_rows) AS BIGINT) AS total_rows FROM r GROUP BY tbl""")
def _(t):
    return prf.partition_summary(order_parts(t), "tbl", "part", "n_rows")


@query("prf_metadata_row_count", "PRF-17", oracle="SELECT count(*) AS row_count FROM orders")
def _(t):
    return prf.metadata_row_count(order_parts(t), "n_rows")


PARTITION_IDS = {"1997": "year", "199805": "month", "19981003": "day", "2000010100": "hour"}


@query("prf_closed_partition", "PRF-16", oracle=" UNION ALL ".join(
    f"""SELECT '{pid}' AS partition_id, count(*) AS n FROM orders
        WHERE date_trunc('{u}', o_orderdate) = strptime('{pid}', '{"%Y%m%d%H"[:{4: 2, 6: 4, 8: 6, 10: 8}[len(pid)]]}')"""
    for pid, u in PARTITION_IDS.items()))
def _(t):
    out = None
    for pid in PARTITION_IDS:
        keep = prf.closed_partition_filter(F.col("o_orderdate"), T.TimestampNTZType(), pid)
        part = t.orders.filter(keep).agg(F.count(F.lit(1)).alias("n")).select(F.lit(pid).alias("partition_id"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("prf_filtered_preview", "PRF-18", oracle="""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-05-01' AND o_orderdate < TIMESTAMP '1998-06-01'
    ORDER BY o_orderkey LIMIT 10""")
def _(t):
    keep = prf.closed_partition_filter(F.col("o_orderdate"), T.TimestampNTZType(), "199805")
    return prf.preview(t.orders.filter(keep), 10, [F.col("o_orderkey")])


@query("prf_governed_columns", "PRF-19", oracle=f"""{profile_sql("customer", [
    c for c in CUSTOMER if c[0] not in ("c_name", "c_acctbal")])}""")
def _(t):
    hidden = ["main.customer.*name", "main.*.c_acct*"]
    return as_text(prf.profile_table(cat.governed_view(t.customer, "main", "customer", hidden)))


def object_list(t):
    """Catalog objects from the data: one schema per nation region, one table per customer segment and nation."""
    return t.customer.select(
        F.concat(F.lit("NATION_"), "c_nationkey").alias("schema"), F.col("c_mktsegment").alias("table")).distinct()


OBJECTS_SQL = "SELECT DISTINCT 'NATION_' || c_nationkey AS schema, c_mktsegment AS \"table\" FROM customer"


@query("prf_table_globs", "PRF-20", oracle=f"""SELECT schema, "table" FROM ({OBJECTS_SQL})
    WHERE ((schema || '.' || "table") LIKE 'NATION_1%' OR regexp_matches(schema || '.' || "table", '^NATION_.[.]BUILDING$'))
      AND NOT ((schema || '.' || "table") LIKE '%.MACH%')""")
def _(t):
    return cat.select_tables(object_list(t), ["NATION_1*", "NATION_?.BUILDING"], ["*.MACH*"])


@query("prf_table_globs_any_case", "PRF-20", oracle=f"""SELECT schema, "table" FROM ({OBJECTS_SQL})
    WHERE lower(schema || '.' || "table") LIKE 'nation\\_2%' ESCAPE '\\'
      AND (schema IN ('NATION_2', 'NATION_20') OR (schema || '.' || "table") = 'NATION_21.BUILDING')""")
def _(t):
    return cat.select_tables(object_list(t), ["nation_2*"], [], ["NATION_2", "NATION_20", "NATION_21.BUILDING"], True)


STATE_EXPRS = [
    "c_custkey AS table_id",
    "CASE c_custkey % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'once' ELSE 'interval' END AS policy",
    "CAST(1 + c_nationkey % 10 AS INT) AS interval_days",
]


@query("prf_refresh_policy", "PRF-21", oracle=f"""WITH s AS (SELECT {', '.join(STATE_EXPRS)},
      CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-20' - to_days(CAST(c_custkey % 15 AS INT)) END AS computed_at
      FROM customer)
    SELECT *, CASE WHEN computed_at IS NULL OR policy = 'always' THEN true WHEN policy = 'once' THEN false
      ELSE TIMESTAMP '2024-01-20' >= computed_at + to_days(interval_days) END AS should_refresh FROM s""")
def _(t):
    state = t.customer.selectExpr(*STATE_EXPRS, """CASE WHEN c_custkey % 7 = 0 THEN NULL
        ELSE TIMESTAMP_NTZ '2024-01-20 00:00:00' - make_dt_interval(CAST(c_custkey % 15 AS INT)) END AS computed_at""")
    return prf.refresh_due(state, "policy", "interval_days", "computed_at", F.lit("2024-01-20"))


CATALOG_SQL = """SELECT 's' || (p_size % 4) AS schema, p_brand AS "table", CAST(p_size AS INT) AS position,
    p_type || p_size AS name, p_type AS type FROM part"""


def catalog_rows(t):
    return t.part.selectExpr("concat('s', p_size % 4) AS schema", "p_brand AS table", "CAST(p_size AS INT) AS position",
                             "concat(p_type, p_size) AS name", "p_type AS type")


def synced_rows(t):
    return t.supplier.selectExpr("concat('s', s_suppkey % 3) AS schema", "concat('Brand#', s_nationkey) AS table",
                                 "CAST(s_suppkey AS INT) AS position", "s_name AS name", "'string' AS type")


SYNCED_SQL = """SELECT 's' || (s_suppkey % 3) AS schema, 'Brand#' || s_nationkey AS "table",
    CAST(s_suppkey AS INT) AS position, s_name AS name, 'string' AS type FROM supplier"""


@query("cat_snapshot", "CAT-01", oracle=f"""SELECT 'main' AS schema, table_name AS "table",
    CAST(column_index - 1 AS INTEGER) AS position, column_name AS name, {type_case('data_type')} AS type
    FROM duckdb_columns() WHERE table_name IN ({", ".join(f"'{n}'" for n in TABLES)})""")
def _(t):
    return cat.catalog_snapshot({("main", n): getattr(t, n) for n in TABLES})


@query("cat_merge_partial", "CAT-02", oracle=f"""WITH e AS ({CATALOG_SQL}), s AS ({SYNCED_SQL})
    SELECT * FROM e WHERE (schema, "table") NOT IN (SELECT schema, "table" FROM s) UNION ALL SELECT * FROM s""")
def _(t):
    return cat.merge_catalog(catalog_rows(t), synced_rows(t), partial=True)


@query("cat_merge_full", "CAT-02", oracle=f"""WITH e AS ({CATALOG_SQL}), s AS ({SYNCED_SQL})
    SELECT * FROM e WHERE (schema, "table") NOT IN (SELECT schema, "table" FROM s)
      AND (schema = 's3' OR (schema = 's0' AND "table" = 'Brand#7')) UNION ALL SELECT * FROM s""")
def _(t):
    return cat.merge_catalog(catalog_rows(t), synced_rows(t), False, ["s3"], [("s0", "Brand#7")])


@query("cat_stale", "CAT-03", oracle=f"""SELECT DISTINCT schema, "table" FROM ({CATALOG_SQL})
    EXCEPT SELECT DISTINCT schema, "table" FROM ({SYNCED_SQL})""")
def _(t):
    return cat.stale_objects(catalog_rows(t).select("schema", "table").distinct(),
                             synced_rows(t).select("schema", "table").distinct(), ["schema", "table"])


@query("cat_resolve_column", "CAT-04",
       oracle="SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t):
    return t.orders.groupBy(cat.resolve_column(t.orders, "O_OrderStatus")).agg(F.count(F.lit(1)).alias("n"))
