"""Query-log mining and evaluation queries; query texts are spelled from the events table."""

from pyspark.sql import functions as F

from tablescope.operators import compare as ev
from tablescope.operators import querylog as qh
from tablescope.plans.registry import query
from tablescope.sources import warehouses as wh
from tablescope.sources.shared import cut_lineage

TEXT = """CASE event_id % 9
    WHEN 0 THEN 'SELECT * FROM main.' || event_type
    WHEN 1 THEN 'select count(*) from orders_' || (user_id % 5) || ' o JOIN analytics.' || event_type || ' x ON o.id = x.id'
    WHEN 2 THEN 'WITH recent AS (SELECT * FROM ' || event_type || ') SELECT * FROM recent JOIN main.users_' || (user_id % 3) || ' u USING (id)'
    WHEN 3 THEN '  SELECT a FROM `main`.`Click` JOIN `view` USING (id) LEFT JOIN MAIN.signup s USING (id) WHERE a > ' || (user_id % 4) || ' '
    WHEN 4 THEN 'SELECT 1 FROM (SELECT * FROM main.purchase p JOIN orders_' || (user_id % 5) || ' USING (id)) q'
    WHEN 5 THEN 'INSERT INTO main.view SELECT ' || user_id || ' FROM LATERAL'
    WHEN 6 THEN 'SELECT error FROM error e, (SELECT 1) z WHERE e.k = ' || (user_id % 6)
    WHEN 7 THEN 'SELECT * FROM main.Purchase WHERE i IN (SELECT i FROM main.' || event_type || ' b JOIN main.users_' || (user_id % 3) || ' c USING (i))'
    ELSE 'SELECT extract(year FROM valid_from) AS y /* FROM none */ FROM cat.main.' || event_type || ' v, orders_' || (user_id % 5) || ' o' END"""
LOG = ["event_id AS seq", f"{TEXT} AS query_text"]
LOG_SQL = f"SELECT {', '.join(LOG)} FROM events"
TABLES_SQL = """SELECT DISTINCT 'main' AS schema, event_type AS "table" FROM events UNION SELECT 'analytics', event_type FROM events
    UNION SELECT 'main', 'orders_' || (user_id % 7) FROM events UNION SELECT 'main', 'users_' || (user_id % 3) FROM events"""


def log(t):
    return t.events.selectExpr(*LOG)


def tables(t):
    names = t.events.selectExpr("""stack(4, 'main', event_type, 'analytics', event_type, 'main', 'orders_' || (user_id % 7),
        'main', 'users_' || (user_id % 3)) AS (schema, table)""")
    return names.distinct()


# what each text mentions and joins, stated by hand
FOUND_SQL = """CASE event_id % 9
    WHEN 0 THEN ['main.' || event_type]
    WHEN 1 THEN ['orders_' || (user_id % 5), 'analytics.' || event_type]
    WHEN 2 THEN [event_type, 'main.users_' || (user_id % 3)]
    WHEN 3 THEN ['main.click', 'view', 'main.signup']
    WHEN 4 THEN ['main.purchase', 'orders_' || (user_id % 5)]
    WHEN 6 THEN ['error']
    WHEN 7 THEN ['main.purchase', 'main.' || event_type, 'main.users_' || (user_id % 3)]
    WHEN 8 THEN ['cat.main.' || event_type, 'orders_' || (user_id % 5)]
    ELSE [] END"""
JOINED_SQL = """CASE event_id % 9
    WHEN 1 THEN [{l: 'orders_' || (user_id % 5), r: 'analytics.' || event_type, p: 1}]
    WHEN 3 THEN [{l: 'main.click', r: 'view', p: 1}, {l: 'main.click', r: 'main.signup', p: 2}]
    WHEN 4 THEN [{l: 'main.purchase', r: 'orders_' || (user_id % 5), p: 1}]
    WHEN 7 THEN [{l: 'main.' || event_type, r: 'main.users_' || (user_id % 3), p: 1}]
    ELSE [] END"""
LOG_FLAT_SQL = f"SELECT seq, name FROM (SELECT event_id AS seq, unnest({FOUND_SQL}) AS name FROM events)"
DISTINCT_SQL = f"""SELECT trim({TEXT}) AS query_text, count(*) AS times, min(event_id) AS first_seq,
    any_value({FOUND_SQL}) AS found, any_value({JOINED_SQL}) AS joined FROM events GROUP BY 1"""
FLAT_SQL = f"SELECT query_text, times, first_seq, unnest(found) AS name FROM ({DISTINCT_SQL})"
MATCH = "({0} = lower(t.schema || '.' || t.\"table\") OR {0} = lower(t.\"table\") OR ends_with({0}, '.' || lower(t.\"table\")))"
USED_SQL = f"""SELECT DISTINCT t.schema, t."table", m.query_text, m.times, m.first_seq FROM ({FLAT_SQL}) m
    JOIN ({TABLES_SQL}) t ON {MATCH.format('m.name')}"""
PAIRS_SQL = f"""SELECT query_text, times, first_seq, j.p AS pos, j.l AS "left", j.r AS "right"
    FROM (SELECT query_text, times, first_seq, unnest(joined) AS j FROM ({DISTINCT_SQL}))"""


@query("qh_exclude", "QH-01", oracle=f"""SELECT * FROM ({LOG_SQL}) WHERE NOT regexp_matches(query_text, '(?i)^insert')
    AND NOT regexp_matches(query_text, '(?i)orders_[01]')""")
def _(t):
    return qh.exclude_queries(log(t), "query_text", ["^INSERT", "ORDERS_[01]"])


@query("qh_references", "QH-02", oracle=f"""SELECT seq, string_agg(DISTINCT name, ',' ORDER BY name) AS refs
    FROM ({LOG_FLAT_SQL}) GROUP BY 1""")
def _(t):
    refs = log(t).select("seq", F.array_join(qh.table_references(F.col("query_text")), ",").alias("refs"))
    return refs.filter("refs <> ''")


@query("qh_join_pairs", "QH-03", oracle=f"SELECT query_text, \"left\", \"right\" FROM ({PAIRS_SQL})")
def _(t):
    rows = qh.distinct_queries(log(t), "query_text", "seq")
    return rows.select("query_text", F.inline(qh.join_pairs(F.col("query_text"))))


@query("qh_matches", "QH-04", "SQL-04", oracle=f"""SELECT DISTINCT m.name, t.schema, t."table" FROM ({FLAT_SQL}) m
    JOIN ({TABLES_SQL}) t ON {MATCH.format('m.name')}""")
def _(t):
    refs = log(t).select(F.explode(qh.table_references(F.col("query_text"))).alias("name")).distinct()
    return qh.matching_tables(refs, "name", tables(t))


@query("qh_usage", "QH-05", oracle=f"""SELECT t.schema, t."table", CAST(coalesce(sum(times), 0) AS BIGINT) AS usage_count
    FROM ({TABLES_SQL}) t LEFT JOIN ({USED_SQL}) u ON u.schema = t.schema AND u."table" = t."table" GROUP BY 1, 2""")
def _(t):
    return qh.table_usage(log(t), "query_text", "seq", tables(t))


@query("qh_common_joins", "QH-06", oracle=f"""WITH p AS ({PAIRS_SQL}), h AS (SELECT t.schema, t."table", p.times, p.first_seq,
      CASE WHEN {MATCH.format('p."left"')} THEN p."right" ELSE p."left" END AS other FROM p JOIN ({TABLES_SQL}) t
      ON {MATCH.format('p."left"')} OR {MATCH.format('p."right"')}),
    c AS (SELECT schema, "table", other, CAST(sum(times) AS BIGINT) AS joins, min(first_seq) AS f FROM h GROUP BY 1, 2, 3)
    SELECT schema, "table", other, joins, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
      PARTITION BY schema, "table" ORDER BY joins DESC, f, other) AS rn FROM c) WHERE rn <= 5""")
def _(t):
    return qh.common_joins(log(t), "query_text", "seq", tables(t))


@query("qh_top_queries", "QH-07", oracle=f"""SELECT schema, "table", query_text, times, CAST(rn AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY schema, "table" ORDER BY times DESC, first_seq) AS rn FROM ({USED_SQL})) WHERE rn <= 5""")
def _(t):
    return qh.top_queries(log(t), "query_text", "seq", tables(t))


HISTORY = [f"{TEXT} AS query_text", "CASE event_id % 7 WHEN 5 THEN 'INSERT' ELSE 'SELECT' END AS query_type",
           "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'aborted' ELSE 'success' END AS status",
           "ts AS started_at"]
HISTORY_SQL = f"SELECT {', '.join(HISTORY)} FROM events"
KEPT = {"snowflake": "started_at >= TIMESTAMP '2024-01-16' AND query_type = 'SELECT' AND status = 'success'",
        "redshift": "started_at >= TIMESTAMP '2024-01-16' AND status <> 'aborted'", "postgres": "true"}
LIMITS = {"snowflake": 500, "redshift": 500, "postgres": None}


@query("src_query_log", "SRC-15", oracle=" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{k}' AS kind, *, {'count(*) OVER () > 500' if LIMITS[k] else 'false'} AS truncated FROM ({HISTORY_SQL})
      WHERE {w} {'ORDER BY started_at DESC, query_text LIMIT 500' if LIMITS[k] else ''})""" for k, w in KEPT.items()))
def _(t):
    out = None
    for kind in KEPT:
        now = F.expr("TIMESTAMP_NTZ '2024-01-26 00:00:00'")
        rows = wh.query_log(t.events.selectExpr(*HISTORY), kind, now, 10, LIMITS[kind])
        part = rows.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


# ---- comparison

SPELLED = """CASE o_orderkey % 8
    WHEN 0 THEN '$' || CAST(o_custkey AS STRING) || ',' || CAST(100 + o_orderkey % 900 AS STRING)
    WHEN 1 THEN CAST(o_custkey AS STRING) || '.' || CAST(100 + o_orderkey % 900 AS STRING) || ',5'
    WHEN 2 THEN '-' || CAST(1 + o_orderkey % 9 AS STRING) || '.' || CAST(100 + o_custkey % 900 AS STRING) || '.' || CAST(100 + o_orderkey % 900 AS STRING)
    WHEN 3 THEN '  ' || CAST(o_custkey AS STRING) || '.25 ' WHEN 4 THEN 'order ' || CAST(o_custkey AS STRING)
    WHEN 5 THEN '€ ' || CAST(o_custkey AS STRING) || ' 000' WHEN 6 THEN ' ' ELSE NULL END"""


@query("ev_formatted_numbers", "EV-01", oracle="""SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN CAST(o_custkey || CAST(100 + o_orderkey % 900 AS VARCHAR) AS DOUBLE)
    WHEN 1 THEN CAST(o_custkey || CAST(100 + o_orderkey % 900 AS VARCHAR) || '.5' AS DOUBLE)
    WHEN 2 THEN -CAST(CAST(1 + o_orderkey % 9 AS VARCHAR) || CAST(100 + o_custkey % 900 AS VARCHAR) || CAST(100 + o_orderkey % 900 AS VARCHAR) AS DOUBLE)
    WHEN 3 THEN o_custkey + 0.25 WHEN 5 THEN o_custkey * 1000.0 END AS number FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", ev.formatted_number(F.expr(SPELLED)).alias("number"))


def by_part(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("amount"), F.max("l_returnflag").alias("flag"))


@query("ev_compare", "EV-02", oracle="""WITH n AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)
    SELECT * FROM (VALUES ('same', true, 'match'), ('spelled', true, 'match'), ('close', true, 'match (approximate)'),
      ('off', false, 'values differ'), ('missing', false, 'missing columns: flag'), ('empty', true, 'both empty'),
      ('no actual', false, 'actual is empty')) v(case_name, passed, message)
    UNION ALL SELECT 'fewer', false, 'row count: ' || (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey >= 5) || ' vs ' || n FROM n""")
def _(t):
    base = cut_lineage(by_part(t), "compare")
    columns = ["l_partkey", "amount", "flag"]
    # amounts are above ten thousand here, so 0.05 is within the relative tolerance and 5 is not
    cases = {
        "same": (base, base),
        "spelled": (base.withColumn("amount", F.concat(F.lit("$"), F.format_number("amount", 2))), base),
        "close": (base.withColumn("amount", F.col("amount") + F.lit(0.05)), base),
        "off": (base.withColumn("amount", F.when(F.col("l_partkey") == 7, F.col("amount") + 500).otherwise(F.col("amount"))), base),
        "fewer": (base.filter("l_partkey >= 5"), base),
        "missing": (base.drop("flag"), base),
        "empty": (base.filter("l_partkey < 0"), base.filter("l_partkey < 0")),
        "no actual": (base.filter("l_partkey < 0"), base),
    }
    found = [(name, v.passed, v.message) for name, (a, e) in cases.items() for v in [ev.compare_tables(a, e, columns)]]
    return t.spark.createDataFrame(found, "case_name string, passed boolean, message string")


@query("ev_differing_cells", "EV-03", oracle="""SELECT 'amount' AS "column", count(*) AS n, round(sum(a - e), 2) AS gap FROM (
    SELECT l_partkey, sum(l_extendedprice) AS e, sum(l_extendedprice) + CASE WHEN l_partkey % 100 = 7 THEN 500 ELSE 0 END AS a
    FROM lineitem GROUP BY 1) WHERE a <> e""")
def _(t):
    # the key sorts first, so a changed amount keeps its place
    base = by_part(t).select(F.col("l_partkey").alias("a_key"), "amount", "flag")
    changed = base.withColumn("amount", F.when(F.col("a_key") % 100 == 7, F.col("amount") + 500).otherwise(F.col("amount")))
    cells = ev.differing_cells(changed, base, ["a_key", "amount", "flag"])
    gap = F.round(F.sum(F.col("actual").cast("double") - F.col("expected").cast("double")), 2)
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), gap.alias("gap"))


RUNS = ["event_id AS seq", "event_type AS test", """CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE NULL END AS model""",
        "value < 15 AS passed", "CAST(floor(value * 100) AS BIGINT) AS tokens", "CAST(floor(value * 100) AS BIGINT) / 1000000 AS cost",
        "event_id % 5000 AS duration_ms", "event_id % 9 AS tool_call_count"]
RUNS_SQL = f"SELECT {', '.join(RUNS)} FROM events"
SUMMARY_SQL = """count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
    CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS total_cost, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms,
    round_even(sum(duration_ms) / count(*), 0) AS avg_duration_ms, CAST(sum(tool_call_count) AS BIGINT) AS total_tool_calls,
    round_even(sum(tool_call_count) / count(*), 1) AS avg_tool_calls"""


@query("ev_summary", "EV-04", oracle=f"""SELECT {SUMMARY_SQL}, round_even(sum(duration_ms) / 1000, 2) AS total_duration_s FROM ({RUNS_SQL})""")
def _(t):
    return ev.summarize(t.events.selectExpr(*RUNS))


@query("ev_by_model", "EV-05", oracle=f"""SELECT coalesce(model, 'unknown') AS model, {SUMMARY_SQL},
    round_even(count(*) FILTER (WHERE passed) / count(*) * 100, 1) AS pass_rate FROM ({RUNS_SQL}) GROUP BY 1""")
def _(t):
    return ev.summarize_by_model(t.events.selectExpr(*RUNS))


@query("ev_model_matrix", "EV-06", oracle=f"""SELECT test, {', '.join(
    f"coalesce(string_agg(CASE WHEN passed THEN 'pass' ELSE 'fail' END, ' ' ORDER BY seq) FILTER (WHERE model = '{m}'), '-') AS {m}"
    for m in ('alpha', 'beta', 'gamma'))} FROM ({RUNS_SQL}) GROUP BY 1""")
def _(t):
    return ev.model_matrix(t.events.selectExpr(*RUNS), ["alpha", "beta", "gamma"])
