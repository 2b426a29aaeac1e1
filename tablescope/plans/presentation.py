"""Result access, dashboard filter, chart and map queries."""

from functools import reduce

from pyspark.sql import functions as F

from tablescope.functions.text import coerce_boolean, natural_key
from tablescope.operators import charts as ch
from tablescope.operators import filters as fl
from tablescope.operators import maps as mp
from tablescope.operators import results as rs
from tablescope.operators.ordered import number_chunk, with_row_number
from tablescope.plans.registry import query


def rounded(df, places=9):
    return df.select(*[F.round(c, places).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


# ---- results


@query("rs_page", "RS-01", "SQL-16", oracle="""SELECT *, (SELECT count(*) FROM orders) AS total
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(t):
    return rs.read_page(t.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40, 20)


@query("rs_deep_page", "RS-01", "SQL-16", oracle="""SELECT l_orderkey, l_linenumber, l_shipdate, (SELECT count(*) FROM lineitem) AS total
    FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 5000""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return rs.deep_page(rows, [("l_shipdate", False), ("l_orderkey", True), ("l_linenumber", True)], 5000, 20)


@query("rs_limit_reached", "RS-02", oracle="""SELECT 'orders' AS tbl, count(*) >= 500 AS limit_reached FROM orders
    UNION ALL SELECT 'region', count(*) >= 500 FROM region""")
def _(t):
    return (rs.limit_reached(t.orders, 500).select(F.lit("orders").alias("tbl"), "limit_reached")
            .unionByName(rs.limit_reached(t.region, 500).select(F.lit("region").alias("tbl"), "limit_reached")))


@query("rs_clean_output", "RS-03", oracle="""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type,
    CASE WHEN user_id % 5 IN (0, 1) THEN NULL ELSE value END AS value, CAST(event_id + 0.25 AS DOUBLE) AS amount,
    props AS body, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(t):
    raw = t.events.select(
        "event_id", "ts", "event_type",
        F.when(F.col("user_id") % 5 == 0, F.lit(float("nan"))).when(F.col("user_id") % 5 == 1, F.lit(float("inf")))
        .otherwise(F.col("value")).alias("value"),
        (F.col("event_id") + F.lit(0.25).cast("decimal(10,2)")).alias("amount"),
        F.encode("props", "UTF-8").alias("body"), F.to_date("ts").alias("day"))
    return rs.clean_for_output(raw)


@query("rs_safe_integers", "RS-04", oracle="""SELECT o_orderkey,
    CASE WHEN o_custkey * 10000000000000 <= 9007199254740991 THEN o_custkey * 10000000000000 END AS big,
    CASE WHEN o_custkey * 10000000000000 > 9007199254740991 THEN CAST(o_custkey * 10000000000000 AS VARCHAR) END AS big_text
    FROM orders""")
def _(t):
    return rs.split_safe_integer(t.orders.selectExpr("o_orderkey", "o_custkey * 10000000000000 AS big"), "big")


TEXTED = """SELECT *, CASE WHEN o_custkey % 9 = 0 THEN 'n/a' ELSE
    (CAST(o_custkey AS STRING) || ',' || CAST(100 + o_orderkey % 900 AS STRING)) END AS amount FROM orders"""


def texted(t):
    return t.orders.selectExpr("*", """CASE WHEN o_custkey % 9 = 0 THEN 'n/a' ELSE
        (CAST(o_custkey AS STRING) || ',' || CAST(100 + o_orderkey % 900 AS STRING)) END AS amount""")


def summary_sql(column, expr, source):
    return f"""SELECT '{column}' AS "column", min(v) AS min, max(v) AS max, round(avg(v), 6) AS avg,
        round(sum(v), 4) AS sum, count(v) AS count FROM (SELECT {expr} AS v FROM ({source}))"""


@query("rs_numeric_summaries", "RS-05", oracle=" UNION ALL ".join(
    [summary_sql(c, f"CAST({c} AS DOUBLE)", TEXTED) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [summary_sql("amount", "TRY_CAST(replace(amount, ',', '') AS DOUBLE)", TEXTED)]))
def _(t):
    out = rs.numeric_summaries(texted(t))
    return out.withColumns({"avg": F.round("avg", 6), "sum": F.round("sum", 4)})


@query("rs_column_kinds", "RS-06", oracle="""SELECT * FROM (VALUES ('key_text', 'numeric'), ('flag', 'boolean'),
    ('o_orderstatus', 'string'), ('nothing', NULL), ('o_totalprice', 'numeric'), ('mixed', 'string')) v("column", kind)""")
def _(t):
    frame = t.orders.selectExpr("CAST(o_orderkey AS STRING) AS key_text", "o_custkey > 5 AS flag", "o_orderstatus",
                                "CAST(NULL AS STRING) AS nothing", "o_totalprice",
                                "CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE o_orderstatus END AS mixed")
    return rs.column_kinds(frame)


@query("rs_sorted_table", "RS-07", oracle="""SELECT c_custkey, row_number() OVER (
    ORDER BY CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 1000 END DESC NULLS LAST, c_custkey) AS rn
    FROM customer""")
def _(t):
    frame = t.customer.selectExpr("c_custkey", """CASE WHEN c_custkey % 10 = 0 THEN NULL
        ELSE concat('Item ', c_custkey % 1000) END AS label""")
    return with_row_number(frame, [*rs.sort_columns(frame, "label", True), F.col("c_custkey")]).select("c_custkey", "rn")


@query("rs_column_labels", "RS-08", oracle="""SELECT count(*) AS "N Rows", CAST(sum(o_custkey) AS BIGINT) AS "Customer Key Sum"
    FROM orders""")
def _(t):
    return rs.label_columns(t.orders.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_custkey").alias("customer_key_sum")))


@query("rs_cell_text", "RS-09", oracle="""SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%d/%m/%Y') AS ts,
    CASE WHEN user_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, coalesce(nullif(event_type, 'view'), 'NULL') AS event_type,
    strftime(ts, '%d/%m/%Y') AS iso_text FROM events""")
def _(t):
    frame = t.events.selectExpr("event_id", "ts", "user_id % 2 = 0 AS flag", "nullif(event_type, 'view') AS event_type",
                                "date_format(ts, 'yyyy-MM-dd') AS iso_text")
    return rs.cell_text(frame)


@query("rs_join_results", "RS-10", "SRC-05", "SRC-06", oracle="""WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spent
      FROM orders GROUP BY 1), b AS (SELECT c_custkey, c_mktsegment FROM customer)
    SELECT c_mktsegment, count(*) AS buyers, max(spent) AS best FROM a JOIN b ON a.o_custkey = b.c_custkey GROUP BY 1""")
def _(t):
    t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent")).createOrReplaceTempView("result_a")
    t.customer.select("c_custkey", "c_mktsegment").createOrReplaceTempView("result_b")
    return t.spark.sql("""SELECT c_mktsegment, count(*) AS buyers, max(spent) AS best
        FROM result_a JOIN result_b ON o_custkey = c_custkey GROUP BY c_mktsegment""")


# ---- filters

FILTERS = [
    fl.Filter("status", "o_orderstatus", "select"),
    fl.Filter("priority", "o_orderpriority", "multi_select"),
    fl.Filter("find", "o_orderpriority", "search"),
    fl.Filter("dates", "o_orderdate", "date_range"),
]


def register_filter(name, op, selections, where):
    @query(name, op, oracle=f"SELECT * FROM orders WHERE {where}")
    def _(t):
        return fl.apply_filters(t.orders, FILTERS, selections)


register_filter("fl_select", "FL-01", {"status": "F", "find": "  "}, "o_orderstatus = 'F'")
register_filter("fl_multi_select", "FL-02", {"priority": ["1-URGENT", " ", "5-LOW"]}, "o_orderpriority IN ('1-URGENT', '5-LOW')")
register_filter("fl_search", "FL-03", {"find": "NOT SPEC"}, "o_orderpriority LIKE '%NOT SPEC%'")
register_filter("fl_date_range", "FL-04", {"dates": ["1997-01-01", "1997-12-31"]},
                "o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
register_filter("fl_all_filters", "FL-05", {"status": "O", "priority": ["2-HIGH", "3-MEDIUM"], "find": "E",
                                            "dates": ["1996-06-01", "1999-06-30"]},
                "o_orderstatus = 'O' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND o_orderpriority LIKE '%E%' "
                "AND o_orderdate BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1999-06-30'")
register_filter("fl_no_selection", "FL-05", {}, "true")


LABELLED = "p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN '%_' WHEN 1 THEN '%x' ELSE '_' END || p_size AS label"


@query("fl_search_literal", "FL-03", oracle=f"SELECT * FROM (SELECT {LABELLED} FROM part) WHERE contains(label, '%_')")
def _(t):
    frame = t.part.selectExpr("p_partkey", LABELLED.split(", ", 1)[1])
    return fl.apply_filters(frame, [fl.Filter("find", "label", "search")], {"find": "%_"})


@query("fl_options", "FL-06", "SQL-14", oracle="""SELECT trim(option) AS option FROM (
    SELECT DISTINCT CASE WHEN p_size = 1 THEN ' ' ELSE p_brand || '/' || p_size END AS option FROM part
    ORDER BY option LIMIT 100) WHERE trim(option) <> ''""")
def _(t):
    frame = t.part.selectExpr("CASE WHEN p_size = 1 THEN ' ' ELSE p_brand || '/' || p_size END AS label")
    return fl.filter_options(frame, "label")


@query("fl_dashboard", "FL-07", oracle="""SELECT 'by_status' AS chart, o_orderstatus AS label, count(*) AS n FROM orders
    WHERE o_orderpriority IN ('1-URGENT') GROUP BY ALL UNION ALL
    SELECT 'by_type', p_type, count(*) FROM part GROUP BY ALL""")
def _(t):
    frames = fl.filter_all({"by_status": t.orders, "by_type": t.part}, FILTERS, {"priority": ["1-URGENT"]})
    count = F.count(F.lit(1)).alias("n")
    return (frames["by_status"].groupBy(F.col("o_orderstatus").alias("label")).agg(count).withColumn("chart", F.lit("by_status"))
            .unionByName(frames["by_type"].groupBy(F.col("p_type").alias("label")).agg(count).withColumn("chart", F.lit("by_type"))))


PRESETS = {"7d": "7 DAY", "30d": "30 DAY", "3m": "3 MONTH", "6m": "6 MONTH", "1y": "12 MONTH"}


@query("fl_date_presets", "FL-08", oracle=" UNION ALL ".join(
    f"SELECT '{p}' AS preset, count(*) AS n, min(o_orderdate) AS since FROM orders "
    f"WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {i}" for p, i in PRESETS.items()))
def _(t):
    parts = [fl.date_preset(t.orders, "o_orderdate", p).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("since"))
             .select(F.lit(p).alias("preset"), "n", "since") for p in PRESETS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("fl_sort_by_date", "FL-09", oracle="""SELECT o_orderkey, row_number() OVER (ORDER BY
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END NULLS LAST, o_orderkey) AS rn FROM orders""")
def _(t):
    frame = t.orders.selectExpr("o_orderkey", """CASE WHEN o_orderkey % 50 = 0 THEN 'not a date'
        ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day""")
    key = F.try_to_timestamp("day").asc_nulls_last()
    return with_row_number(frame, [key, F.col("o_orderkey").asc()]).select("o_orderkey", "rn")


# ---- charts


@query("ch_pie", "CH-01", oracle="""WITH r AS (SELECT CASE WHEN p_brand = 'Brand#3' THEN 'Other' ELSE p_brand END AS label,
      round(sum(p_retailprice), 2) AS amount FROM part GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY amount DESC, label) AS rn FROM r)
    SELECT CASE WHEN rn > 10 THEN 'Other' ELSE label END AS label, round(sum(amount), 4) AS amount FROM k GROUP BY 1""")
def _(t):
    rows = t.part.groupBy(F.expr("CASE WHEN p_brand = 'Brand#3' THEN 'Other' ELSE p_brand END").alias("label")).agg(
        F.round(F.sum("p_retailprice"), 2).alias("amount"))
    return rounded(ch.bucket_pie(rows, "label", "amount"), 4)


@query("ch_pie_rows", "CH-01", oracle="""WITH k AS (SELECT o_orderkey, o_totalprice, row_number() OVER (
      ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS rn FROM orders)
    SELECT CASE WHEN rn > 10 THEN 'Other' ELSE CAST(o_orderkey AS VARCHAR) END AS o_orderkey,
      round(sum(o_totalprice), 2) AS o_totalprice FROM k GROUP BY 1""")
def _(t):
    return rounded(ch.bucket_pie(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice"), 2)


@query("ch_pie_small", "CH-01", oracle="SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1")
def _(t):
    return ch.bucket_pie(t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderpriority", "n")


MONTHLY = """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
    {sums} FROM orders GROUP BY 1"""
STATUSES = ("F", "O", "P")


def monthly(t):
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month")
    return ch.long_to_wide(t.orders.select(month, "o_orderstatus", "o_totalprice"), "month", "o_orderstatus",
                           "o_totalprice", list(STATUSES))


WIDE_SQL = MONTHLY.format(sums=", ".join(
    f"sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END) AS {s}" for s in STATUSES))


@query("ch_long_to_wide", "CH-13", oracle=f"""SELECT month, {', '.join(f'round({s}, 2) AS {s}' for s in STATUSES)}
    FROM ({WIDE_SQL})""")
def _(t):
    return rounded(monthly(t), 2)


SIGNED = f"SELECT month, F - 40000000 AS F, O, P, F + O + P AS total FROM ({WIDE_SQL})"


def signed(t):
    return monthly(t).select("month", (F.col("F") - 40000000).alias("F"), "O", "P",
                             (F.col("F") + F.col("O") + F.col("P")).alias("total"))


@query("ch_percent_stack", "CH-02", oracle=f"""WITH s AS (SELECT month, greatest(coalesce(F, 0), 0) AS F,
      greatest(coalesce(O, 0), 0) AS O, greatest(coalesce(P, 0), 0) AS P FROM ({SIGNED}))
    SELECT month, {', '.join(f'round(CASE WHEN F + O + P = 0 THEN 0 ELSE {c} / (F + O + P) END, 9) AS {c}_share' for c in STATUSES)}
    FROM s""")
def _(t):
    out = ch.percent_stack(signed(t), ["F", "O", "P", "total"], ["total"])
    return rounded(out.select("month", "F_share", "O_share", "P_share"))


DAILY_SQL = """SELECT o_orderpriority, date_trunc('{0}', o_orderdate)::TIMESTAMP AS x, round(sum(o_totalprice), 2) AS y
    FROM orders GROUP BY 1, 2"""


def series(t, unit):
    x = F.date_trunc(unit, "o_orderdate").cast("timestamp_ntz").alias("x")
    return t.orders.groupBy("o_orderpriority", x).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def kpi_sql(unit):
    return f"""WITH s AS ({DAILY_SQL.format(unit)}), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
          ORDER BY x DESC) AS rn FROM s), p AS (SELECT o_orderpriority, max(CASE WHEN rn = 1 THEN y END) AS cur,
          max(CASE WHEN rn = 2 THEN y END) AS prev, max(CASE WHEN rn = 1 THEN x END) AS x1,
          max(CASE WHEN rn = 2 THEN x END) AS x2 FROM r WHERE rn <= 2 GROUP BY 1)
        SELECT o_orderpriority, cur AS current, prev AS previous, round(cur - prev, 2) AS delta,
          CASE WHEN cur > prev THEN 'up' WHEN cur < prev THEN 'down' ELSE 'flat' END AS direction,
          CASE WHEN prev <> 0 THEN round(abs((cur - prev) / abs(prev)) * 100, 1) END AS percent,
          CASE WHEN g = 1 THEN 'yesterday' WHEN g BETWEEN 6 AND 8 THEN 'last week' WHEN g BETWEEN 26 AND 33 THEN 'last month'
            WHEN g BETWEEN 80 AND 100 THEN 'last quarter' WHEN g BETWEEN 330 AND 400 THEN 'last year'
            ELSE 'previous period' END AS period
        FROM (SELECT *, round(epoch(x1 - x2) / 86400.0) AS g FROM p)"""


def register_kpi(unit):
    @query(f"ch_kpi_{unit}", "CH-03", "CH-04", oracle=kpi_sql(unit))
    def _(t):
        out = ch.kpi_comparison(series(t, unit), ["o_orderpriority"], "x", "y")
        return out.withColumn("delta", F.round("delta", 2))


for _unit in ("day", "week", "month", "quarter", "year"):
    register_kpi(_unit)


@query("ch_latest_kpi", "CH-05", oracle=f"""SELECT o_orderpriority, max(x) AS x, arg_max(y, x) AS y
    FROM ({DAILY_SQL.format('week')}) GROUP BY 1""")
def _(t):
    return ch.latest_row(series(t, "week"), ["o_orderpriority"], "x", "y")


@query("ch_stack_total", "CH-06", oracle=f"""SELECT month, round(CASE WHEN F IS NOT NULL OR O IS NOT NULL OR P IS NOT NULL
    THEN coalesce(F, 0) + coalesce(O, 0) + coalesce(P, 0) END, 2) AS total FROM ({WIDE_SQL})""")
def _(t):
    return rounded(monthly(t).select("month", ch.stack_total(list(STATUSES)).alias("total")), 2)


@query("ch_axis_range", "CH-07", oracle=f"""SELECT round(least(min(F), min(O), min(P)), 2) AS axis_min,
    round(greatest(max(F), max(O), max(P)), 2) AS axis_max FROM ({SIGNED})""")
def _(t):
    return rounded(ch.axis_range(signed(t), list(STATUSES)), 2)


@query("ch_stacked_axis_range", "CH-07", oracle=f"""WITH s AS (SELECT
      greatest(coalesce(F, 0), 0) + greatest(coalesce(O, 0), 0) + greatest(coalesce(P, 0), 0) AS up,
      least(coalesce(F, 0), 0) + least(coalesce(O, 0), 0) + least(coalesce(P, 0), 0) AS down FROM ({SIGNED})),
    v AS (SELECT up AS v FROM s UNION ALL SELECT down FROM s)
    SELECT round(min(v), 2) AS axis_min, round(max(v), 2) AS axis_max FROM v WHERE v <> 0""")
def _(t):
    return rounded(ch.stacked_axis_range(signed(t), list(STATUSES)), 2)


EXTREMA_SQL = """WITH s AS ({0}), n AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM s
      WINDOW w AS (PARTITION BY {1} ORDER BY {2}))
    SELECT {1}, {2}, y, CASE WHEN y IS NULL THEN false WHEN l IS NULL THEN r IS NULL OR y <> r
      WHEN r IS NULL THEN y <> l ELSE sign(y - l) <> 0 AND sign(y - l) = sign(y - r) END AS is_extremum FROM n"""


@query("ch_extrema_events", "CH-10", oracle=EXTREMA_SQL.format(
    "SELECT event_type, event_id, value AS y FROM events", "event_type", "event_id"))
def _(t):
    rows = t.events.select("event_type", "event_id", F.col("value").alias("y"))
    return ch.with_extremum(rows, ["event_type"], "event_id", "y", number_chunk("event_id", 1000))


#: Extrema and the rest are drawn from in turn; ``taken`` grows by the nearest point that is left at each target.
DOWNSAMPLE_SQL = f"""WITH RECURSIVE e AS ({EXTREMA_SQL.format("SELECT event_type, event_id, value AS y FROM events", "event_type", "event_id")}),
    k AS (SELECT * FROM e WHERE y IS NOT NULL),
    ends AS (SELECT event_type, arg_min(event_id, (y, event_id)) AS low, arg_min(event_id, (-y, event_id)) AS high FROM k GROUP BY 1),
    c AS (SELECT k.*, CASE WHEN event_id IN (low, high) THEN 0 WHEN is_extremum THEN 1 ELSE 2 END AS cls FROM k JOIN ends USING (event_type)),
    s AS (SELECT event_type, cls, list(event_id) AS xs, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM c GROUP BY 1, 2),
    free AS (SELECT event_type, 12 - count(*) FILTER (WHERE cls = 0) AS f, count(*) FILTER (WHERE cls = 1) AS x FROM c GROUP BY 1),
    plan AS (SELECT s.*, CASE cls WHEN 0 THEN n WHEN 1 THEN least(f, n) ELSE least(greatest(f - x, 0), n) END AS slots FROM s JOIN free USING (event_type)),
    picks AS (SELECT event_type, cls, 0 AS pos, []::BIGINT[] AS taken FROM plan UNION ALL
      SELECT p.event_type, p.cls, pos + 1, list_append(taken, list_sort(list_transform(list_filter(xs, lambda v: NOT list_contains(taken, v)),
        lambda v: {{'d': abs(v - (lo + (hi - lo) * CASE WHEN slots = 1 THEN 0.5::DOUBLE ELSE pos::DOUBLE / (slots - 1) END)), 'v': v}}))[1].v)
      FROM picks p JOIN plan USING (event_type, cls) WHERE pos < slots),
    chosen AS (SELECT event_type, unnest(taken) AS event_id FROM picks JOIN plan USING (event_type, cls) WHERE pos = slots)
    SELECT event_type, event_id, y FROM chosen JOIN k USING (event_type, event_id)"""


@query("ch_downsample", "CH-11", oracle=DOWNSAMPLE_SQL)
def _(t):
    rows = t.events.select("event_type", "event_id", F.col("value").alias("y"))
    return ch.downsample(rows, "event_type", "event_id", "y", number_chunk("event_id", 1000))


@query("ch_top_bars", "CH-12", oracle="""WITH r AS (SELECT s_name, round(sum(l_extendedprice), 2) AS v FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY v DESC, s_name LIMIT 10)
    SELECT s_name, v, round(v / (SELECT max(v) FROM r), 9) AS share FROM r""")
def _(t):
    rows = (t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "v"))
    return ch.top_bars(rows, "s_name", "v").withColumn("share", F.round("share", 9))


SPIKED = "CASE WHEN event_id % 13 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('infinity' AS DOUBLE) ELSE value END"


def spiked(t):
    return t.events.selectExpr("event_id", "event_type", f"{SPIKED} AS v")


@query("ch_column_range", "CH-14", oracle=f"""SELECT min(v) AS min, max(v) AS max FROM (SELECT {SPIKED} AS v FROM events)
    WHERE isfinite(v)""")
def _(t):
    return ch.column_range(spiked(t), "v")


@query("ch_threshold", "CH-15", oracle=f"""SELECT event_id, isfinite(v) AND v >= 10 AS ge, isfinite(v) AND v > 100 AS gt,
    isfinite(v) AND v <= 20 AS le, isfinite(v) AND v < 5 AS lt, isfinite(v) AND v = 12.31 AS eq
    FROM (SELECT event_id, {SPIKED} AS v FROM events)""")
def _(t):
    v = F.col("v")
    return spiked(t).select("event_id", *[ch.matches_threshold(v, op, b).alias(n) for op, b, n in (
        (">=", 10.0, "ge"), (">", 100.0, "gt"), ("<=", 20.0, "le"), ("<", 5.0, "lt"), ("=", 12.31, "eq"))])


WORDS = """CASE event_id % 10 WHEN 0 THEN 'true' WHEN 1 THEN ' T ' WHEN 2 THEN 'Yes' WHEN 3 THEN '1' WHEN 4 THEN 'FALSE'
    WHEN 5 THEN 'f' WHEN 6 THEN 'no' WHEN 7 THEN '0' WHEN 8 THEN 'maybe' ELSE NULL END"""


@query("ch_coerce_boolean", "CH-16", oracle=f"""SELECT event_id, CASE WHEN w IN ('true', 't', 'yes', '1') THEN true
    WHEN w IN ('false', 'f', 'no', '0') THEN false END AS flag FROM (SELECT event_id, lower(trim({WORDS})) AS w FROM events)""")
def _(t):
    return t.events.select("event_id", coerce_boolean(F.expr(WORDS)).alias("flag"))


@query("ch_text_rule", "CH-17", oracle="""SELECT o_orderkey, o_orderpriority = '5-LOW' AS eq,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS among, contains(lower(o_orderpriority), 'specified') AS has FROM orders""")
def _(t):
    c = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", ch.matches_text(c, "equals", "5-LOW").alias("eq"),
                           ch.matches_text(c, "in", ["1-URGENT", "2-HIGH"]).alias("among"),
                           ch.matches_text(c, "like", "Specified").alias("has"))


@query("ch_scale_ratio", "CH-18", oracle="""WITH r AS (SELECT min(value) AS lo FROM events)
    SELECT event_id, round(greatest(0, least(1, (value - lo) / (300.0 - lo))), 9) AS ratio FROM events, r""")
def _(t):
    return rounded(ch.scale_ratio(t.events.select("event_id", "value"), "value", high=300.0).select("event_id", "ratio"))


# ---- maps

PLACES = ["c_custkey", "c_acctbal",
          "CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE CAST((c_custkey * 37) % 181 - 90 AS STRING) || '.25' END AS lat",
          "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST((c_custkey * 61) % 300 - 150 AS STRING) || '.5' END AS lon"]
POINTS_SQL = f"""SELECT * FROM (SELECT c_custkey, c_acctbal, TRY_CAST(lat AS DOUBLE) AS latitude,
    TRY_CAST(lon AS DOUBLE) AS longitude FROM (SELECT {', '.join(PLACES)} FROM customer))
    WHERE abs(latitude) <= 85.051129 AND abs(longitude) <= 180"""


def points(t):
    return mp.map_points(t.customer.selectExpr(*PLACES), "lat", "lon")


@query("mp_points", "MP-01", oracle=f"SELECT c_custkey, latitude, longitude FROM ({POINTS_SQL})")
def _(t):
    return points(t).select("c_custkey", "latitude", "longitude")


def bounds_sql(pts):
    return f"""WITH p AS ({pts}), d AS (SELECT DISTINCT longitude AS x FROM p),
      g AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, (SELECT min(x) FROM d) AS fx FROM d),
      b AS (SELECT x, nx, fx, CASE WHEN nx IS NULL THEN fx + 360 - x ELSE nx - x END AS gap FROM g
            ORDER BY gap DESC, nx IS NULL DESC, x LIMIT 1)
    SELECT CASE WHEN nx IS NULL THEN fx ELSE nx END AS west, (SELECT min(latitude) FROM p) AS south,
      CASE WHEN nx IS NULL THEN x ELSE x + 360 END AS east, (SELECT max(latitude) FROM p) AS north FROM b"""


@query("mp_bounds", "MP-02", oracle=bounds_sql(POINTS_SQL))
def _(t):
    return mp.map_bounds(points(t))


SHIFTED = "CASE WHEN longitude < 0 THEN -150 - longitude / 8 ELSE 160 + longitude / 8 END"


@query("mp_bounds_antimeridian", "MP-02", oracle=bounds_sql(
    f"SELECT c_custkey, latitude, {SHIFTED} AS longitude FROM ({POINTS_SQL})"))
def _(t):
    return mp.map_bounds(points(t).withColumn("longitude", F.expr(SHIFTED)))


@query("mp_point_report", "MP-03", oracle=f"""SELECT (SELECT count(*) FROM ({POINTS_SQL})) AS point_count,
    (SELECT count(*) FROM customer) - (SELECT count(*) FROM ({POINTS_SQL})) AS dropped_row_count,
    (SELECT count(*) FROM ({POINTS_SQL})) > 5000 AS too_many""")
def _(t):
    return mp.point_report(t.customer.selectExpr(*PLACES), "lat", "lon")


SPARSE = "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS measure"


@query("mp_scale_sqrt", "MP-04", oracle=f"""WITH r AS (SELECT c_custkey, {SPARSE} FROM customer),
    d AS (SELECT min(measure) AS lo, max(measure) AS hi FROM r)
    SELECT c_custkey, round(CASE WHEN measure IS NULL THEN 4 WHEN lo = hi THEN 28
      ELSE 4 + 24 * sqrt((measure - lo) / (hi - lo)) END, 9) AS scaled FROM r, d""")
def _(t):
    out = mp.scale_sqrt(t.customer.selectExpr("c_custkey", SPARSE), "measure", 4.0, 28.0)
    return rounded(out.select("c_custkey", "scaled"))


@query("mp_scale_linear", "MP-09", oracle=f"""WITH r AS (SELECT c_custkey, {SPARSE} FROM customer),
    d AS (SELECT min(measure) AS lo, max(measure) AS hi FROM r)
    SELECT c_custkey, round(CASE WHEN lo = hi THEN 0.5 ELSE 0.15 + 0.7 * ((coalesce(measure, lo) - lo) / (hi - lo)) END, 9)
      AS scaled FROM r, d""")
def _(t):
    out = mp.scale_linear(t.customer.selectExpr("c_custkey", SPARSE), "measure", 0.15, 0.85)
    return rounded(out.select("c_custkey", "scaled"))


@query("mp_region_key", "MP-05", oracle="""SELECT c_custkey, nullif(lower(trim(CASE c_custkey % 3 WHEN 0 THEN '  '
    WHEN 1 THEN ' Nation_' || c_nationkey || ' ' ELSE NULL END)), '') AS region FROM customer""")
def _(t):
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' Nation_' || c_nationkey || ' ' ELSE NULL END")
    return t.customer.select("c_custkey", mp.region_key(raw).alias("region"))


GEOMETRY = """concat('{"type":"Point","coordinates":[', n_nationkey, ',', n_regionkey, ']}')"""
INDEX_SQL = f"""SELECT region, arg_min(geometry, n_nationkey) AS geometry FROM (
    SELECT n_nationkey, {GEOMETRY} AS geometry, lower(trim(unnest([n_name, r_name]))) AS region
    FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1"""


def features(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    props = F.create_map(F.lit("name"), F.col("n_name"), F.lit("continent"), F.col("r_name"))
    return joined.select("n_nationkey", props.alias("properties"), F.expr(GEOMETRY).alias("geometry"))


@query("mp_boundary_index", "MP-06", oracle=INDEX_SQL)
def _(t):
    return mp.boundary_index(features(t), "n_nationkey", "properties", "geometry")


@query("mp_boundary_index_one", "MP-06", oracle=f"""SELECT lower(r_name) AS region, arg_min({GEOMETRY}, n_nationkey) AS geometry
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(t):
    return mp.boundary_index(features(t), "n_nationkey", "properties", "geometry", ["continent"])


REGIONAL = ["c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE 'Nation_' || c_nationkey END AS place", SPARSE]


def shaded(t):
    index = mp.boundary_index(features(t), "n_nationkey", "properties", "geometry")
    return mp.region_join(t.customer.selectExpr(*REGIONAL), "place", "measure", index, "geometry")


SHADED_SQL = f"""SELECT c.*, i.geometry AS boundary, measure IS NOT NULL AND i.region IS NOT NULL AS matched
    FROM (SELECT {', '.join(REGIONAL)} FROM customer) c LEFT JOIN ({INDEX_SQL}) i ON lower(trim(place)) = i.region"""


@query("mp_region_join", "MP-07", oracle=SHADED_SQL)
def _(t):
    return shaded(t)


@query("mp_region_report", "MP-07", oracle=f"""SELECT count(*) FILTER (WHERE matched) AS region_count,
    count(*) FILTER (WHERE NOT matched) AS dropped_row_count FROM ({SHADED_SQL})""")
def _(t):
    return mp.region_report(shaded(t))


GEOJSON = """CASE c_custkey % 6 WHEN 0 THEN concat('{"type":"Point","coordinates":[', c_custkey, ',1]}')
    WHEN 1 THEN concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[', c_custkey, ']]}}')
    WHEN 2 THEN '{"type":"GeometryCollection","geometries":[]}' WHEN 3 THEN 'not json' WHEN 4 THEN ' '
    ELSE '{"type":"Topology"}' END"""


@query("mp_inline_geometry", "MP-08", oracle="""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon'
    WHEN 2 THEN 'GeometryCollection' END AS kind FROM customer""")
def _(t):
    return t.customer.select("c_custkey", mp.inline_geometry(F.expr(GEOJSON)).alias("kind"))


@query("mp_value_domain", "MP-10", oracle=f"""SELECT min(measure) AS min, max(measure) AS max
    FROM (SELECT {', '.join(REGIONAL)} FROM customer) WHERE place <> 'nowhere'""")
def _(t):
    return mp.value_domain(t.customer.selectExpr(*REGIONAL), "measure", F.col("place") != "nowhere")


@query("rs_natural_order", "RS-07", oracle="""SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name),
    CAST(substr(p_brand, 7) AS INTEGER), p_partkey) AS rn FROM part""")
def _(t):
    frame = t.part.selectExpr("p_partkey", "p_name || ' ' || p_brand AS label")
    return with_row_number(frame, [natural_key(F.col("label")).asc(), F.col("p_partkey")]).select("p_partkey", "rn")
