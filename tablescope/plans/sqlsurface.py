"""The SQL surface: one query per construct, in Spark SQL or the DataFrame API."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablescope.operators.ordered import neighbours, time_chunk
from tablescope.plans.registry import TABLES, query


def sql(name, *ids, spark, oracle=None):
    """A construct both engines spell (nearly) alike: Spark text and, where it differs, the oracle's."""

    @query(name, *ids, oracle=oracle or spark)
    def _(t):
        for table in TABLES:
            if table in spark:
                getattr(t, table).createOrReplaceTempView(table)
        return t.spark.sql(spark)


sql("sql_projection", "SQL-01", spark="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(l_extendedprice * (1 - l_discount), 4) AS net, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'piece' END AS lot FROM lineitem""")
sql("sql_filters", "SQL-02", spark="""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
    AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderpriority NOT IN ('4-NOT SPECIFIED') AND o_orderpriority LIKE '%-%'
    AND o_orderpriority ILIKE '%h%' AND o_custkey IS NOT NULL
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)""")
sql("sql_joins", "SQL-03", spark="""SELECT n.n_name, r.r_name, count(c.c_custkey) AS customers, count(s.s_suppkey) AS same_balance
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
    LEFT JOIN supplier s ON s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey GROUP BY n.n_name, r.r_name""")
sql("sql_self_join", "SQL-03", spark="""SELECT a.n_name AS first, b.n_name AS second FROM nation a
    JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
sql("sql_semi_anti", "SQL-05", spark="""SELECT c_custkey, 'buyer' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
    UNION ALL SELECT c_custkey, 'no order' FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL
    UNION ALL SELECT c_custkey, 'small only' FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""")
sql("sql_aggregates", "SQL-08", spark="""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts,
    count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_suppkey END) AS f_suppliers, round(sum(l_extendedprice), 2) AS total,
    min(l_shipdate) AS first_ship, max(l_quantity) AS most, round(avg(l_discount), 9) AS discount,
    round(stddev_pop(l_quantity), 9) AS spread FROM lineitem GROUP BY l_returnflag""")
sql("sql_string_agg", "SQL-08", spark="""SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names,
    array_join(array_sort(collect_list(n_nationkey)), '-') AS keys FROM nation GROUP BY n_regionkey""",
    oracle="""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names,
    array_to_string(list_sort(array_agg(n_nationkey)), '-') AS keys FROM nation GROUP BY n_regionkey""")
sql("sql_filter_clause", "SQL-09", spark="""SELECT event_type, count(*) FILTER (WHERE value > 10) AS high,
    round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even_value FROM events GROUP BY event_type""")
sql("sql_qualify", "SQL-10", spark="""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    oracle="""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
sql("sql_try_cast", "SQL-11", spark="""SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS STRING) END AS INT) AS n
    FROM events""")
sql("sql_ctes", "SQL-12", spark="""WITH orders_big AS (SELECT * FROM orders WHERE o_totalprice > 250000),
    customer AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0),
    per AS (WITH inner_per AS (SELECT o_custkey, count(*) AS n FROM orders_big GROUP BY o_custkey) SELECT * FROM inner_per WHERE n > 1)
    SELECT c_mktsegment, count(*) AS buyers, CAST(sum(n) AS BIGINT) AS orders FROM per JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""")
sql("sql_unions", "SQL-13", spark="""SELECT k, sum(n) AS n FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus) GROUP BY k""",
    oracle="""SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus) GROUP BY k""")
sql("sql_union_distinct", "SQL-13", spark="""SELECT o_orderstatus AS k FROM orders UNION SELECT l_linestatus FROM lineitem
    UNION SELECT l_returnflag FROM lineitem""")
sql("sql_distinct_top", "SQL-14", spark="""SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_brand, p_size LIMIT 25""")
sql("sql_except_columns", "SQL-15", spark="SELECT * EXCEPT (c_name, c_acctbal) FROM customer",
    oracle="SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
sql("sql_page", "SQL-16", spark="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 45")
sql("sql_json_path", "SQL-17", spark="SELECT event_id, CAST(variant_get(parse_json(props), '$.k', 'int') AS BIGINT) AS k FROM events",
    oracle="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
sql("sql_dates", "SQL-18", spark="""SELECT date_format(ts, 'yyyy-MM-dd') AS day, extract(HOUR FROM ts) AS hr, count(*) AS n,
    min(date_format(date_trunc('WEEK', ts), 'yyyy-MM-dd')) AS week FROM events
    WHERE ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00' - INTERVAL 7 DAY GROUP BY 1, 2""",
    oracle="""SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(extract('hour' FROM ts) AS INTEGER) AS hr, count(*) AS n,
    min(strftime(date_trunc('week', ts), '%Y-%m-%d')) AS week FROM events
    WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY GROUP BY 1, 2""")
sql("sql_unnest", "SQL-19", spark="""SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM embeddings
    LATERAL VIEW posexplode(embedding) e AS pos, x GROUP BY label, pos""",
    oracle="""SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS mean
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2""")
for _kind, _clause in (("grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"),
                       ("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)")):
    sql(f"sql_{_kind}", "SQL-20", spark=f"""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
        FROM lineitem GROUP BY {_clause}""")
sql("sql_set_operations", "SQL-20", spark="""(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20)
    EXCEPT SELECT p_partkey FROM part WHERE p_brand = 'Brand#3'""")


sql("sql_window_functions", "SQL-20", spark="""SELECT l_orderkey, l_linenumber, rank() OVER w AS rk, dense_rank() OVER w AS dr,
    CAST(ntile(2) OVER f AS INTEGER) AS half, lag(l_partkey) OVER f AS part_before, first_value(l_suppkey) OVER f AS first_supplier,
    round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_returnflag),
        f AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)""")


@query("sql_windows", "SQL-20", oracle="""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr,
    round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def _(t):
    # ranks come from counts per customer and priority, so a customer with a third of the orders ranks five rows
    per = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per.select("o_custkey", "o_orderpriority", (before + 1).alias("rk"), F.row_number().over(w).cast("long").alias("dr"))
    # the two rows before, across the chunks a customer is cut into
    order, chunk = ["o_orderdate", "o_orderkey"], time_chunk("o_orderdate", 30 * 86400)
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", F.col("o_totalprice").alias("p"))
    rows = neighbours(rows, ["o_custkey"], order, chunk, ["p"]).withColumnRenamed("prev_p", "q")
    rows = neighbours(rows, ["o_custkey"], order, chunk, ["q"])
    zero = F.lit(0.0)
    moving = F.col("p") + F.coalesce("q", zero) + F.coalesce("prev_q", zero)
    return rows.join(ranks, ["o_custkey", "o_orderpriority"]).select(
        "o_orderkey", "rk", "dr", F.round(moving, 2).alias("moving"))


@query("sql_except_all", "SQL-20", oracle="""SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier""")
def _(t):
    return t.lineitem.select(F.col("l_suppkey").alias("k")).exceptAll(t.supplier.select(F.col("s_suppkey").alias("k")))


WINDOWS = [("promo", "1996-03-01", "1996-06-01"), ("sale", "1996-05-15", "1997-01-01"), ("late", "2000-01-01", "2000-02-01")]


@query("sql_range_join", "SQL-23", oracle="""SELECT v.name, o_orderpriority, count(*) AS n FROM orders JOIN (VALUES ('promo', TIMESTAMP '1996-03-01',
      TIMESTAMP '1996-06-01'), ('sale', TIMESTAMP '1996-05-15', TIMESTAMP '1997-01-01'), ('late', TIMESTAMP '2000-01-01', TIMESTAMP '2000-02-01'))
      v(name, s, e) ON o_orderdate >= s AND o_orderdate < e GROUP BY 1, 2""")
def _(t):
    # intervals become one row per month, so the range condition rides on an equi-join
    spans = t.spark.createDataFrame(WINDOWS, "name string, s string, e string").select(
        "name", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    month = (lambda c: F.date_trunc("month", c))
    spans = spans.withColumn("month", F.explode(F.sequence(month("s"), month("e"), F.expr("INTERVAL 1 MONTH"))))
    rows = t.orders.select("o_orderdate", "o_orderpriority", month("o_orderdate").alias("month"))
    hit = rows.join(spans, "month").filter((F.col("o_orderdate") >= F.col("s")) & (F.col("o_orderdate") < F.col("e")))
    return hit.groupBy("name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# ---- scalar families

sql("sca_strings", "SCA-01", spark=r"""SELECT p_partkey, lower(p_type) AS lo, trim('  ' || p_name || ' ') AS tr, CAST(length(p_name) AS BIGINT) AS len,
    p_name LIKE '%e\\_%' ESCAPE '\\' AS esc, p_name ILIKE 'RED%' AS red, regexp_replace(p_name, '[aeiou]', '*') AS vowels,
    p_brand RLIKE '^Brand#1[0-9]$' AS teens, split_part(p_name, ' ', 2) AS noun, substring(p_name, 2, 3) AS sub,
    concat_ws('-', p_brand, p_type) AS both FROM part""",
    oracle=r"""SELECT p_partkey, lower(p_type) AS lo, trim('  ' || p_name || ' ') AS tr, CAST(length(p_name) AS BIGINT) AS len,
    p_name LIKE '%e\_%' ESCAPE '\' AS esc, p_name ILIKE 'RED%' AS red, regexp_replace(p_name, '[aeiou]', '*', 'g') AS vowels,
    regexp_matches(p_brand, '^Brand#1[0-9]$') AS teens, split_part(p_name, ' ', 2) AS noun, substring(p_name, 2, 3) AS sub,
    concat_ws('-', p_brand, p_type) AS both FROM part""")


@query("sca_title_case", "SCA-01", "RS-08", oracle="""SELECT p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
    || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' ' || p_type AS label FROM part""")
def _(t):
    from tablescope.functions.text import title_label

    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("__")), "p_type")
    return t.part.select("p_partkey", title_label(name).alias("label"))


sql("sca_dates", "SCA-02", spark="""SELECT event_id, date_format(ts, 'dd/MM/yyyy HH:mm') AS text,
    date_format(date_trunc('HOUR', ts), 'yyyy-MM-dd HH') AS hr, date_format(date_trunc('MONTH', ts), 'yyyy-MM-dd') AS mon,
    date_format(ts + INTERVAL 3 DAY, 'yyyy-MM-dd') AS later, date_format(add_months(ts, -1), 'yyyy-MM-dd') AS earlier,
    datediff(ts, TIMESTAMP_NTZ '2023-12-25 00:00:00') AS gap, unix_millis(CAST(ts AS TIMESTAMP)) AS ms,
    try_to_timestamp(CASE WHEN event_id % 2 = 0 THEN '2024-02-30' ELSE '2024-02-29' END) IS NOT NULL AS iso FROM events""",
    oracle="""SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS text, strftime(ts, '%Y-%m-%d %H') AS hr,
    strftime(date_trunc('month', ts), '%Y-%m-%d') AS mon, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS later,
    strftime(ts - INTERVAL 1 MONTH, '%Y-%m-%d') AS earlier, CAST(date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS INTEGER) AS gap,
    epoch_us(ts) // 1000 AS ms, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN '2024-02-30' ELSE '2024-02-29' END AS TIMESTAMP) IS NOT NULL AS iso FROM events""")
sql("sca_math", "SCA-03", spark="""SELECT event_id, abs(value - 50) AS a, ceil(value) AS c, floor(value) AS f, round(sqrt(value), 9) AS q,
    sign(value - 20) AS s, round(log10(value + 1), 9) AS l, round(power(value, 2), 6) AS p, greatest(value, 10, user_id) AS g,
    least(value, 10) AS m, greatest(0, least(1, value / 100)) AS clamped,
    NOT isnan(CASE WHEN event_id % 5 = 0 THEN double('NaN') ELSE value END) AS fin FROM events""",
    oracle="""SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS f, round(sqrt(value), 9) AS q,
    CAST(sign(value - 20) AS DOUBLE) AS s, round(log10(value + 1), 9) AS l, round(power(value, 2), 6) AS p, greatest(value, 10, user_id) AS g,
    least(value, 10) AS m, greatest(0, least(1, value / 100)) AS clamped,
    NOT isnan(CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END) AS fin FROM events""")
sql("sca_conditional", "SCA-04", spark="""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS state,
    coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS prio, CAST(o_totalprice AS INT) IS NOT NULL AS whole,
    TRY_CAST(o_orderstatus AS DOUBLE) AS bad FROM orders""")
sql("sca_arrays", "SCA-05", spark="""SELECT l_orderkey, array_join(slice(array_sort(collect_list(l_partkey)), 1, 3), ',') AS first_parts,
    array_contains(collect_set(l_returnflag), 'R') AS returned, size(array_distinct(collect_list(l_suppkey))) AS suppliers
    FROM lineitem GROUP BY l_orderkey""",
    oracle="""SELECT l_orderkey, array_to_string(list_sort(array_agg(l_partkey))[1:3], ',') AS first_parts,
    list_contains(array_agg(l_returnflag), 'R') AS returned, CAST(len(list_distinct(array_agg(l_suppkey))) AS INTEGER) AS suppliers
    FROM lineitem GROUP BY l_orderkey""")
sql("sca_maps_json", "SCA-06", spark="""SELECT event_id, get_json_object(props, '$.k') AS k, array_join(json_object_keys(props), ',') AS keys,
    to_json(named_struct('id', event_id, 'type', event_type)) AS body, map_keys(map(event_type, value))[0] AS first_key,
    try_parse_json(CASE WHEN event_id % 2 = 0 THEN '{broken' ELSE props END) IS NOT NULL AS parses, sha2(props, 256) AS digest FROM events""",
    oracle="""SELECT event_id, json_extract_string(props, '$.k') AS k, array_to_string(json_keys(props), ',') AS keys,
    '{"id":' || event_id || ',"type":"' || event_type || '"}' AS body, event_type AS first_key, event_id % 2 <> 0 AS parses,
    sha256(props) AS digest FROM events""")
