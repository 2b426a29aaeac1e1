"""Reader and sink queries: files are written from the test tables to the shared folder and read back."""

from pyspark.sql import functions as F

from tablescope.operators.results import cell_text
from tablescope.plans.registry import query
from tablescope.sources import files, properties
from tablescope.sources import warehouses as wh
from tablescope.sources.shared import scratch_path


@query("src_table", "SRC-01", oracle="SELECT * FROM orders")
def _(t):
    t.orders.createOrReplaceTempView("orders_by_name")
    return wh.read_source(t.spark, "table", table="orders_by_name")


@query("src_run_sql", "SRC-02", oracle="""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderstatus = 'F' AND o_totalprice >= 1000.0 GROUP BY 1""")
def _(t):
    t.orders.createOrReplaceTempView("orders_by_name")
    return wh.run_sql(t.spark, """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_by_name
        WHERE o_orderstatus = :status AND o_totalprice >= :floor GROUP BY 1""", {"status": "F", "floor": 1000.0})


@query("src_parquet", "SRC-03", "SRC-04", oracle="SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t):
    rows = wh.read_source(t.spark, "parquet", path=t.path("part"))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("src_csv", "SRC-04", oracle="SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = scratch_path(t.spark, "csv")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    rows.write.option("header", True).csv(path)
    return files.read_file(t.spark, "csv", path, rows.schema)


@query("src_ndjson", "SRC-04", oracle="SELECT event_id, event_type, value FROM events")
def _(t):
    path = scratch_path(t.spark, "json")
    rows = t.events.select("event_id", "event_type", "value")
    rows.write.json(path)
    return files.read_file(t.spark, "ndjson", path, rows.schema)


@query("src_text_lines", "SRC-04", oracle="""SELECT value, count(*) AS n FROM (
    SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "text")
    t.documents.select("text").write.text(path)
    lines = files.read_file(t.spark, "text", path)
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("src_blob", "SRC-04", oracle="SELECT true AS whole_files, true AS has_bytes")
def _(t):
    path = scratch_path(t.spark, "blob")
    t.documents.select("text").write.text(path)
    blobs = files.read_file(t.spark, "blob", path)
    return blobs.agg((F.sum("length") == F.sum(F.length("content"))).alias("whole_files"),
                     (F.sum("length") > 0).alias("has_bytes"))


@query("src_json_result", "SRC-05", oracle="""SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS note FROM orders""")
def _(t):
    path = scratch_path(t.spark, "rows")
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    files.register_json_rows(t.spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice", "note"], "result_orders")
    return t.spark.sql("SELECT * FROM result_orders")


@query("src_file_with_results", "SRC-06", oracle="""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "customers")
    rows = t.customer.select("c_custkey", "c_mktsegment")
    rows.write.option("header", True).csv(path)
    files.register_result(files.read_file(t.spark, "csv", path, rows.schema), "customer_file")
    files.register_result(t.orders.select("o_custkey", "o_totalprice"), "result_orders")
    return t.spark.sql("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM customer_file JOIN result_orders ON o_custkey = c_custkey GROUP BY 1""")


def register_save(kind):
    @query(f"src_save_{kind}", "SRC-07", oracle="""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY 1""")
    def _(t):
        rows = t.orders.groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        path = scratch_path(t.spark, "saved") + f".{kind}"
        files.save_result(rows, path, kind)
        return files.read_file(t.spark, kind, path, rows.schema)


register_save("csv")
register_save("parquet")

CELLS = ["event_id", """CASE event_id % 6 WHEN 0 THEN '=SUM(A' || user_id || ')' WHEN 1 THEN '+' || user_id WHEN 2 THEN '-' || event_type
    WHEN 3 THEN '@' || event_type || ', "q"' WHEN 4 THEN event_type || chr(9) || 'x' ELSE props END AS cell"""]
SAFE = """CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN '''' || cell ELSE cell END"""


@query("src_export_csv", "SRC-09", oracle=f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {SAFE} AS cell FROM (SELECT {', '.join(CELLS)} FROM events)""")
def _(t):
    path = scratch_path(t.spark, "export")
    files.export_table(t.events.selectExpr(*CELLS), path, "csv")
    return files.read_file(t.spark, "csv", path, "event_id string, cell string")


@query("src_export_tsv", "SRC-09", oracle=f"""SELECT CAST(event_id AS VARCHAR) AS event_id, replace({SAFE}, chr(9), ' ') AS cell
    FROM (SELECT {', '.join(CELLS)} FROM events)""")
def _(t):
    return files.neutralise(cell_text(t.events.selectExpr(*CELLS)), "tsv")


@query("src_delimited", "SRC-10", "SRC-11", oracle="""SELECT CAST(p_partkey AS VARCHAR) AS "key", p_name || '; "' || p_brand || '"' AS label,
    p_type AS "label (2)" FROM part""")
def _(t):
    path = scratch_path(t.spark, "delimited")
    rows = t.part.selectExpr("CAST(p_partkey AS STRING) AS key", "p_name || '; \"' || p_brand || '\"' AS label", "p_type AS kind")
    rows.toDF("key", "label", "label ").write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return files.read_delimited(t.spark, path)


@query("src_delimited_no_header", "SRC-11", oracle="SELECT CAST(p_partkey AS VARCHAR) AS A, p_brand AS B, CAST(NULL AS VARCHAR) AS C FROM part")
def _(t):
    path = scratch_path(t.spark, "headerless")
    t.part.selectExpr("CAST(p_partkey AS STRING) AS a", "p_brand AS b", "CAST(NULL AS STRING) AS c").write.option("sep", "|").csv(path)
    return files.read_delimited(t.spark, path)


@query("src_delimited_ragged", "SRC-10", oracle="""SELECT CAST(p_partkey AS VARCHAR) AS A, p_brand AS B,
    CASE WHEN p_partkey % 3 = 1 THEN p_type || ', ' || p_brand END AS C FROM part""")
def _(t):
    path = scratch_path(t.spark, "ragged")
    line = """concat(p_partkey, ',', p_brand, CASE WHEN p_partkey % 3 = 1 THEN concat(',"', p_type, ', ', p_brand, '"') ELSE '' END)"""
    t.part.selectExpr(line).write.text(path)
    return files.read_delimited(t.spark, path)


@query("src_delimited_title", "SRC-11", oracle="""SELECT 'Suppliers' AS A, NULL AS B, NULL AS C UNION ALL SELECT 'id', 'name', 'nation'
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR) FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "title")
    t.spark.sql("SELECT inline(array(struct('Suppliers\\nid,name,nation')))").write.text(f"{path}/a")
    t.supplier.selectExpr("concat_ws(',', s_suppkey, s_name, s_nationkey)").write.text(f"{path}/b")
    return files.read_delimited(t.spark, f"{path}/*")


@query("src_delimited_folder", "SRC-11", oracle="""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part""")
def _(t):
    path = scratch_path(t.spark, "folder")
    t.supplier.selectExpr("s_suppkey AS id", "s_name AS name").write.option("header", True).csv(f"{path}/a")
    t.part.selectExpr("p_partkey AS id", "p_name AS name").write.csv(f"{path}/b")
    return files.read_delimited(t.spark, f"{path}/*")


RECORD = """concat('{"Kind":{"type":"select","select":{"name":"', event_type, '"}},',
    CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('"Score":{"type":"number","number":', CAST(event_id % 7 AS STRING), '},') END,
    '"Name":{"type":"title","title":[{"plain_text":"Event "},{"plain_text":"', CAST(event_id AS STRING), '"}]},',
    '"Span":{"type":"date","date":{"start":"2024-01-0', CAST(1 + event_id % 9 AS STRING), '"',
    CASE WHEN event_id % 2 = 0 THEN ',"end":"2024-02-01"' ELSE '' END, '}},',
    '"Tags":{"type":"multi_select","multi_select":[{"name":"a"},{"name":"', event_type, '"}]},',
    '"Code":{"type":"unique_id","unique_id":{"prefix":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"P"' END, ',"number":', CAST(event_id AS STRING), '}},',
    '"Links":{"type":"relation","relation":[', CASE WHEN event_id % 5 = 0 THEN '' ELSE '{"id":"x"},{"id":"y"}' END, '],"has_more":',
    CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '},',
    '"Roll":{"type":"rollup","rollup":{"type":"array","array":[{"type":"number","number":1},{"type":"checkbox","checkbox":true}]}}}')"""
NAMES = ["Name", "Kind", "Score", "Span", "Tags", "Code", "Links", "Roll"]


def records(t):
    return t.events.select("event_id", F.expr(RECORD).alias("properties_json"))


@query("src_flatten_properties", "SRC-12", oracle="""SELECT event_id, 'Event ' || event_id AS "Name", event_type AS "Kind",
    CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 7 AS VARCHAR) END AS "Score",
    '2024-01-0' || (1 + event_id % 9) || CASE WHEN event_id % 2 = 0 THEN ' → 2024-02-01' ELSE '' END AS "Span",
    'a, ' || event_type AS "Tags", CASE WHEN event_id % 3 = 0 THEN '' ELSE 'P-' END || event_id AS "Code",
    CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN '2+ linked' ELSE '2 linked' END AS "Links", '1, true' AS "Roll" FROM events""")
def _(t):
    return properties.flatten(records(t), "properties_json", NAMES, ["event_id"])


@query("src_collect_columns", "SRC-13", oracle="""SELECT * FROM (VALUES ('Name', 0), ('Kind', 1), ('Span', 2), ('Tags', 3), ('Code', 4),
    ('Links', 5), ('Roll', 6), ('Score', 7)) v(name, position)""")
def _(t):
    return properties.collect_columns(records(t), "properties_json", "event_id")
