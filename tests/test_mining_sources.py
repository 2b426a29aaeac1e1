import json
import random

import pytest
from pyspark.sql import functions as F

from tablescope.operators import querylog as qh
from tablescope.operators import textjobs as txt
from tablescope.sources import files, properties, shared
from tablescope.sources import warehouses as wh

REFERENCES = [
    ("SELECT * FROM users", ["users"]),
    ("SELECT * FROM main.Users u", ["main.users"]),
    ("select * from a join b on a.i = b.i left join s.c using (i)", ["a", "b", "s.c"]),
    ("SELECT * FROM (SELECT * FROM inner_t) q", ["inner_t"]),
    ("WITH x AS (SELECT * FROM base) SELECT * FROM x JOIN other o ON 1=1", ["base", "other"]),
    ("WITH a AS (SELECT * FROM t1), b(c, d) AS (SELECT * FROM a) SELECT * FROM b", ["t1"]),
    ("WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r", []),
    ("SELECT * FROM `proj`.`tab`", ["proj.tab"]),
    ("DELETE FROM WHERE", []),
    ("select extract(year from d), trim(both from x) from p.s.t", ["p.s.t"]),
    ("select valid_from x, 'from nowhere' -- from comment\nfrom a, \"B b\".c where x is distinct from y", ["a", "b b.c"]),
    ("select * from a where i in (select i from b join c using (i)) and j not in (select j from d)", ["a", "b", "c", "d"]),
    ("select * from generate_series(1, 2) g join t on true union all select * from `p.q.r`", ["p.q.r", "t"]),
    ("select * from (a join b using (i)) join c using (i)", ["a", "b", "c"]),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(i, q) for i, (q, _) in enumerate(REFERENCES)], "seq int, q string")


def test_references(spark, log):
    got = {r["seq"]: r["refs"] for r in log.select("seq", qh.table_references(F.col("q")).alias("refs")).collect()}
    assert [got[i] for i in range(len(REFERENCES))] == [refs for _, refs in REFERENCES]


def test_pairs(spark, log):
    got = {r["seq"]: [tuple(p) for p in r["pairs"]] for r in log.select("seq", qh.join_pairs(F.col("q")).alias("pairs")).collect()}
    assert got[2] == [("a", "b"), ("a", "s.c")] and got[0] == []
    assert got[4] == [], "a named sub-query on either side is no table"
    assert got[11] == [("b", "c")], "a JOIN goes with the FROM of its own SELECT"
    assert got[12] == [], "the series has no name to pair with"


def test_usage(spark):
    queries = ["SELECT * FROM main.a JOIN b ON 1=1", "select * from a", " select * from a ", "SELECT * FROM other.b JOIN a ON 1=1"]
    df = spark.createDataFrame(list(enumerate(queries)), "seq int, q string")
    tables = spark.createDataFrame([("main", "a"), ("main", "b"), ("main", "none")], "schema string, table string")
    usage = {r["table"]: r["usage_count"] for r in qh.table_usage(df, "q", "seq", tables).collect()}
    assert usage == {"a": 4, "b": 2, "none": 0}
    joins = {(r["table"], r["other"], r["joins"]) for r in qh.common_joins(df, "q", "seq", tables).collect()}
    assert joins == {("a", "b", 1), ("a", "other.b", 1), ("b", "main.a", 1), ("b", "a", 1)}
    top = [(r["query_text"], r["times"]) for r in qh.top_queries(df, "q", "seq", tables).filter("table = 'a'").orderBy("rank").collect()]
    assert top[0] == ("select * from a", 2) and len(top) == 3


def test_grep_context_and_submatches(spark):
    docs = spark.createDataFrame([("a.md", "one\nfoo foo\nthree"), ("b.txt", "foo"), ("c.md", "nothing")], "path string, text string")
    rows = txt.grep(docs, "path", "text", "FOO", "*.md", True, 5).orderBy("match_number").collect()
    assert [(r["line_number"], r["match_number"], r["context_before"], r["context_after"]) for r in rows] == [
        (2, 1, ["one"], ["three"]), (2, 2, ["one"], ["three"])]
    assert [r["total_matches"] for r in txt.grep_report(txt.grep(docs, "path", "text", "foo"), 1).collect()] == [3]


def test_redaction(spark):
    parts = json.dumps([{"toolName": "execute_sql", "input": {"q": "secret"}, "id": 3}, {"toolName": "grep", "input": "open"}])
    rows = spark.createDataFrame([(0, parts), (1, "read_query_result { broken"), (2, "plain text"), (3, None)], "i int, t string")
    got = {r["i"]: r["o"] for r in rows.select("i", txt.redact_json(F.col("t")).alias("o")).collect()}
    assert json.loads(got[0]) == [{"toolName": "execute_sql", "input": "[redacted]", "id": 3}, {"toolName": "grep", "input": "open"}]
    assert (got[1], got[2], got[3]) == ("[redacted]", "plain text", None)


def test_redaction_inside_messages(spark):
    call = {"type": "tool-call", "toolName": "execute_sql", "args": [1, 2], "n": None}
    deep = {"a": [{"b": {"c": [call]}}]}
    chat = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [call, {"type": "text", "text": "execute_sql ran"}]}]
    rows = spark.createDataFrame([(0, json.dumps(chat)), (1, json.dumps(deep)), (2, '["execute_sql", 1]'), (3, json.dumps(call))], "i int, t string")
    got = {r["i"]: json.loads(r["o"]) for r in rows.select("i", txt.redact_json(F.col("t")).alias("o")).collect()}
    hidden = {**call, "args": "[redacted]"}
    assert got[0] == [chat[0], {"role": "assistant", "content": [hidden, chat[1]["content"][1]]}]
    assert "1" not in json.dumps(got[1]) and "redacted" in json.dumps(got[1])
    assert got[2] == ["execute_sql", 1] and got[3] == hidden


def test_redaction_at_any_depth(spark):
    call = {"toolName": "read_query_result", "output": {"rows": [{"toolName": "execute_sql", "input": "x"}], "n": 1.50}, "note": 'a "q", {b}: [c]'}
    shown = {"toolName": "grep", "input": {"toolName": "execute_sql", "args": [], "input": None, "k": -1e3}, "result": ["execute_sql"]}
    clean = [{**call, "output": "[redacted]"}, {**shown, "input": {**shown["input"], "args": "[redacted]", "input": "[redacted]"}}]
    nested, want = [call, shown], clean
    for level in range(300):
        nested, want = ({"a": nested, "input": level}, {"a": want, "input": level}) if level % 2 else ([0, nested], [0, want])
    rows = spark.createDataFrame([(0, json.dumps(nested)), (1, json.dumps([call, shown])), (2, None), (3, '"execute_sql"'), (4, "[" * 5000 + '"execute_sql"')],
                                 "i int, t string")
    got = {r["i"]: r["o"] for r in rows.select("i", txt.redact_json(F.col("t")).alias("o")).collect()}
    assert json.loads(got[0]) == want and json.loads(got[1]) == clean
    assert got[2] is None and got[3] == '"execute_sql"' and got[4] == "[redacted]"


PROPERTIES = {
    "title": ({"title": [{"plain_text": "A"}, {"plain_text": "b"}]}, "Ab"),
    "rich_text": ({"rich_text": [{"plain_text": "x"}]}, "x"),
    "number": ({"number": 1.5}, "1.5"),
    "select": ({"select": {"name": "s"}}, "s"),
    "status": ({"status": None}, ""),
    "multi_select": ({"multi_select": [{"name": "a"}, {"name": "b"}]}, "a, b"),
    "date": ({"date": {"start": "2024-01-01", "end": "2024-01-02"}}, "2024-01-01 → 2024-01-02"),
    "checkbox": ({"checkbox": False}, "false"),
    "people": ({"people": [{"name": "P"}, {}]}, "P, "),
    "files": ({"files": [{"name": "f.txt"}]}, "f.txt"),
    "url": ({"url": None}, ""),
    "email": ({"email": "a@b.c"}, "a@b.c"),
    "phone_number": ({"phone_number": "1"}, "1"),
    "created_time": ({"created_time": "t1"}, "t1"),
    "last_edited_time": ({"last_edited_time": "t2"}, "t2"),
    "created_by": ({"created_by": {"name": "me"}}, "me"),
    "last_edited_by": ({"last_edited_by": {}}, ""),
    "relation": ({"relation": [{"id": 1}, {"id": 2}], "has_more": True}, "2+ linked"),
    "place": ({"place": {"name": None, "latitude": 1.5, "longitude": 2}}, "1.5, 2"),
    "verification": ({"verification": {"state": "verified", "verified_by": {"name": "V"}}}, "verified by V"),
    "formula": ({"formula": {"type": "boolean", "boolean": True}}, "true"),
    "rollup": ({"rollup": {"type": "array", "array": [{"type": "number", "number": 3}, {"type": "date", "date": {"start": "d"}}]}}, "3, d"),
    "unique_id": ({"unique_id": {"prefix": "P", "number": 7}}, "P-7"),
    "unknown_kind": ({"x": 1}, ""),
}


def test_all_property_types(spark):
    record = {kind: {"type": kind, **body} for kind, (body, _) in PROPERTIES.items()}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "{}")], "id int, j string")
    full, empty = properties.flatten(df, "j", list(PROPERTIES), ["id"]).orderBy("id").collect()
    assert {k: full[k] for k in PROPERTIES} == {k: text for k, (_, text) in PROPERTIES.items()}
    assert all(empty[k] == "" for k in PROPERTIES)


@pytest.mark.parametrize("record, delimiter", [
    ("a,b;c,d", ","), ('"a,b,c";d;e', ";"), ("a\tb", "\t"), ("a|b|c,d", "|"), ("single", ","), ("a;b,c", ","), ('"x""y;z";1', ";")])
def test_delimiters(record, delimiter):
    assert files.detect_delimiter(record) == delimiter


def test_headers():
    assert files.header_names(["a", " b ", "a", "a"], 4) == ["a", "b", "a (2)", "a (3)"]
    assert files.header_names(["a", " "], 2) is None and files.header_names(["a"], 2) is None
    assert files.column_letters(28)[24:] == ["Y", "Z", "AA", "AB"]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('﻿name;note\nx;"two\nlines; and ""quotes"""\ny;z\n', encoding="utf-8")
    df = files.read_delimited(spark, str(path), multi_line=True)
    assert df.columns == ["name", "note"]
    assert [tuple(r) for r in df.collect()] == [("x", 'two\nlines; and "quotes"'), ("y", "z")]
    assert files.read_delimited(spark, str(path), multi_line=True, max_rows=1).count() == 1


def test_results_without_rows_have_text_columns(spark, tmp_path):
    path = tmp_path / "empty"
    path.mkdir()
    (path / "part.json").write_text("")
    df = files.register_json_rows(spark, str(path), ["a", "b"], "result_empty")
    assert df.dtypes == [("a", "string"), ("b", "string")]


def test_extension_must_match(spark, tmp_path):
    with pytest.raises(ValueError):
        files.save_result(spark.range(1), str(tmp_path / "x.csv"), "parquet")


def test_jdbc_options():
    got = wh.jdbc_options("postgres", "host/db", sql="SELECT 1", partition=("id", 0, 100, 8), user="u")
    assert got["url"] == "jdbc:postgresql://host/db" and got["dbtable"] == "(SELECT 1) q" and got["numPartitions"] == "8"
    assert len(wh.JDBC) == 14
    with pytest.raises(ValueError):
        wh.jdbc_options("mysql", "h", table="t", sql="s")


def test_shared_folder_comes_from_the_session(spark):
    base = shared.shared_dir(spark)
    assert shared.scratch_path(spark, "x").startswith(base)


def test_delimited_loses_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,name\n1,a\n")
    (tmp_path / "b.csv").write_text("2,b\n3,c\n")
    (tmp_path / "c.csv").write_text("id,name\n4,d\n")
    df = files.read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "name"] and sorted(r.id for r in df.collect()) == ["1", "2", "3", "4"]
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "a.csv").write_text('a,b\n1,2,3\n"x,y",z\n')
    assert [tuple(r) for r in files.read_delimited(spark, str(wide)).collect()] == [("a", "b", None), ("1", "2", "3"), ("x,y", "z", None)]
    long = tmp_path / "long"
    long.mkdir()
    (long / "a.csv").write_text('name;note\nx;"' + "line, of, it\n" * 80 + '"\n')
    assert files.read_delimited(spark, str(long), multi_line=True).columns == ["name", "note"]


@pytest.mark.parametrize("split", ["900b", "5k", "1g"])
def test_quoted_line_breaks_over_splits(spark, tmp_path, split):
    """Records cut by the borders of many splits, some over several of them; blank lines; quotes left open at the end."""
    pick = random.Random(6)

    def cell():
        kind = pick.randrange(5)
        plain = "".join(pick.choices("abc ", k=pick.randrange(1, 20)))
        if kind == 0:
            return plain, plain
        inner = "".join(pick.choices(["x", ",", "\n", '"', "yy", "\n\n", "é"], k=pick.randrange(1, 2500 if pick.random() < 0.02 else 12)))
        return inner, '"' + inner.replace('"', '""') + '"'

    rows, text = [], "id,a,b\n"
    for i in range(1500):
        (a, raw_a), (b, raw_b) = cell(), cell()
        rows.append((str(i), a, b))
        text += f"{i},{raw_a},{raw_b}" + pick.choice(["\n", "\r\n", "\n\n"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "in" / "b.csv").write_text('id,a,b\n-1,"never closed\nid,a,b\n' + "line\n" * 400, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_delimited(spark, str(tmp_path / "in"))
        got = {r["id"]: (r["a"], r["b"]) for r in df.collect()}
        tasks = spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert df.columns == ["id", "a", "b"] and len(got) == 1501
    assert (tasks > 30) == (split == "900b")
    assert got.pop("-1")[0].startswith("never closed\nid,a,b\nline\n")
    assert got == {i: (a, b) for i, a, b in rows}


def test_lines_as_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text('x;;\ny;"6\n\nz;7\n')
    df = files.read_delimited(spark, str(tmp_path), multi_line=False)
    assert df.count() == 3 and df.columns == ["A", "B", "C"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("")
    assert files.read_delimited(spark, str(tmp_path / "empty")).columns == []
