"""Query-log mining: which tables are used, joined and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.ordered import top_per_key

TOP_N = 5

_NAME = r"""(?:`[^`]*+`|"[^"]*+"|\[[^\]]*+\]|[\p{L}_][\p{L}\p{N}_$]*+)"""
#: Strings and comments, names with up to three dots, and the marks that tell clauses apart.
TOKEN = rf"'[^']*+'|--[^\n]*+|/\*(?s:.*?)\*/|{_NAME}(?:\s*+\.\s*+{_NAME}){{0,3}}|[(),;]"
#: Words that end the list of tables after FROM.
CLAUSES = ("where", "group", "order", "having", "limit", "union", "intersect", "except", "window", "qualify", "set", "returning")
#: Words a parenthesis may follow without making a call.
BEFORE_GROUP = (
    "from", "join", "in", "as", "on", "and", "or", "not", "exists", "any", "all", "some", "where", "having", "select", "by",
    "union", "intersect", "except", "values", "with", "over", "using", "then", "else", "when", "case", "lateral", "(", ",", ")", ";", "",
)


def exclude_queries(log: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Drop queries matching any pattern, in any case."""
    for p in patterns:
        log = log.filter(~F.col(text).rlike(f"(?i){p}"))
    return log


def _tokens(sql: Column) -> Column:
    """Words in lower case with the two before and the one after; names lose their quotes, literals and comments go."""
    kept = F.filter(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(?:'|--|/\*)"))
    plain = F.transform(kept, lambda t: F.lower(F.regexp_replace(t, r"[`\"\[\]]|\s+(?=\.)|(?<=\.)\s+", "")))
    # the one-element array binds the words, which each lambda call would tokenise anew
    return F.transform(
        F.array(plain),
        lambda words: F.transform(
            words,
            lambda w, i: F.struct(
                w.alias("word"),
                F.coalesce(F.get(words, i - 2), F.lit("")).alias("before2"),
                F.coalesce(F.get(words, i - 1), F.lit("")).alias("before"),
                F.coalesce(F.get(words, i + 1), F.lit("")).alias("after"),
            ),
        ),
    )[0]


_SCOPE = "struct<call:boolean,selects:boolean,tables:boolean,names:boolean,first:string>"
_READING = (
    f"struct<scopes:array<{_SCOPE}>,expects:string,ctes:array<string>,"
    "found:array<struct<word:string,name:string,first:string>>>"
)


def _scope(call, selects, tables, names, first) -> Column:
    return F.struct(
        call.alias("call"), selects.alias("selects"), tables.alias("tables"), names.alias("names"), first.alias("first")
    )


def _read(state: Column, t: Column) -> Column:
    """One word further. A scope is opened by each parenthesis and knows whether it is a call's, whether a SELECT has
    begun in it, whether a list of tables or of named sub-queries is open, and the first table of its SELECT."""
    word, no, yes, none = t["word"], F.lit(False), F.lit(True), F.lit(None).cast("string")
    scopes = state["scopes"]
    top = F.element_at(scopes, -1)
    below = F.slice(scopes, 1, F.size(scopes) - 1)
    opens, closes = word == "(", word == ")"
    select = (word == "select") | (word == "delete")
    from_ = (word == "from") & top["selects"] & (t["before"] != "distinct") & ~(top["call"] & ~top["selects"])
    join = (word == "join") & top["tables"]
    comma = (word == ",") & top["tables"]
    clause = word.isin(*CLAUSES)
    mark = word.isin("(", ")", ",", ";")
    skipped = word.isin("lateral", "only")
    names_table = (state["expects"] != "") & ~mark & ~skipped & ~select & ~clause
    is_table = names_table & (t["after"] != "(")
    named = top["names"] & t["before"].isin("with", "recursive", ",") & ~mark & (word != "recursive")
    first = F.when(is_table & (state["expects"] == "from"), word).otherwise(top["first"])
    changed = _scope(
        top["call"],
        top["selects"] | select,
        F.when(from_, yes).when(clause | select, no).otherwise(top["tables"]),
        F.when(word == "with", yes).when(select, no).otherwise(top["names"]),
        F.when(select, none).otherwise(first),
    )
    group = opens & (state["expects"] != "") & ~t["after"].isin("select", "with", "values", "(")  # tables in parentheses
    inner = _scope(~t["before"].isin(*BEFORE_GROUP) & (state["expects"] == ""), group, group, no, none)
    found = F.struct(state["expects"].alias("word"), word.alias("name"), top["first"].alias("first"))
    return F.struct(
        F.when(opens, F.concat(scopes, F.array(inner)))
        .when(closes & (F.size(scopes) > 1), below)
        .when(closes, scopes)
        .otherwise(F.concat(below, F.array(changed)))
        .alias("scopes"),
        F.when(from_ | group, "from").when(join, "join").when(comma, ",").when(skipped, state["expects"]).otherwise("").alias("expects"),
        F.when(named, F.concat(state["ctes"], F.array(word))).otherwise(state["ctes"]).alias("ctes"),
        F.when(is_table, F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"),
    ).cast(_READING)


def _mentions(sql: Column) -> Column:
    """``word, name, first`` of every table after FROM, JOIN or a comma between tables, in text order, without the names
    of sub-queries; ``first`` is the table its own SELECT reads first, null if that is a sub-query."""
    no, none = F.lit(False), F.lit(None).cast("string")
    start = F.struct(
        F.array(_scope(no, no, no, no, none)).alias("scopes"),
        F.lit("").alias("expects"),
        F.array().cast("array<string>").alias("ctes"),
        F.array().cast("array<struct<word:string,name:string,first:string>>").alias("found"),
    ).cast(_READING)

    def own(read: Column) -> Column:
        def table(name: Column) -> Column:
            return F.when(~F.array_contains(read["ctes"], name), name)

        tables = F.filter(read["found"], lambda m: ~F.array_contains(read["ctes"], m["name"]))
        return F.transform(
            tables, lambda m: F.struct(m["word"].alias("word"), m["name"].alias("name"), table(m["first"]).alias("first"))
        )

    return F.aggregate(_tokens(sql), start, _read, own)


def table_references(sql: Column) -> Column:
    """Distinct lower-case tables of a query, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_mentions(sql), lambda m: m["name"])))


def join_pairs(sql: Column) -> Column:
    """(left, right) pairs: each joined table with the first FROM table of its own SELECT, where both are tables."""
    joined = F.filter(_mentions(sql), lambda m: (m["word"] == "join") & m["first"].isNotNull())
    return F.transform(joined, lambda m: F.struct(m["first"].alias("left"), m["name"].alias("right")))


def distinct_queries(log: DataFrame, text: str, seq: str) -> DataFrame:
    """One row per trimmed text with how often and how early it came: logs repeat themselves."""
    return log.groupBy(F.trim(F.col(text)).alias("query_text")).agg(
        F.count(F.lit(1)).alias("times"), F.min(seq).alias("first_seq")
    )


def _suffixes(name: Column) -> Column:
    """The name and what follows each of its dots: a table matches if one of these is its name."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")
    )


def _match(rows: DataFrame, name: str, tables: DataFrame) -> DataFrame:
    """Equi-join in place of a suffix condition, so no pair of row and table is tried in vain.

    ``schema.table`` always ends in ``.table``, so the table name alone is the key.
    """
    keyed = rows.withColumn("_key", F.explode(_suffixes(F.col(name))))
    known = tables.select("schema", "table", F.lower("table").alias("_key"))
    return keyed.join(known, "_key").drop("_key")


def matching_tables(refs: DataFrame, name: str, tables: DataFrame) -> DataFrame:
    return _match(refs, name, tables).distinct()


def query_tables(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """(schema, table, query_text, times, first_seq): each query once per table it uses."""
    refs = queries.withColumn("ref", F.explode(table_references(F.col("query_text"))))
    return _match(refs, "ref", tables).drop("ref").distinct()


def table_usage(log: DataFrame, text: str, seq: str, tables: DataFrame) -> DataFrame:
    """Queries per table, 0 for unused ones."""
    used = query_tables(distinct_queries(log, text, seq), tables)
    counts = used.groupBy("schema", "table").agg(F.sum("times").alias("usage_count"))
    return tables.join(counts, ["schema", "table"], "left").na.fill(0, ["usage_count"])


def common_joins(log: DataFrame, text: str, seq: str, tables: DataFrame, n: int = TOP_N) -> DataFrame:
    """Tables most often joined with each table; where it is the left side the right one counts."""
    queries = distinct_queries(log, text, seq)
    pairs = queries.select("times", "first_seq", F.posexplode(join_pairs(F.col("query_text"))).alias("pos", "pair"))
    pairs = pairs.select("times", "first_seq", "pos", "pair.*")
    sides = pairs.select("*", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("left").alias("mine"), F.col("right").alias("other")),
        F.struct(F.lit(1).alias("side"), F.col("right").alias("mine"), F.col("left").alias("other")),
    )))
    hits = _match(sides, "mine", tables).groupBy("schema", "table", "first_seq", "pos", "times").agg(
        F.min_by("other", "side").alias("other")
    )
    counts = hits.groupBy("schema", "table", "other").agg(
        F.sum("times").alias("joins"), F.min("first_seq").alias("first_seq")
    )
    order = [F.col("joins").desc(), F.col("first_seq"), F.col("other")]
    return top_per_key(counts, ["schema", "table"], order, n).drop("first_seq")


def top_queries(log: DataFrame, text: str, seq: str, tables: DataFrame, n: int = TOP_N) -> DataFrame:
    """Texts most often run per table; the one seen first wins a tie."""
    used = query_tables(distinct_queries(log, text, seq), tables)
    order = [F.col("times").desc(), F.col("first_seq")]
    return top_per_key(used, ["schema", "table"], order, n).drop("first_seq")
