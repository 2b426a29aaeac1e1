"""Redaction and line search over text columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.catalog import glob_regex

# fixed values: tools whose payload is data, the payload keys, the replacement
DATA_TOOLS = ("execute_sql", "read_query_result")
PAYLOAD_KEYS = ("input", "args", "output", "result")
PLACEHOLDER = "[redacted]"


def redact_columns(parts: DataFrame, tool: str, payloads: list[str]) -> DataFrame:
    """Blank the payload columns of data-tool calls."""
    is_data = F.coalesce(F.col(tool).isin(*DATA_TOOLS), F.lit(False))
    return parts.withColumns(
        {c: F.when(is_data & F.col(c).isNotNull(), PLACEHOLDER).otherwise(F.col(c)) for c in payloads}
    )


JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')


def blank_payloads(text: str) -> str:
    """JSON text with the payloads of data-tool entries blanked, at whatever depth, and all else as it was.

    One pass over the tokens with a stack of open arrays and objects. Whether an object is a data-tool entry is known
    when it closes, so the places of its payloads are kept until then.
    """
    tools = {json.dumps(t) for t in DATA_TOOLS}
    payloads = {json.dumps(k) for k in PAYLOAD_KEYS}
    # per open array or object: key in hand, start of its value, names a data tool, places of payloads
    stack: list[list] = []
    blanked: list[tuple[int, int]] = []
    for token in JSON_TOKEN.finditer(text):
        what, begin, end = token.group(), token.start(), token.end()
        top = stack[-1] if stack else None
        if what == ":":
            top[0], top[1] = last, None
            continue
        if what == ",":
            top[0] = top[1] = None
            continue
        if top and top[0] is not None and top[1] is None:
            top[1] = begin
        if what in "{[":
            stack.append([None, None, False, []])
            continue
        if what in "}]":
            _, _, tool, places = stack.pop()
            if tool:
                blanked += places
            top = stack[-1] if stack else None
        last = what
        # a value has ended
        if top and top[0] in payloads:
            top[3].append((top[1], end))
        elif top and top[0] == '"toolName"' and what in tools:
            top[2] = True
    out, at = [], 0
    for begin, end in sorted(blanked):
        if begin >= at:  # not inside a payload that is blank already
            out += [text[at:begin], json.dumps(PLACEHOLDER)]
            at = end
    return "".join(out) + text[at:]


def redact_json(text: Column) -> Column:
    """Blank payload keys of data-tool entries anywhere in a JSON value, such as an array of messages with parts.

    Text that does not parse but names a data tool is replaced as a whole; text naming none is returned
    as it is, unparsed. Only texts that name a tool and parse are looked at in Python, in Arrow batches.
    """

    @F.pandas_udf("string")
    def blanked(texts: pd.Series) -> pd.Series:
        return texts.map(blank_payloads, na_action="ignore")

    named = F.coalesce(text.rlike("|".join(DATA_TOOLS)), F.lit(False))
    parsed = F.to_json(F.try_parse_json(F.when(named, text)))
    return F.when(~named, text).when(parsed.isNull(), PLACEHOLDER).otherwise(blanked(parsed))


# with these a line may match where the whole text does not
TEXT_ANCHORS = ("\\A", "\\z", "\\Z", "\\G", "(?<", "(?!", "(?=")


def grep(
    docs: DataFrame,
    path: str,
    text: str,
    pattern: str,
    glob: str | None = None,
    case_insensitive: bool = False,
    context_lines: int = 0,
) -> DataFrame:
    """One row per match: path, line number, line, lines before and after.

    Lines are cut, tested and given their context inside the row of their document, so there is no
    shuffle. A line with several matches counts several times.
    """
    if glob:
        docs = docs.filter(F.col(path).rlike(glob_regex(glob)))
    regex = ("(?i)" if case_insensitive else "") + pattern
    if not any(mark in pattern for mark in TEXT_ANCHORS):
        # the whole text is tested first, so documents without a match are not split
        docs = docs.filter(F.col(text).rlike("(?m)" + regex))
    lines = F.split(F.col(text), "\n")
    tagged = F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), line.alias("line")))
    hits = docs.select(F.col(path).alias("path"), lines.alias("_lines"), tagged.alias("_tagged")).select(
        "path",
        F.transform(
            F.filter("_tagged", lambda e: e["line"].rlike(regex)),
            lambda e: F.struct(
                e["n"].alias("line_number"),
                e["line"].alias("line_content"),
                _slice("_lines", e["n"] - context_lines, e["n"] - 1).alias("context_before"),
                _slice("_lines", e["n"] + 1, e["n"] + context_lines).alias("context_after"),
            ),
        ).alias("_hits"),
    )
    found = hits.select("path", F.inline("_hits"))
    times = F.sequence(F.lit(1), F.regexp_count("line_content", F.lit(regex)))
    return found.withColumn("match_number", F.explode(times))


def _slice(lines: str, first: Column, last: Column) -> Column:
    """Lines ``first..last`` (1-based), clipped to the document."""
    start = F.greatest(first, F.lit(1))
    size = F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))
    return F.slice(F.col(lines), start, size)


def grep_report(matches: DataFrame, max_results: int = 100) -> DataFrame:
    """First matches in path and line order, each with the true total."""
    total = matches.agg(F.count(F.lit(1))).scalar()
    cut = matches.orderBy("path", "line_number", "match_number").limit(max_results)
    return cut.withColumn("total_matches", total)
