"""Conversation, scoped-view and text queries."""

from pyspark.sql import functions as F

from tablescope.functions.text import estimate_tokens, truncate_middle
from tablescope.operators import chats as cr
from tablescope.operators import textjobs as txt
from tablescope.operators import views as vw
from tablescope.plans.registry import query

SECONDS = "(c_custkey * 7919) % 2592000"
CHATS = [
    "c_custkey AS chat_id",
    "CAST(c_nationkey AS BIGINT) AS user_id",
    "c_nationkey % 3 AS project_id",
    "c_mktsegment || ' ' || c_name AS title",
    "'User ' || c_nationkey AS user_name",
    """CASE c_nationkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'user' WHEN 2 THEN 'viewer' ELSE 'Former member' END AS role_name""",
    "c_custkey % 5 = 0 AS is_starred",
    "c_custkey % 13 = 0 AS deleted",
    "CASE WHEN c_custkey % 11 = 0 THEN 'S1' END AS slack_thread",
    "CASE WHEN c_custkey % 17 = 0 THEN 'T1' END AS teams_thread",
    "CASE WHEN c_custkey % 19 = 0 THEN 'W1' END AS whatsapp_thread",
    "CASE WHEN c_custkey % 23 = 0 THEN 'G1' END AS telegram_thread",
    "CASE WHEN c_custkey % 29 = 0 THEN 'M1' END AS mattermost_thread",
]
CHATS_SQL = f"SELECT {', '.join(CHATS)}, make_timestamp((1704067200 + {SECONDS}) * 1000000) AS updated_at FROM customer"
NOW = "TIMESTAMP '2024-01-31 10:00:00'"

MSGS = [
    "o_orderkey AS message_id",
    "o_custkey AS chat_id",
    "o_orderdate AS created_at",
    "CASE o_orderstatus WHEN 'F' THEN 'user' WHEN 'P' THEN 'system' ELSE 'assistant' END AS role",
    "o_orderpriority = '5-LOW' AS superseded",
    """CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'mcp' WHEN 2 THEN 'admin'
        WHEN 3 THEN 'contextRecommendations' WHEN 4 THEN 'slack' ELSE NULL END END AS source""",
    "CASE WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' END END AS provider",
    "CASE o_orderkey % 2 WHEN 0 THEN 'large' ELSE 'small' END AS model_id",
    "CAST(floor(o_totalprice / 60) AS BIGINT) AS total_tokens",
    "CAST(floor(o_totalprice / 300) AS BIGINT) AS input_cache_read_tokens",
    "o_totalprice / 1000000 AS total_cost",
]
MSGS_SQL = f"SELECT {', '.join(MSGS)} FROM orders"
PARTS = [
    "l_orderkey AS message_id",
    "l_linenumber AS ord",
    "CASE l_linestatus WHEN 'F' THEN 'text' ELSE 'tool' END AS type",
    "CASE l_linestatus WHEN 'F' THEN 'part ' || l_partkey || ' of ' || l_suppkey END AS text",
    "CASE l_returnflag WHEN 'A' THEN 'output-error' WHEN 'R' THEN 'output-available' END AS tool_state",
    "CASE l_linenumber % 3 WHEN 0 THEN 'execute_sql' WHEN 1 THEN 'read' ELSE 'grep' END AS tool_name",
    "'call_' || (l_orderkey * 10 + l_linenumber) AS tool_call_id",
    "l_shipdate AS created_at",
]
PARTS_SQL = f"SELECT {', '.join(PARTS)} FROM lineitem"
FEEDBACK = [
    "event_id AS message_id",
    "CASE WHEN event_type IN ('error', 'signup') THEN 'down' ELSE 'up' END AS vote",
    "event_type || ' ' || user_id AS explanation",
    "ts AS created_at",
]
FEEDBACK_SQL = f"SELECT {', '.join(FEEDBACK)} FROM events"


def chats(t):
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("chat_id") * 7919 % 2592000).cast("timestamp_ntz")
    return t.customer.selectExpr(*CHATS).withColumn("updated_at", stamp)


def msgs(t):
    return t.orders.selectExpr(*MSGS)


def parts(t):
    return t.lineitem.selectExpr(*PARTS)


def feedback(t):
    return t.events.selectExpr(*FEEDBACK)


METRICS_SQL = f"""SELECT c.*, coalesce(number_of_messages, 0) AS number_of_messages,
    coalesce(total_tokens, 0) AS total_tokens, coalesce(cache_read_tokens, 0) AS cache_read_tokens,
    coalesce(total_cost, 0) AS total_cost, coalesce(downvotes, 0) AS downvotes, coalesce(upvotes, 0) AS upvotes,
    coalesce(tool_errors, 0) AS tool_errors, coalesce(tool_successes, 0) AS tool_successes,
    coalesce(feedback_text, '') AS feedback_text FROM ({CHATS_SQL}) c
    LEFT JOIN (SELECT chat_id, count(*) AS number_of_messages, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        CAST(sum(input_cache_read_tokens) AS BIGINT) AS cache_read_tokens, sum(total_cost) AS total_cost
      FROM ({MSGS_SQL}) WHERE NOT superseded GROUP BY 1) m USING (chat_id)
    LEFT JOIN (SELECT chat_id, count(*) FILTER (WHERE vote = 'down') AS downvotes, count(*) FILTER (WHERE vote = 'up') AS upvotes,
        string_agg(CASE WHEN vote = 'down' THEN explanation END, ' ' ORDER BY message_id) AS feedback_text
      FROM ({FEEDBACK_SQL}) JOIN (SELECT message_id, chat_id FROM ({MSGS_SQL}) WHERE NOT superseded) USING (message_id)
      GROUP BY 1) f USING (chat_id)
    LEFT JOIN (SELECT chat_id, count(*) FILTER (WHERE tool_state = 'output-error') AS tool_errors,
        count(*) FILTER (WHERE tool_state = 'output-available') AS tool_successes
      FROM ({PARTS_SQL}) JOIN (SELECT message_id, chat_id FROM ({MSGS_SQL}) WHERE NOT superseded) USING (message_id)
      GROUP BY 1) p USING (chat_id)"""
COLUMNS = ["chat_id", "title", "user_name", "role_name", "number_of_messages", "total_tokens", "cache_read_tokens",
           "downvotes", "upvotes", "tool_errors", "tool_successes"]
PICK = ", ".join(COLUMNS)


def metrics(t):
    return cr.chat_metrics(chats(t), msgs(t), parts(t), feedback(t))


@query("cr_metrics", "CR-01", oracle=f"SELECT {PICK}, round(total_cost, 9) AS total_cost, feedback_text FROM ({METRICS_SQL})")
def _(t):
    return metrics(t).select(*COLUMNS, F.round("total_cost", 9).alias("total_cost"), "feedback_text")


SOURCE_SQL = f"""SELECT chat_id, arg_min({{'s': source}}, (created_at, message_id)).s AS source FROM ({MSGS_SQL})
    WHERE role = 'user' AND NOT superseded GROUP BY 1"""


@query("cr_first_source", "CR-02", "VW-02", oracle=SOURCE_SQL)
def _(t):
    return cr.first_user_source(msgs(t))


def like_any(needle):
    return " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '{needle}')" for c in (
        "title", "user_name", "role_name", "number_of_messages", "total_tokens", "downvotes", "upvotes", "tool_errors",
        "tool_successes"))


@query("cr_search", "CR-03", oracle=f"SELECT {PICK} FROM ({METRICS_SQL}) WHERE {like_any('member')} OR {like_any('777')}")
def _(t):
    m = metrics(t)
    return cr.search_chats_table(m, "Member").unionByName(cr.search_chats_table(m, "777")).select(*COLUMNS).distinct()


FACETED = f"""SELECT {PICK} FROM ({METRICS_SQL}) LEFT JOIN ({SOURCE_SQL}) USING (chat_id)
    WHERE role_name IN ('admin', 'Former member') AND source IN ('web', 'slack') AND (tool_errors > 0
      OR (tool_errors = 0 AND tool_successes = 0)) AND (downvotes > 0 OR upvotes > 0)"""


@query("cr_facet_filters", "CR-04", oracle=FACETED)
def _(t):
    rows = metrics(t).join(cr.first_user_source(msgs(t)), "chat_id", "left")
    return cr.filter_facets(rows, {
        "userRole": ["admin", "Former member"], "source": ["web", "slack"],
        "toolState": ["toolsWithErrors", "noToolsUsed"], "feedback": ["hasDownvotes", "hasUpvotes"], "userName": [],
    }).select(*COLUMNS)


@query("cr_day_range", "CR-05", oracle=f"""SELECT chat_id, updated_at FROM ({CHATS_SQL})
    WHERE updated_at >= TIMESTAMP '2024-01-10' AND updated_at < TIMESTAMP '2024-01-13'""")
def _(t):
    return cr.filter_days(chats(t), "updated_at", "2024-01-10", "2024-01-12").select("chat_id", "updated_at")


def page_sql(order, offset, limit):
    return f"""SELECT {PICK}, (SELECT count(*) FROM customer) AS total FROM ({METRICS_SQL})
        ORDER BY {order}, updated_at DESC, chat_id LIMIT {limit} OFFSET {offset}"""


TIER = "CASE WHEN downvotes = 0 AND upvotes = 0 THEN 0 WHEN downvotes = 0 THEN 1 ELSE 2 END"


@query("cr_tiered_sort", "CR-06", "CR-08", oracle=page_sql(f"{TIER} DESC, downvotes DESC", 30, 30))
def _(t):
    return cr.chat_page(metrics(t), [("feedback", True)], 1, 30).select(*COLUMNS, "total")


@query("cr_multi_sort", "CR-07", "CR-08", oracle=page_sql("role_name ASC, number_of_messages DESC", 100, 50))
def _(t):
    return cr.chat_page(metrics(t), [("role_name", False), ("number_of_messages", True)], 2, 50).select(*COLUMNS, "total")


STATE = "CASE WHEN tool_errors > 0 THEN 'toolsWithErrors' WHEN tool_successes > 0 THEN 'toolsNoErrors' ELSE 'noToolsUsed' END"


@query("cr_facet_counts", "CR-09", "SQL-20", oracle=f"""WITH m AS ({METRICS_SQL})
    SELECT 'userName' AS facet, user_name AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL
    SELECT 'userRole', role_name, count(*) FROM m GROUP BY 2 UNION ALL
    SELECT 'toolState', {STATE}, count(*) FROM m GROUP BY 2""")
def _(t):
    return cr.facet_counts(metrics(t))


@query("cr_search_user_chats", "CR-10", oracle=f"""WITH c AS ({CHATS_SQL}), hit AS (
      SELECT message_id, arg_min(text, (ord, text)) AS matched_text FROM ({PARTS_SQL}) WHERE contains(lower(text), 'part 77') GROUP BY 1),
    said AS (SELECT chat_id, arg_min(matched_text, message_id) AS matched_text FROM hit JOIN ({MSGS_SQL}) USING (message_id) GROUP BY 1),
    titled AS (SELECT chat_id, title, updated_at, 0 AS tier, CAST(NULL AS VARCHAR) AS matched_text FROM c WHERE contains(lower(title), 'part 77'))
    SELECT * FROM (SELECT * FROM titled UNION ALL SELECT chat_id, title, updated_at, 1, said.matched_text FROM c JOIN said USING (chat_id)
      WHERE chat_id NOT IN (SELECT chat_id FROM titled)) ORDER BY tier, updated_at DESC, chat_id LIMIT 10""")
def _(t):
    return cr.search_user_chats(chats(t), msgs(t), parts(t), "Part 77")


@query("cr_search_titles", "CR-10", oracle=f"""SELECT chat_id, title, updated_at, 0 AS tier, CAST(NULL AS VARCHAR) AS matched_text
    FROM ({CHATS_SQL}) WHERE contains(lower(title), 'building') ORDER BY updated_at DESC, chat_id LIMIT 10""")
def _(t):
    return cr.search_user_chats(chats(t), msgs(t), parts(t), "BUILDING")


@query("cr_search_own_chats", "CR-10", oracle=f"""WITH c AS (SELECT * FROM ({CHATS_SQL}) WHERE user_id = 7 AND NOT deleted AND chat_id % 7 <> 0),
    hit AS (SELECT message_id, arg_min(text, (ord, text)) AS matched_text FROM ({PARTS_SQL}) WHERE contains(lower(text), 'part 7') GROUP BY 1),
    said AS (SELECT chat_id, arg_min(matched_text, message_id) AS matched_text FROM hit JOIN ({MSGS_SQL}) USING (message_id) GROUP BY 1)
    SELECT chat_id, title, updated_at, 1 AS tier, said.matched_text FROM c JOIN said USING (chat_id)
    ORDER BY updated_at DESC, chat_id LIMIT 10""")
def _(t):
    runs = t.customer.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("chat_id"))
    return cr.search_user_chats(cr.own_chats(chats(t), 7, runs), msgs(t), parts(t), "Part 7")


PLATFORM_SQL = f"""SELECT c.*, CASE WHEN slack_thread IS NOT NULL THEN 'Slack' WHEN teams_thread IS NOT NULL THEN 'Teams'
      WHEN whatsapp_thread IS NOT NULL THEN 'WhatsApp' WHEN telegram_thread IS NOT NULL THEN 'Telegram'
      WHEN mattermost_thread IS NOT NULL THEN 'Mattermost'
      WHEN EXISTS (SELECT 1 FROM ({MSGS_SQL}) m WHERE m.chat_id = c.chat_id AND m.source = 'mcp') THEN 'MCP'
      WHEN EXISTS (SELECT 1 FROM ({MSGS_SQL}) m WHERE m.chat_id = c.chat_id AND m.source = 'contextRecommendations') THEN 'Context recommendations'
      WHEN EXISTS (SELECT 1 FROM ({MSGS_SQL}) m WHERE m.chat_id = c.chat_id AND m.source = 'admin') THEN 'Admin'
      ELSE 'Web' END AS platform FROM ({CHATS_SQL}) c"""


@query("cr_platform", "CR-11", oracle=f"SELECT chat_id, platform FROM ({PLATFORM_SQL})")
def _(t):
    return cr.with_platform(chats(t), msgs(t)).select("chat_id", "platform")


SHARES = ["s_suppkey AS share_id", "s_suppkey * 7 AS chat_id",
          "CASE s_suppkey % 3 WHEN 0 THEN 'project' ELSE 'specific' END AS visibility"]
SHARES_SQL = f"SELECT {', '.join(SHARES)} FROM supplier"
ACCESS = ["p_partkey % 97 AS share_id", "CAST(p_size AS BIGINT) AS user_id"]
ACCESS_SQL = f"SELECT {', '.join(ACCESS)} FROM part"
MEMBERS = ["n_regionkey % 3 AS project_id", "CAST(n_nationkey AS BIGINT) AS user_id"]
MEMBERS_SQL = f"SELECT {', '.join(MEMBERS)} FROM nation"
SHARED_SQL = f"""SELECT DISTINCT c.chat_id FROM ({SHARES_SQL}) s JOIN ({CHATS_SQL}) c USING (chat_id)
    WHERE NOT c.deleted AND c.user_id <> 7 AND ((s.visibility = 'project' AND c.project_id IN
        (SELECT project_id FROM ({MEMBERS_SQL}) WHERE user_id = 7))
      OR (s.visibility = 'specific' AND s.share_id IN (SELECT share_id FROM ({ACCESS_SQL}) WHERE user_id = 7)))"""
VISIBLE_SQL = f"""SELECT *, 'own' AS kind FROM ({CHATS_SQL}) WHERE user_id = 7 AND NOT deleted UNION ALL
    SELECT *, 'shared' AS kind FROM ({CHATS_SQL}) WHERE chat_id IN ({SHARED_SQL})"""


def visible(t):
    return cr.visible_chats(chats(t), t.supplier.selectExpr(*SHARES), t.part.selectExpr(*ACCESS),
                            t.nation.selectExpr(*MEMBERS), F.lit(7))


@query("cr_visibility", "CR-12", oracle=f"SELECT chat_id, kind FROM ({VISIBLE_SQL})")
def _(t):
    return visible(t).select("chat_id", "kind")


@query("cr_no_automations", "CR-13", "SQL-05", oracle=f"""SELECT chat_id, title FROM ({CHATS_SQL})
    WHERE chat_id NOT IN (SELECT s_suppkey * 3 FROM supplier)""")
def _(t):
    runs = t.supplier.select((F.col("s_suppkey") * 3).alias("chat_id"))
    return cr.without_automations(chats(t), runs).select("chat_id", "title")


@query("cr_list_filters", "CR-14", oracle=f"SELECT chat_id, kind FROM ({VISIBLE_SQL}) WHERE is_starred OR kind = 'shared'")
def _(t):
    return cr.filter_list(visible(t), ["starred", "shared_with_me"]).select("chat_id", "kind")


GROUP_SQL = f"""CASE WHEN updated_at >= date_trunc('day', {NOW}) THEN 'Today'
    WHEN updated_at >= date_trunc('day', {NOW}) - INTERVAL 1 DAY THEN 'Yesterday'
    WHEN updated_at >= date_trunc('week', {NOW}) THEN 'This week' ELSE 'Older' END"""


@query("cr_date_groups", "CR-15", oracle=f"SELECT chat_id, {GROUP_SQL} AS label FROM ({CHATS_SQL})")
def _(t):
    return chats(t).select("chat_id", cr.date_group(F.col("updated_at"), F.expr("TIMESTAMP_NTZ '2024-01-31 10:00:00'")).alias("label"))


@query("cr_group_sizes", "CR-16", oracle=f"""SELECT 'owner' AS grouping, user_name AS label, count(*) AS chats, max(updated_at) AS updated_at
    FROM ({CHATS_SQL}) GROUP BY 2 UNION ALL
    SELECT 'star', CASE WHEN is_starred THEN 'Starred' ELSE 'Chats' END, count(*), max(updated_at) FROM ({CHATS_SQL}) GROUP BY 2
    UNION ALL SELECT 'platform', platform, count(*), max(updated_at) FROM ({PLATFORM_SQL}) GROUP BY 2""")
def _(t):
    rows = cr.with_platform(chats(t), msgs(t))
    sets = {"owner": (F.col("user_name"), None), "star": (cr.star_group(F.col("is_starred")), None),
            "platform": (F.col("platform"), cr.platform_rank(F.col("platform")))}
    out = None
    for name, (label, rank) in sets.items():
        part = cr.group_sizes(rows, label, rank).select(F.lit(name).alias("grouping"), "label", "chats", "updated_at")
        out = part if out is None else out.unionByName(part)
    return out


@query("cr_transcript", "CR-17", oracle=f"""SELECT m.chat_id, m.message_id, m.role, p.ord, p.type, p.text FROM ({MSGS_SQL}) m
    JOIN ({PARTS_SQL}) p USING (message_id) JOIN ({CHATS_SQL}) c ON c.chat_id = m.chat_id
    WHERE NOT m.superseded AND NOT c.deleted""")
def _(t):
    return cr.transcript(msgs(t), parts(t), chats(t)).select("chat_id", "message_id", "role", "ord", "type", "text")


TEXTS_SQL = f"""SELECT message_id, string_agg(text, ' ' ORDER BY ord, text) AS text FROM ({PARTS_SQL})
    WHERE type = 'text' GROUP BY 1"""


@query("cr_message_texts", "CR-18", oracle=TEXTS_SQL)
def _(t):
    return cr.message_texts(parts(t))


@query("cr_recent_feedback", "CR-18", oracle=f"""WITH f AS (SELECT * FROM ({FEEDBACK_SQL}) ORDER BY created_at DESC, message_id DESC LIMIT 50)
    SELECT f.*, x.text FROM f LEFT JOIN ({TEXTS_SQL}) x USING (message_id)""")
def _(t):
    return cr.recent_feedback(feedback(t), parts(t), 50)


@query("cr_message_lengths", "CR-19", oracle=f"""SELECT message_id, chat_id, role, CAST(coalesce(chars, 0) AS BIGINT) AS chars
    FROM ({MSGS_SQL}) LEFT JOIN (SELECT message_id, sum(length(text)) AS chars FROM ({PARTS_SQL}) WHERE type = 'text' GROUP BY 1)
    USING (message_id)""")
def _(t):
    return cr.message_lengths(msgs(t), parts(t))


@query("cr_conversation_lengths", "CR-17", "CR-19", oracle="""SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars,
    max(turn) AS last_turn FROM conversations GROUP BY 1""")
def _(t):
    said = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
                                  F.col("conv_id").alias("chat_id"), "role", "turn", "text")
    rows = said.select("message_id", F.col("turn").alias("ord"), F.lit("text").alias("type"), "text")
    lengths = cr.message_lengths(said, rows).join(said.select("message_id", "turn"), "message_id")
    return lengths.groupBy(F.col("chat_id").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("chars").alias("chars"), F.max("turn").alias("last_turn"))


@query("cr_latest_model", "CR-20", oracle=f"""SELECT chat_id, arg_max(provider, (created_at, message_id)) AS provider,
    arg_max(model_id, (created_at, message_id)) AS model_id FROM ({MSGS_SQL})
    WHERE role = 'assistant' AND provider IS NOT NULL GROUP BY 1""")
def _(t):
    return cr.latest_model(msgs(t))


@query("cr_latest_by_json_id", "CR-21", "SQL-17", oracle="""SELECT json_extract_string(props, '$.k') AS json_id,
    max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1""")
def _(t):
    rows = t.events.select("event_id", "value", "props", (F.col("event_type") == "error").alias("superseded"))
    return cr.latest_by_json_id(rows, "props", "$.k", ["event_id"]).select("json_id", "event_id", "value")


@query("cr_members_with_access", "CR-22", oracle="""SELECT c_custkey AS user_id, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN
      CASE s_suppkey % 2 WHEN 0 THEN 'admin' ELSE 'user' END END, CASE WHEN n_nationkey IS NOT NULL THEN 'viewer' END) AS access
    FROM customer LEFT JOIN (SELECT CASE WHEN s_suppkey >= 10 THEN s_suppkey END AS s_suppkey FROM supplier) ON s_suppkey = c_custkey
    LEFT JOIN nation ON n_nationkey = c_custkey WHERE s_suppkey IS NOT NULL OR n_nationkey IS NOT NULL""")
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    project = t.supplier.selectExpr(
        "CASE WHEN s_suppkey >= 10 THEN s_suppkey END AS user_id", "CASE s_suppkey % 2 WHEN 0 THEN 'admin' ELSE 'user' END AS project_role")
    org = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS user_id", "'viewer' AS org_role")
    return cr.members_with_access(users, project, org).select("user_id", "access")


@query("cr_email_domains", "CR-23", oracle="""SELECT DISTINCT lower(c_mktsegment) || c_nationkey || '.example' AS domain
    FROM customer WHERE c_acctbal > 0""")
def _(t):
    users = t.customer.selectExpr("c_name || '@ ' || c_mktsegment || c_nationkey || '.Example ' AS email", "c_acctbal > 0 AS verified")
    return cr.email_domains(users)


# ---- scoped views

USERS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_name AS user_name FROM nation"


@query("vw_messages", "VW-01", "VW-04", oracle=f"""WITH f AS (SELECT message_id, min(ord) AS ord FROM ({PARTS_SQL}) GROUP BY 1),
    v AS (SELECT message_id, ord, vote, explanation FROM ({FEEDBACK_SQL}) JOIN f USING (message_id))
    SELECT p.message_id, p.ord, m.chat_id, c.title, u.user_name, m.role, s.source AS chat_source, v.vote, v.explanation
    FROM ({PARTS_SQL}) p LEFT JOIN v ON v.message_id = p.message_id AND v.ord = p.ord
    JOIN ({MSGS_SQL}) m ON m.message_id = p.message_id JOIN ({CHATS_SQL}) c ON c.chat_id = m.chat_id
    LEFT JOIN ({SOURCE_SQL}) s ON s.chat_id = c.chat_id LEFT JOIN ({USERS_SQL}) u ON u.user_id = c.user_id
    WHERE c.project_id = 1 AND (s.source IS NULL OR s.source <> 'admin')""")
def _(t):
    users = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS user_id", "n_name AS user_name")
    view = vw.messages_view(parts(t), msgs(t), chats(t), feedback(t), users, F.lit(1))
    return vw.scoped_sql(t.spark, """SELECT message_id, ord, chat_id, title, user_name, role, chat_source, vote, explanation
        FROM {v_messages}""", {"v_messages": view})


@query("vw_memories", "VW-03", oracle=f"""SELECT doc_id AS memory_id, doc_id * 3 AS chat_id, lang AS category FROM documents
    WHERE doc_id * 3 IN (SELECT chat_id FROM ({CHATS_SQL}) WHERE project_id = 2)""")
def _(t):
    memories = t.documents.select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") * 3).alias("chat_id"),
                                  F.col("lang").alias("category"))
    return vw.memories_view(memories, chats(t), F.lit(2))


@query("vw_project_rows", "VW-03", "VW-04", oracle="""SELECT 'inference' AS view, o_orderkey AS id, o_orderstatus AS kind FROM orders
    WHERE o_custkey % 3 = 1 UNION ALL SELECT 'call', event_id, event_type FROM events WHERE user_id % 3 = 1""")
def _(t):
    runs = t.orders.selectExpr("o_orderkey AS id", "o_orderstatus AS kind", "o_custkey % 3 AS project_id", "o_totalprice AS hidden")
    calls = t.events.selectExpr("event_id AS id", "event_type AS kind", "user_id % 3 AS project_id", "props AS hidden")
    return (vw.project_view(runs, F.lit(1), ["id", "kind"]).withColumn("view", F.lit("inference"))
            .unionByName(vw.project_view(calls, F.lit(1), ["id", "kind"]).withColumn("view", F.lit("call"))))


@query("vw_events", "VW-03", oracle=f"""SELECT event_id, event_type, user_id AS actor_user_id, user_name AS actor_user_name
    FROM (SELECT * FROM events WHERE event_id % 3 = 1) LEFT JOIN (SELECT user_id AS u, user_name FROM ({USERS_SQL})) ON u = user_id""")
def _(t):
    rows = t.events.selectExpr("event_id", "event_type", "user_id AS actor_user_id", "event_id % 3 AS project_id")
    users = t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS user_id", "n_name AS user_name")
    return vw.events_view(rows, users, F.lit(1)).drop("project_id")


# ---- text


@query("txt_token_estimate", "TXT-01", oracle="""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents""")
def _(t):
    return t.documents.select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("txt_truncate_middle", "TXT-02", oracle="""SELECT doc_id, CASE WHEN length(text) > 50
    THEN substr(text, 1, 23) || '...' || right(text, 24) ELSE text END AS short FROM documents""")
def _(t):
    return t.documents.select("doc_id", truncate_middle(F.col("text"), 50).alias("short"))


@query("txt_redact_columns", "TXT-03", oracle=f"""SELECT message_id, ord, tool_name,
    CASE WHEN tool_name = 'execute_sql' AND text IS NOT NULL THEN '[redacted]' ELSE text END AS text,
    CASE WHEN tool_name = 'execute_sql' THEN '[redacted]' ELSE tool_call_id END AS tool_call_id FROM ({PARTS_SQL})""")
def _(t):
    return txt.redact_columns(parts(t), "tool_name", ["text", "tool_call_id"]).select(
        "message_id", "ord", "tool_name", "text", "tool_call_id")


JSON_PARTS = """CASE event_id % 4
    WHEN 0 THEN concat('[{"toolName":"execute_sql","input":{"q":"select ', event_id, '"},"state":"done"}]')
    WHEN 1 THEN concat('[{"toolName":"grep","input":"', event_type, '"}]')
    WHEN 2 THEN concat('broken execute_sql ', event_id, ' {')
    ELSE props END"""


@query("txt_redact_json", "TXT-03", oracle=f"""SELECT event_id, CASE event_id % 4
    WHEN 0 THEN '[{{"input":"[redacted]","state":"done","toolName":"execute_sql"}}]' WHEN 2 THEN '[redacted]'
    ELSE {JSON_PARTS} END AS body FROM events""")
def _(t):
    body = txt.redact_json(F.expr(JSON_PARTS))
    # key order is not part of JSON: print the rebuilt entry with sorted keys
    sorted_ = F.regexp_replace(body, r'^\[\{"toolName":"execute_sql",("input":.*)\}\]$', '[{$1,"toolName":"execute_sql"}]')
    return t.events.select("event_id", sorted_.alias("body"))


GREP_SQL = """WITH l AS (SELECT doc_id, 'docs/' || source || '/' || doc_id || '.' || lang AS path,
      string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS line_number FROM l),
    h AS (SELECT path, CAST(line_number AS INTEGER) AS line_number, ls[line_number] AS line_content,
      array_to_string(ls[greatest(line_number - 1, 1):line_number - 1], '|') AS context_before,
      array_to_string(ls[line_number + 1:line_number + 1], '|') AS context_after FROM n
      WHERE path LIKE 'docs/src1%.en' AND regexp_matches(ls[line_number], '(?i)\\bwhere\\w*'))
    SELECT path, line_number, line_content, context_before, context_after,
      CAST(unnest(range(1, len(regexp_extract_all(line_content, '(?i)\\bwhere\\w*')) + 1)) AS INTEGER) AS match_number FROM h"""


def grepped(t):
    docs = t.documents.selectExpr("'docs/' || source || '/' || doc_id || '.' || lang AS path", "text")
    return txt.grep(docs, "path", "text", r"\bwhere\w*", "docs/src1*.en", True, 1)


@query("txt_grep", "TXT-04", oracle=GREP_SQL)
def _(t):
    return grepped(t).withColumns({c: F.array_join(c, "|") for c in ("context_before", "context_after")})


@query("txt_grep_report", "TXT-04", oracle=f"""WITH g AS ({GREP_SQL}) SELECT path, line_number, match_number,
    (SELECT count(*) FROM g) AS total_matches FROM g ORDER BY path, line_number, match_number LIMIT 100""")
def _(t):
    return txt.grep_report(grepped(t)).select("path", "line_number", "match_number", "total_matches")
