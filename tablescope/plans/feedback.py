"""Feedback reconciliation queries."""

from pyspark.sql import functions as F

from tablescope.operators import feedback as fb
from tablescope.plans.chats import FEEDBACK_SQL, MSGS_SQL, PARTS_SQL, feedback, msgs, parts
from tablescope.plans.registry import query

START, END = "1996-01-01", "2024-01-20"


@query("fb_window_totals", "FB-01", oracle=f"""WITH live AS (SELECT message_id FROM ({MSGS_SQL})
      WHERE chat_id NOT IN (SELECT s_suppkey * 3 FROM supplier)),
    w AS (SELECT 'errors' AS k FROM ({PARTS_SQL}) JOIN live USING (message_id) WHERE tool_state = 'output-error'
        AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' UNION ALL
      SELECT 'downvotes' FROM ({FEEDBACK_SQL}) JOIN live USING (message_id) WHERE vote = 'down'
        AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}' UNION ALL
      SELECT 'regenerations' FROM ({MSGS_SQL}) JOIN live USING (message_id) WHERE superseded
        AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}')
    SELECT count(*) FILTER (WHERE k = 'errors') AS errors, count(*) FILTER (WHERE k = 'downvotes') AS downvotes,
      count(*) FILTER (WHERE k = 'regenerations') AS regenerations FROM w""")
def _(t):
    runs = t.supplier.select((F.col("s_suppkey") * 3).alias("chat_id"))
    start, end = (F.lit(d).cast("timestamp_ntz") for d in (START, END))
    return fb.window_totals(parts(t), feedback(t), msgs(t), runs, start, end)


READS = "concat('{\"file_path\":\"', source, '/', lang, '\"}') AS tool_input"
COSTS_SQL = """SELECT source || '/' || lang AS file_path, count(*) AS read_count,
    CAST(ceil(sum(least(length(text), 4000)) / 4.0) AS BIGINT) AS total_tokens,
    CAST(floor(ceil(sum(least(length(text), 4000)) / 4.0) / count(*) + 0.5) AS BIGINT) AS avg_tokens,
    CAST(ceil(max(least(length(text), 4000)) / 4.0) AS BIGINT) AS max_tokens, max(length(text)) > 4000 AS truncated
    FROM documents GROUP BY 1 ORDER BY sum(least(length(text), 4000)) DESC, 1 LIMIT 25"""


def costs(t):
    reads = t.documents.selectExpr(READS, "text")
    return fb.read_costs(reads, F.get_json_object("tool_input", "$.file_path"), F.col("text"), 4000)


@query("fb_read_costs", "FB-02", oracle=COSTS_SQL)
def _(t):
    return costs(t)


@query("fb_cost_flags", "FB-03", oracle=f"""WITH c AS ({COSTS_SQL}), m AS (SELECT avg(read_count) AS r, avg(total_tokens) AS tt,
      avg(avg_tokens) AS a FROM c)
    SELECT c.*, CASE WHEN truncated THEN 'truncated_on_read' WHEN total_tokens < 8000 AND max_tokens < 1000 THEN NULL
      WHEN read_count >= greatest(2, r) AND total_tokens >= tt THEN 'frequent_and_expensive'
      WHEN read_count <= 2 AND max_tokens >= 2 * a THEN 'rare_but_outlier' END AS flag FROM c, m""")
def _(t):
    return fb.flag_costs(costs(t))


WHOLE_COSTS_SQL = """SELECT 'u' || o_custkey % 20 AS file_path, count(*) AS read_count,
    CAST(ceil(sum(least(CAST(floor(o_totalprice / 100) AS BIGINT), 100000)) / 4.0) AS BIGINT) AS total_tokens,
    CAST(floor(avg(o_totalprice) / 400) AS BIGINT) AS avg_tokens,
    CAST(floor(max(o_totalprice) / 400) AS BIGINT) AS max_tokens, false AS truncated FROM orders GROUP BY 1"""


@query("fb_cost_flags_orders", "FB-03", oracle=f"""WITH c AS ({WHOLE_COSTS_SQL}), m AS (SELECT avg(read_count) AS r,
      avg(total_tokens) AS tt, avg(avg_tokens) AS a FROM c)
    SELECT file_path, CASE WHEN truncated THEN 'truncated_on_read' WHEN total_tokens < 8000 AND max_tokens < 1000 THEN NULL
      WHEN read_count >= greatest(2, r) AND total_tokens >= tt THEN 'frequent_and_expensive'
      WHEN read_count <= 2 AND max_tokens >= 2 * a THEN 'rare_but_outlier' END AS flag FROM c, m""")
def _(t):
    rows = t.orders.groupBy(F.expr("'u' || o_custkey % 20").alias("file_path")).agg(
        F.count(F.lit(1)).alias("read_count"),
        F.expr("CAST(ceil(sum(least(CAST(floor(o_totalprice / 100) AS BIGINT), 100000)) / 4.0) AS BIGINT)").alias("total_tokens"),
        F.expr("CAST(floor(avg(o_totalprice) / 400) AS BIGINT)").alias("avg_tokens"),
        F.expr("CAST(floor(max(o_totalprice) / 400) AS BIGINT)").alias("max_tokens"),
        F.lit(False).alias("truncated"))
    return fb.flag_costs(rows).select("file_path", "flag")


# recommendations come from parts, their trigger references from lineitem, votes from labels joined to documents
RECS = ["p_partkey AS rec_id", "CASE p_size % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'applied' WHEN 2 THEN 'dismissed' ELSE 'open' END AS status",
        "CAST(p_size AS BIGINT) AS impact_score", "CAST(floor(p_retailprice * 10) AS BIGINT) AS created_at", "p_brand || '.md' AS file",
        "p_type || ' ' || p_name AS subject"]
RECS_SQL = f"SELECT {', '.join(RECS)} FROM part"
REFS = ["l_partkey AS rec_id", "l_suppkey AS chat_id",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS target_id",
        "l_partkey * 100 + l_linenumber AS seq"]
REFS_SQL = f"SELECT {', '.join(REFS)} FROM lineitem"
VOTES_SQL = """SELECT doc_id AS message_id, CASE toxic WHEN 1 THEN 'down' ELSE CASE quality WHEN 0 THEN 'down' ELSE 'up' END END AS vote,
    doc_id % 100 AS chat_id, source FROM labels JOIN documents USING (doc_id)"""


def recs(t):
    return t.part.selectExpr(*RECS)


def refs(t):
    return t.lineitem.selectExpr(*REFS)


def votes(t):
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").selectExpr(
        "doc_id AS message_id", "CASE toxic WHEN 1 THEN 'down' ELSE CASE quality WHEN 0 THEN 'down' ELSE 'up' END END AS vote",
        "doc_id % 100 AS chat_id", "source")


LINKS = ["o_custkey AS rec_id", "o_orderkey % 500 AS message_id"]
LINKS_SQL = f"SELECT DISTINCT {', '.join(LINKS)} FROM orders"


def links(t):
    return t.orders.selectExpr(*LINKS).distinct()


@query("fb_unlinked", "FB-04", oracle=f"""SELECT * FROM ({VOTES_SQL}) WHERE vote = 'down'
    AND message_id NOT IN (SELECT CASE WHEN l_quantity > 30 THEN l_orderkey ELSE -1 END FROM lineitem)""")
def _(t):
    linked = t.lineitem.selectExpr("CASE WHEN l_quantity > 30 THEN l_orderkey ELSE -1 END AS message_id")
    return fb.unlinked_downvotes(votes(t), linked)




@query("fb_attach", "FB-05", oracle=f"""WITH r AS (SELECT s_suppkey AS rec_id, s_nationkey * 4 AS chat_id,
      CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 2 END AS target_id, s_suppkey AS seq FROM supplier),
    tg AS (SELECT target_id, arg_min(rec_id, seq) AS strong FROM r WHERE target_id IS NOT NULL GROUP BY 1),
    ch AS (SELECT chat_id, min(rec_id) AS weak FROM r GROUP BY 1 HAVING count(DISTINCT rec_id) = 1)
    SELECT v.message_id, v.chat_id, coalesce(strong, weak) AS rec_id FROM ({VOTES_SQL}) v
    LEFT JOIN tg ON tg.target_id = v.message_id LEFT JOIN ch ON ch.chat_id = v.chat_id""")
def _(t):
    made = t.supplier.selectExpr("s_suppkey AS rec_id", "CAST(s_nationkey * 4 AS BIGINT) AS chat_id",
                                 "CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 2 END AS target_id", "s_suppkey AS seq")
    return fb.attach_feedback(votes(t), made).select("message_id", "chat_id", "rec_id")


@query("fb_link_owners", "FB-06", oracle=f"""WITH n AS (SELECT DISTINCT rec_id, target_id FROM ({REFS_SQL}) WHERE target_id IS NOT NULL),
    x AS (SELECT l.rec_id, l.message_id, row_number() OVER (PARTITION BY l.message_id ORDER BY (status <> 'dismissed') DESC,
        (n.rec_id IS NOT NULL) DESC, impact_score DESC, created_at DESC, l.rec_id) AS rn
      FROM ({LINKS_SQL}) l JOIN ({RECS_SQL}) r ON r.rec_id = l.rec_id
      LEFT JOIN n ON n.rec_id = l.rec_id AND n.target_id = l.message_id)
    SELECT x.rec_id, x.message_id, o.rec_id AS owner, x.rn > 1 AS stale FROM x JOIN x o ON o.message_id = x.message_id AND o.rn = 1""")
def _(t):
    return fb.link_owners(links(t), recs(t), refs(t)).select("rec_id", "message_id", "owner", "stale")


FP = "sha256('f' || {0} || '.md' || ' ' || 'subject ' || {0})"


def fp(key):
    return fb.fingerprint(F.concat(F.lit("f"), key, F.lit(".md")), F.concat(F.lit("subject "), key))


# events that would record suppliers 20 to 60 record far ones, so that these have no row
KEPT_ID = "(CASE WHEN event_id % 130 BETWEEN 20 AND 60 THEN 1000 + event_id % 130 ELSE event_id % 130 END)"


@query("fb_reconcile", "FB-07", "SQL-07", oracle=f"""WITH e AS (SELECT {FP.format('s_suppkey')} AS fingerprint, s_suppkey AS rec_id,
      CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'applied' ELSE 'dismissed' END AS status FROM supplier),
    rec AS (SELECT {FP.format(KEPT_ID)} AS fingerprint, event_id AS seq, user_id % 10 AS impact_score FROM events),
    last AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq DESC) = 1),
    dis AS (SELECT fingerprint FROM e WHERE status = 'dismissed'),
    res AS (SELECT {FP.format('(p_partkey % 45)')} AS fingerprint FROM part)
    SELECT * FROM (SELECT CASE WHEN seq IS NOT NULL AND rec_id IS NOT NULL THEN 'update'
        WHEN seq IS NOT NULL AND impact_score >= 5 THEN 'insert'
        WHEN seq IS NULL AND status = 'open' AND fingerprint IN (SELECT fingerprint FROM res) THEN 'resolve' END AS action,
      fingerprint, rec_id, seq, impact_score,
      CASE WHEN seq IS NOT NULL AND rec_id IS NOT NULL THEN status = 'applied' END AS reopen
      FROM last FULL JOIN e USING (fingerprint) WHERE fingerprint NOT IN (SELECT fingerprint FROM dis)) WHERE action IS NOT NULL""")
def _(t):
    existing = t.supplier.select(
        fp(F.col("s_suppkey").cast("string")).alias("fingerprint"), F.col("s_suppkey").alias("rec_id"),
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'applied' ELSE 'dismissed' END").alias("status"))
    recorded = t.events.select(fp(F.expr(KEPT_ID).cast("string")).alias("fingerprint"),
                               F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("impact_score"))
    resolved = t.part.select(fp((F.col("p_partkey") % 45).cast("string")).alias("fingerprint"))
    dismissed = existing.filter("status = 'dismissed'").select("fingerprint")
    return fb.reconcile(existing, recorded, resolved, dismissed)


@query("fb_impact", "FB-08", oracle=f"""WITH tot AS (SELECT count(*) AS f FROM ({VOTES_SQL}) WHERE vote = 'down'),
    c AS (SELECT source, count(*) AS n, count(DISTINCT chat_id) AS chats FROM ({VOTES_SQL}) GROUP BY 1)
    SELECT source AS finding_id, chats AS affected_chats, round(least(1.0, n / f), 9) AS failure_share,
      CAST(floor(least(1.0, n / f) * 100 + 0.5) AS BIGINT) + 5 * chats AS impact_score FROM c, tot""")
def _(t):
    v = votes(t)
    totals = v.agg(F.lit(0).alias("errors"), F.count_if(F.col("vote") == "down").alias("downvotes"), F.lit(0).alias("regenerations"))
    findings = v.select(F.col("source").alias("finding_id"), F.lit(1).alias("count"))
    out = fb.impacts(findings, v.select(F.col("source").alias("finding_id"), "chat_id"), totals)
    return out.select("finding_id", "affected_chats", F.round("failure_share", 9).alias("failure_share"), "impact_score")


@query("fb_fingerprints", "FB-09", oracle=f"SELECT rec_id, sha256(file || ' ' || subject) AS fingerprint FROM ({RECS_SQL})")
def _(t):
    return recs(t).select("rec_id", fb.fingerprint(F.col("file"), F.col("subject")).alias("fingerprint"))


@query("fb_set_digest", "FB-09", oracle="""SELECT l_orderkey AS order_id,
    sha256(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR))) AS digest
    FROM lineitem GROUP BY 1""")
def _(t):
    return fb.set_digest(t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_partkey"), "order_id", "l_partkey")


CALLS_SQL = """SELECT DISTINCT l_orderkey AS message_id, CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR)
    ELSE 'call_' || (l_orderkey * 10 + l_linenumber) END AS tool_call_id FROM lineitem"""
TARGETS_SQL = f"""SELECT target_id, arg_max(chat_id, (prio, chat_id)) AS chat_id FROM (
    SELECT CAST(message_id AS VARCHAR) AS target_id, chat_id, 0 AS prio FROM ({MSGS_SQL}) UNION ALL
    SELECT tool_call_id, chat_id, 1 FROM ({CALLS_SQL}) JOIN ({MSGS_SQL}) USING (message_id)) GROUP BY 1"""


def targets(t):
    calls = t.lineitem.selectExpr("l_orderkey AS message_id", """CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS STRING)
        ELSE 'call_' || (l_orderkey * 10 + l_linenumber) END AS tool_call_id""")
    return fb.resolve_targets(msgs(t), calls)


@query("fb_resolve_targets", "FB-11", oracle=TARGETS_SQL)
def _(t):
    return targets(t)


RAW_REFS = ["user_id * 13 AS chat_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id * 2 AS STRING) END AS target_id"]


@query("fb_repair_refs", "FB-10", oracle=f"""SELECT DISTINCT coalesce(g.chat_id, c.c_custkey) AS chat_id, r.target_id
    FROM (SELECT {', '.join(RAW_REFS)} FROM events) r LEFT JOIN ({TARGETS_SQL}) g USING (target_id)
    LEFT JOIN customer c ON c.c_custkey = r.chat_id WHERE coalesce(g.chat_id, c.c_custkey) IS NOT NULL""")
def _(t):
    return fb.repair_refs(t.events.selectExpr(*RAW_REFS), targets(t), t.customer.select(F.col("c_custkey").alias("chat_id")))


@query("fb_recommendations", "FB-12", oracle=f"SELECT * FROM ({RECS_SQL}) WHERE status IN ('open', 'applied')")
def _(t):
    return fb.list_recommendations(recs(t), ["open", "applied"])


@query("fb_linked_feedback", "FB-12", oracle=f"""SELECT l.rec_id, l.message_id, r.status, r.impact_score, v.vote, v.chat_id, v.source
    FROM ({LINKS_SQL}) l JOIN ({RECS_SQL}) r USING (rec_id) JOIN ({VOTES_SQL}) v ON v.message_id = l.message_id""")
def _(t):
    return fb.linked_feedback(links(t), recs(t), votes(t)).select(
        "rec_id", "message_id", "status", "impact_score", "vote", "chat_id", "source")


@query("fb_first_admin", "FB-13", oracle="""SELECT c_nationkey AS project_id, arg_min(c_custkey, (c_acctbal, c_custkey)) AS user_id
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def _(t):
    members = t.customer.selectExpr("c_nationkey AS project_id", "c_custkey AS user_id", "c_acctbal AS created_at",
                                    "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'admin' ELSE 'user' END AS role")
    return fb.first_admin(members)
