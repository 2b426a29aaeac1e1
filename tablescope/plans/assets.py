"""Asset, activity and event queries."""

from pyspark.sql import functions as F

from tablescope.operators import activity as act
from tablescope.operators import assets as ast
from tablescope.operators import events as evt
from tablescope.plans.registry import query

# ---- assets: orders are assets, lines their versions, parts a folder tree (parent = key div 10)

VERSIONS = ["l_orderkey AS asset_id", "l_linenumber AS version", "l_partkey AS edit_id", "l_extendedprice AS body"]
VERSIONS_SQL = f"SELECT {', '.join(VERSIONS)} FROM lineitem"
ASSETS = ["o_orderkey AS asset_id", "'Story ' || o_orderkey AS title", "'author ' || o_custkey % 50 AS author",
          "o_custkey AS user_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS chat_id",
          "o_orderstatus = 'P' AS archived", "o_orderdate AS updated_at", "o_orderdate AS created_at",
          "o_custkey % 3 AS project_id"]
ASSETS_SQL = f"SELECT {', '.join(ASSETS)} FROM orders"
LATEST_SQL = f"""SELECT * FROM ({VERSIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY asset_id
    ORDER BY version DESC, edit_id DESC, body DESC) = 1"""


def versions(t):
    return t.lineitem.selectExpr(*VERSIONS)


def assets(t):
    return t.orders.selectExpr(*ASSETS)


def latest(t):
    return ast.latest_versions(versions(t), "asset_id", "version", ["edit_id", "body"])


@query("as_latest_version", "AS-01", "SQL-10", oracle=LATEST_SQL)
def _(t):
    return latest(t)


@query("as_listed", "AS-01", oracle="""SELECT o_orderkey AS asset_id, v.version, o_orderdate AS updated_at FROM orders
    JOIN (SELECT l_orderkey, max(l_linenumber) AS version FROM lineitem GROUP BY 1) v ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P'""")
def _(t):
    return ast.listed_assets(assets(t), versions(t), "asset_id", "version", False).select("asset_id", "version", "updated_at")


@query("as_next_version", "AS-02", oracle="""SELECT o_orderkey AS asset_id, coalesce(max(l_linenumber), 0) + 1 AS next_version
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    return ast.next_version(versions(t), assets(t), "asset_id", "version")


@query("as_history", "AS-02", oracle=VERSIONS_SQL)
def _(t):
    return ast.version_history(versions(t), "asset_id", "version")


SHARES = ["s_suppkey AS share_id", "s_suppkey * 3 AS asset_id", "s_nationkey % 3 AS project",
          "CASE s_suppkey % 4 WHEN 0 THEN 'project' ELSE 'specific' END AS visibility", "s_suppkey % 6 = 0 AS is_pinned"]
SHARES_SQL = f"SELECT {', '.join(SHARES)} FROM supplier"
ACCESS = ["p_partkey % 120 AS share_id", "CAST(p_size AS BIGINT) AS user_id"]
ACCESS_SQL = f"SELECT {', '.join(ACCESS)} FROM part"


def shares(t):
    return t.supplier.selectExpr(*SHARES)


def access(t):
    return t.part.selectExpr(*ACCESS)


@query("as_shared", "AS-03", oracle=f"""SELECT s.share_id, s.asset_id, s.visibility, a.title, v.version,
      coalesce(c.n, 0) AS shared_with_count FROM ({SHARES_SQL}) s JOIN ({ASSETS_SQL}) a USING (asset_id)
    JOIN ({LATEST_SQL}) v ON v.asset_id = s.asset_id
    LEFT JOIN (SELECT share_id, count(user_id) AS n FROM ({ACCESS_SQL}) GROUP BY 1) c ON c.share_id = s.share_id""")
def _(t):
    return ast.shared_assets(shares(t), assets(t), latest(t), access(t)).select(
        "share_id", "asset_id", "visibility", "title", "version", "shared_with_count")


@query("as_visible_shares", "AS-03", oracle=f"""SELECT share_id, asset_id FROM ({SHARES_SQL}) WHERE visibility = 'project'
    OR share_id IN (SELECT share_id FROM ({ACCESS_SQL}) WHERE user_id = 9)""")
def _(t):
    return ast.visible_shares(shares(t), access(t), F.lit(9)).select("share_id", "asset_id")


FOLDERS = ["p_partkey AS folder_id", "CASE WHEN p_partkey > 0 THEN CAST(floor(p_partkey / 10.0) AS BIGINT) END AS parent_id",
           "p_name AS name", "CAST(p_size AS BIGINT) AS owner_id", "CASE p_size % 3 WHEN 0 THEN 'private' ELSE 'public' END AS visibility",
           "p_size % 7 = 0 AS archived"]
FOLDERS_SQL = f"SELECT {', '.join(FOLDERS)} FROM part"


def folders(t):
    return t.part.selectExpr(*FOLDERS)


@query("as_folder_list", "AS-04", oracle=f"""SELECT CAST(f.folder_id AS VARCHAR) AS folder_id, name, coalesce(n, 0) AS asset_count
    FROM ({FOLDERS_SQL}) f LEFT JOIN (SELECT o_custkey AS folder_id, count(*) AS n FROM orders GROUP BY 1) i USING (folder_id)
    WHERE NOT archived AND (visibility = 'public' OR owner_id = 9) UNION ALL
    SELECT * FROM (SELECT '__shared_with_me__', 'Shared with me', count(*) AS c FROM ({ACCESS_SQL}) a JOIN ({SHARES_SQL}) s
      USING (share_id) WHERE a.user_id = 9 AND s.visibility = 'specific') WHERE c > 0""")
def _(t):
    items = t.orders.select(F.col("o_custkey").alias("folder_id"), F.col("o_orderkey").alias("asset_id"))
    return ast.folder_list(folders(t), items, shares(t), access(t), F.lit(9))


@query("as_descendants", "AS-05", oracle=f"""WITH RECURSIVE d(node) AS (SELECT folder_id FROM ({FOLDERS_SQL}) WHERE parent_id = 3
      UNION SELECT f.folder_id FROM ({FOLDERS_SQL}) f JOIN d ON f.parent_id = d.node) SELECT node FROM d WHERE node <> 3""")
def _(t):
    root = folders(t).filter("folder_id = 3").select(F.col("folder_id").alias("node"))
    return ast.descendants(folders(t), "folder_id", "parent_id", root)


@query("as_move_cycle", "AS-06", oracle=f"""WITH RECURSIVE u(node) AS (SELECT 137::BIGINT UNION
      SELECT f.parent_id FROM ({FOLDERS_SQL}) f JOIN u ON f.folder_id = u.node WHERE f.parent_id IS NOT NULL)
    SELECT count(*) FILTER (WHERE node = 13) > 0 AS cycle FROM u""")
def _(t):
    one = (lambda k: folders(t).filter(F.col("folder_id") == k).select(F.col("folder_id").alias("node")))
    return ast.move_makes_cycle(folders(t), "folder_id", "parent_id", one(13), one(137))


# two folders of each hundred point at each other
KNOTTED_SQL = f"""SELECT folder_id, CASE WHEN folder_id % 100 = 40 THEN folder_id + 1 WHEN folder_id % 100 = 41 THEN folder_id - 1
    ELSE parent_id END AS parent_id FROM ({FOLDERS_SQL})"""


@query("as_folder_cycles", "AS-06", oracle=f"""WITH RECURSIVE f AS ({KNOTTED_SQL}), ok(node) AS (
      SELECT folder_id FROM f WHERE parent_id IS NULL OR parent_id NOT IN (SELECT folder_id FROM f)
      UNION SELECT f.folder_id FROM f JOIN ok ON f.parent_id = ok.node)
    SELECT folder_id AS node FROM f WHERE folder_id NOT IN (SELECT node FROM ok)""")
def _(t):
    turn = F.col("folder_id") % 100
    knotted = F.when(turn == 40, F.col("folder_id") + 1).when(turn == 41, F.col("folder_id") - 1).otherwise(F.col("parent_id"))
    return ast.folder_cycles(folders(t).withColumn("parent_id", knotted), "folder_id", "parent_id")


@query("as_private_context", "AS-07", oracle=f"""WITH RECURSIVE f AS ({FOLDERS_SQL}), a(folder_id, up) AS (
      SELECT folder_id, folder_id FROM f UNION SELECT a.folder_id, f.parent_id FROM a JOIN f ON f.folder_id = a.up
      WHERE f.parent_id IS NOT NULL AND f.parent_id <> a.up)
    SELECT a.folder_id, bool_or(g.visibility = 'private') AS is_private FROM a JOIN f g ON g.folder_id = a.up GROUP BY 1""")
def _(t):
    return ast.private_context(folders(t), "folder_id", "parent_id", F.col("visibility") == "private")


ITEM = """'t' || {0} AS title, 'author ' || ({0} % 9) AS author, {1} AS created_at,
    CASE WHEN {0} % 3 = 0 THEN NULL ELSE {0} % 5 END AS folder_id, {0} % 6 = 0 AS is_pinned, {0} % 4 = 0 AS is_favorited"""
OWN_SQL = f"SELECT o_orderkey AS asset_id, {ITEM.format('o_orderkey', 'o_orderdate')} FROM orders WHERE o_orderstatus = 'F'"
ALONE_SQL = f"SELECT o_orderkey AS asset_id, {ITEM.format('o_orderkey', 'o_orderdate')} FROM orders WHERE o_orderstatus = 'P'"
OTHERS_SQL = f"""SELECT l_orderkey AS asset_id, {ITEM.format('l_orderkey', 'min(l_shipdate)')},
    CASE WHEN l_orderkey % 2 = 0 THEN 'specific' ELSE 'project' END AS visibility FROM lineitem GROUP BY l_orderkey"""
ITEMS_SQL = f"""SELECT *, 'own' AS kind FROM ({OWN_SQL}) UNION ALL SELECT *, 'own-standalone' FROM ({ALONE_SQL}) UNION ALL
    SELECT asset_id, title, author, created_at, folder_id, is_pinned, is_favorited,
      CASE WHEN visibility = 'specific' THEN 'shared-with-me' ELSE 'shared-project' END FROM ({OTHERS_SQL})
    WHERE asset_id NOT IN (SELECT asset_id FROM ({OWN_SQL}) UNION SELECT asset_id FROM ({ALONE_SQL}))"""


def split_exprs(text):
    """The select list of a flat SELECT ... FROM as expressions."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def items(t):
    def made(status):
        exprs = split_exprs(ITEM.format("o_orderkey", "o_orderdate"))
        return t.orders.filter(F.col("o_orderstatus") == status).selectExpr("o_orderkey AS asset_id", *exprs)

    shipped = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    others = shipped.selectExpr("l_orderkey AS asset_id", *split_exprs(ITEM.format("l_orderkey", "shipped")),
                                "CASE WHEN l_orderkey % 2 = 0 THEN 'specific' ELSE 'project' END AS visibility")
    return ast.asset_items(made("F"), made("P"), others)


@query("as_items", "AS-08", oracle=ITEMS_SQL)
def _(t):
    return items(t)


@query("as_item_level", "AS-08", oracle=f"""SELECT asset_id, title, kind, CASE WHEN is_pinned THEN 'pinned' WHEN is_favorited
    THEN 'favorite' ELSE 'entry' END AS section FROM ({ITEMS_SQL}) WHERE folder_id = 2 AND kind <> 'shared-with-me'
    AND (contains(lower(title), '12') OR contains(lower(author), '12'))""")
def _(t):
    level = ast.folder_level(ast.search_items(items(t), "12"), F.lit(2))
    return ast.sort_items(ast.item_sections(level), "created_at", True).select("asset_id", "title", "kind", "section")


@query("as_favorites", "AS-09", oracle=f"""SELECT a.asset_id FROM (SELECT event_id AS asset_id, user_id FROM events) m
    JOIN ({ASSETS_SQL}) a USING (asset_id) LEFT JOIN (SELECT c_custkey AS chat_id, c_nationkey % 3 AS cp FROM customer) c
    ON c.chat_id = a.chat_id WHERE m.user_id = 8 AND coalesce(cp, a.project_id) = 1""")
def _(t):
    marks = t.events.select(F.col("event_id").alias("asset_id"), "user_id")
    chats = t.customer.selectExpr("c_custkey AS chat_id", "c_nationkey % 3 AS project_id")
    return ast.favorites(marks, assets(t).drop("user_id"), chats, F.lit(8), F.lit(1))


@query("as_cache_validity", "AS-10", oracle="""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false
    ELSE o_orderdate < date_trunc('month', o_orderdate) + INTERVAL 9 DAY END AS expired FROM orders""")
def _(t):
    run = F.when(F.col("o_orderkey") % 5 != 0, F.date_trunc("month", "o_orderdate") + F.expr("INTERVAL 9 DAY"))
    return t.orders.select("o_orderkey", ast.cache_expired(F.col("o_orderdate"), run).alias("expired"))


@query("as_backfill", "AS-10", oracle="""WITH c AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders),
    h AS (SELECT l_orderkey AS query_id, max(l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS query_id, coalesce(c.v, h.v) AS v FROM orders LEFT JOIN c ON c.query_id = o_orderkey
    LEFT JOIN h ON h.query_id = o_orderkey""")
def _(t):
    wanted = t.orders.select(F.col("o_orderkey").alias("query_id"))
    cached = t.orders.selectExpr("CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS query_id", "o_totalprice AS v")
    history = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.max("l_extendedprice").alias("v"))
    return ast.backfill(wanted, cached, history, ["query_id"], "v")


@query("as_unexpired", "AS-11", oracle="""SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def _(t):
    now = t.events.agg(F.max("ts")).scalar()
    return ast.unexpired(t.events, "ts", now).select("event_id")


# ---- activity

ACTIVITIES = ["event_id AS activity_id",
              "CASE event_type WHEN 'click' THEN 'story.shared' WHEN 'view' THEN 'chat.shared' ELSE 'story.refreshed' END AS type",
              "CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id", "event_id % 3000 AS asset_id",
              "event_id % 110 AS share_id", "ts AS created_at"]
ACTIVITIES_SQL = f"SELECT {', '.join(ACTIVITIES)} FROM events"


@query("act_feed", "ACT-01", oracle=f"""WITH a AS ({ACTIVITIES_SQL}), own AS (SELECT o_orderkey AS i FROM orders WHERE o_custkey = 8),
    sh AS (SELECT asset_id AS i FROM ({SHARES_SQL}) WHERE visibility = 'project'),
    vs AS (SELECT share_id AS i FROM ({SHARES_SQL}) WHERE visibility = 'project' OR share_id IN
      (SELECT share_id FROM ({ACCESS_SQL}) WHERE user_id = 8))
    SELECT activity_id, type, created_at FROM a WHERE
      (type = 'story.refreshed' AND (user_id = 8 OR asset_id IN (SELECT i FROM own) OR asset_id IN (SELECT i FROM sh)))
      OR (type <> 'story.refreshed' AND user_id <> 8 AND share_id IN (SELECT i FROM vs))
    ORDER BY created_at DESC, activity_id DESC LIMIT 200""")
def _(t):
    owned = t.orders.filter("o_custkey = 8").select(F.col("o_orderkey").alias("asset_id"))
    seen = ast.visible_shares(shares(t), access(t), F.lit(8))
    wide = shares(t).filter("visibility = 'project'").select("asset_id")
    return act.audience_feed(t.events.selectExpr(*ACTIVITIES), owned, wide, seen, seen, F.lit(8), 200).select(
        "activity_id", "type", "created_at")


RUNS = ["event_id AS run_id", "user_id AS automation_id", "ts AS started_at",
        "CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS status",
        "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props END AS error",
        "CASE WHEN event_type IN ('error', 'view') THEN ts END AS completed_at"]
RUNS_SQL = f"SELECT {', '.join(RUNS)} FROM events"


def runs(t):
    return t.events.selectExpr(*RUNS)


@query("act_stale_runs", "ACT-02", oracle=f"""WITH r AS ({RUNS_SQL}), s AS (SELECT *, status = 'running' AND
      started_at <= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTE AS stale FROM r)
    SELECT run_id, CASE WHEN stale THEN 'failed' ELSE status END AS status,
      CASE WHEN stale THEN TIMESTAMP '2024-01-20 12:00:00' ELSE completed_at END AS completed_at FROM s""")
def _(t):
    return act.fail_stale(runs(t), F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'")).select("run_id", "status", "completed_at")


@query("act_merged_feed", "ACT-03", oracle="""SELECT * FROM (SELECT event_id AS id, 'event' AS feed, ts AS happened, event_type AS note, NULL AS amount
    FROM events UNION ALL SELECT o_orderkey, 'order', o_orderdate + INTERVAL 9000 DAY, NULL, o_totalprice FROM orders)
    ORDER BY happened DESC, feed, id LIMIT 100""")
def _(t):
    a = t.events.selectExpr("event_id AS id", "'event' AS feed", "ts AS happened", "event_type AS note")
    b = t.orders.selectExpr("o_orderkey AS id", "'order' AS feed", "o_orderdate + INTERVAL 9000 DAY AS happened", "o_totalprice AS amount")
    return act.merge_feeds(a, b, [F.col("happened").desc(), F.col("feed"), F.col("id")], 100)


@query("act_latest_runs", "ACT-04", oracle=f"""SELECT automation_id, run_id, status FROM ({RUNS_SQL})
    QUALIFY row_number() OVER (PARTITION BY automation_id ORDER BY started_at DESC, run_id DESC) = 1""")
def _(t):
    return act.latest_runs(runs(t), "automation_id").select("automation_id", "run_id", "status")


@query("act_run_history", "ACT-04", oracle=f"""SELECT automation_id, run_id, status, rank FROM (SELECT *, CAST(row_number() OVER
    (PARTITION BY automation_id ORDER BY started_at DESC, run_id DESC) AS INTEGER) AS rank FROM ({RUNS_SQL}) WHERE run_id <> 77)
    WHERE rank <= 10""")
def _(t):
    return act.run_history(runs(t), "automation_id", F.lit(77)).select("automation_id", "run_id", "status", "rank")


@query("act_latest_failures", "ACT-05", oracle=f"""SELECT automation_id, coalesce(error, 'Refresh failed.') AS error,
    coalesce(completed_at, started_at) AS failed_at FROM (SELECT * FROM ({RUNS_SQL})
      QUALIFY row_number() OVER (PARTITION BY automation_id ORDER BY started_at DESC, run_id DESC) = 1) WHERE status = 'failed'""")
def _(t):
    return act.latest_failures(runs(t), "automation_id")


LOGS = ["event_id AS log_id", "event_type AS level", "'src' || user_id % 4 AS source", "ts AS created_at"]


@query("act_logs", "ACT-06", oracle=f"""SELECT * FROM (SELECT {', '.join(LOGS)} FROM events) WHERE level = 'error' AND source = 'src1'
    AND created_at >= TIMESTAMP '2024-01-10' ORDER BY created_at DESC, log_id DESC LIMIT 100""")
def _(t):
    return act.list_logs(t.events.selectExpr(*LOGS), "error", "src1", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), 100)


@query("act_log_retention", "ACT-06", oracle=f"""SELECT * FROM (SELECT {', '.join(LOGS)} FROM events)
    WHERE created_at >= TIMESTAMP '2024-01-25'""")
def _(t):
    return act.keep_recent_logs(t.events.selectExpr(*LOGS), F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"))


MEMORIES = ["event_id AS memory_id", "user_id", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 20 END AS chat_id", "ts AS created_at"]
ADDED = ["1000000000 + o_orderkey AS memory_id", "o_custkey % 150 AS user_id", "o_custkey % 20 AS chat_id",
         "o_orderdate AS created_at", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_orderkey / 2) AS BIGINT) END AS supersedes_id"]
SUPERSEDED_SQL = f"""SELECT m.*, x.by AS superseded_by FROM (SELECT {', '.join(MEMORIES)} FROM events UNION ALL
      SELECT memory_id, user_id, chat_id, created_at FROM (SELECT {', '.join(ADDED)} FROM orders)) m
    LEFT JOIN (SELECT supersedes_id, max(memory_id) AS by FROM (SELECT {', '.join(ADDED)} FROM orders)
      WHERE supersedes_id IS NOT NULL GROUP BY 1) x ON x.supersedes_id = m.memory_id"""


def superseded(t):
    old = t.events.selectExpr(*MEMORIES, "CAST(NULL AS BIGINT) AS superseded_by")
    return act.supersede(old, t.orders.selectExpr(*ADDED))


@query("act_supersede", "ACT-07", oracle=SUPERSEDED_SQL)
def _(t):
    return superseded(t)


@query("act_active_memories", "ACT-07", oracle=f"""SELECT memory_id, chat_id FROM ({SUPERSEDED_SQL}) WHERE user_id = 8
    AND superseded_by IS NULL AND (chat_id IS NULL OR chat_id <> 5)""")
def _(t):
    return act.active_memories(superseded(t), F.lit(8), F.lit(5)).select("memory_id", "chat_id")


# ---- events

EVENTS = ["event_id", "ts AS created_at",
          "CASE event_type WHEN 'click' THEN 'page_view' WHEN 'view' THEN 'view_duration' WHEN 'purchase' THEN 'download' "
          "WHEN 'signup' THEN 'favorite' ELSE 'page_view' END AS type",
          "CASE WHEN user_id % 10 = 3 THEN NULL ELSE user_id % 15 END AS actor_user_id",
          "CASE WHEN event_id % 5 = 0 THEN 'chat' ELSE 'story' END AS asset_type", "user_id % 4 AS story_id",
          "user_id % 6 AS chat_id", "CAST(floor(value * 20000) AS BIGINT) AS duration_ms",
          "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 7 AS INT) END AS version",
          "CASE WHEN value < 20 THEN 'added' ELSE 'removed' END AS badge"]
EVENTS_SQL = f"SELECT {', '.join(EVENTS)} FROM events"


def events(t):
    return t.events.selectExpr(*EVENTS)


def asset_sql(where):
    return f"""SELECT e.*, n_name AS actor_name FROM (SELECT * FROM ({EVENTS_SQL}) WHERE {where}
        ORDER BY created_at DESC, event_id DESC LIMIT 100) e LEFT JOIN nation ON n_nationkey = actor_user_id"""


def users(t):
    return t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS user_id", "n_name AS user_name")


@query("evt_story_events", "EVT-01", oracle=asset_sql("asset_type = 'story' AND story_id = 2"))
def _(t):
    return evt.asset_events(events(t), users(t), "story", F.lit(2), 100)


@query("evt_chat_events", "EVT-01", oracle=asset_sql("chat_id = 4 AND (asset_type = 'chat' OR type = 'download')"))
def _(t):
    return evt.asset_events(events(t), users(t), "chat", F.lit(4), 100)


THROTTLE_SQL = f"""WITH RECURSIVE e AS ({EVENTS_SQL}),
    l AS (SELECT event_id, actor_user_id AS a, story_id AS s, created_at AS c, row_number() OVER (
        PARTITION BY actor_user_id, story_id ORDER BY created_at, event_id) AS rn
      FROM e WHERE type = 'page_view' AND actor_user_id IS NOT NULL),
    g(event_id, a, s, rn, last, kept) AS (SELECT event_id, a, s, rn, c, true FROM l WHERE rn = 1 UNION ALL
      SELECT l.event_id, l.a, l.s, l.rn, CASE WHEN l.c > g.last + INTERVAL {{0}} SECOND THEN l.c ELSE g.last END,
        l.c > g.last + INTERVAL {{0}} SECOND FROM g JOIN l ON l.a = g.a AND l.s = g.s AND l.rn = g.rn + 1)
    SELECT event_id FROM g WHERE kept UNION ALL
    SELECT event_id FROM e WHERE NOT (type = 'page_view' AND actor_user_id IS NOT NULL)"""


@query("evt_throttle", "EVT-02", oracle=THROTTLE_SQL.format(120))
def _(t):
    return evt.throttle_page_views(events(t), "actor_user_id", ["story_id"]).select("event_id")


LIMITED = "(type = 'page_view' AND actor_user_id IS NOT NULL)"


@query("evt_throttle_wide", "EVT-02", oracle=f"""WITH x AS ({THROTTLE_SQL.format(10800)})
    SELECT event_id FROM x JOIN ({EVENTS_SQL}) USING (event_id) WHERE {LIMITED}""")
def _(t):
    rows = events(t).filter(LIMITED)
    return evt.throttle(rows, ["actor_user_id", "story_id"], "created_at", "event_id", 10800, 86400).select("event_id")


@query("evt_groups", "EVT-03", oracle=f"""SELECT event_id, coalesce(CAST(actor_user_id AS VARCHAR), 'anonymous') AS actor_key,
    max(created_at) OVER w AS last_at, count(*) OVER w AS items FROM ({EVENTS_SQL}) WINDOW w AS (PARTITION BY actor_user_id)""")
def _(t):
    return evt.order_groups(evt.group_by_actor(events(t), "actor_user_id")).select("event_id", "actor_key", "last_at", "items")


SESSIONS_SQL = f"""WITH s AS (SELECT *, coalesce(CAST(actor_user_id AS VARCHAR), 'anonymous') AS actor_key, epoch_us(created_at) // 1000 AS st,
      epoch_us(created_at) // 1000 + duration_ms AS en FROM ({EVENTS_SQL}) WHERE {{0}}),
    p AS (SELECT *, max(en) OVER (PARTITION BY actor_key ORDER BY st, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s),
    f AS (SELECT *, sum(CASE WHEN pe IS NULL OR st - pe >= 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY actor_key ORDER BY st, event_id
      ROWS UNBOUNDED PRECEDING) AS sid FROM p)
    SELECT actor_key, min(created_at) AS started_at, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
      arg_max(version, (st, event_id)) FILTER (WHERE version IS NOT NULL) AS version, count(*) AS segments
    FROM f GROUP BY actor_key, sid"""


@query("evt_sessions", "EVT-04", oracle=SESSIONS_SQL.format("type = 'view_duration'"))
def _(t):
    rows = events(t).filter("type = 'view_duration'").withColumn("actor_key", evt.actor_key("actor_user_id"))
    return evt.sessionise(rows, ["actor_key"], "created_at", "duration_ms", "event_id", "version")


@query("evt_sessions_per_user", "EVT-04", oracle=SESSIONS_SQL.format("true").replace(
    "coalesce(CAST(actor_user_id AS VARCHAR), 'anonymous')", "CAST(story_id * 100 + chat_id AS VARCHAR)"))
def _(t):
    rows = events(t).withColumn("actor_key", (F.col("story_id") * 100 + F.col("chat_id")).cast("string"))
    return evt.sessionise(rows, ["actor_key"], "created_at", "duration_ms", "event_id", "version")


VIEWED = "CASE WHEN actor_user_id % 5 = 0 AND type = 'view_duration' THEN 'page_view' ELSE type END"


@query("evt_viewers", "EVT-05", oracle=f"""WITH e AS (SELECT * REPLACE ({VIEWED} AS type) FROM ({EVENTS_SQL})),
    s AS ({SESSIONS_SQL.format("type = 'view_duration'").replace(f"({EVENTS_SQL})", "e")}),
    v AS (SELECT *, coalesce(CAST(actor_user_id AS VARCHAR), 'anonymous') AS actor_key FROM e WHERE type IN ('page_view', 'view_duration')),
    g AS (SELECT actor_key, max(created_at) AS last_at, CAST(coalesce(sum(CASE WHEN type = 'view_duration' THEN duration_ms END), 0) AS BIGINT)
      AS total_ms FROM v GROUP BY 1)
    SELECT u.*, last_at, total_ms FROM (SELECT actor_key, started_at, duration_ms, version FROM s UNION ALL
      SELECT actor_key, created_at, NULL, version FROM v WHERE type = 'page_view' AND actor_key NOT IN (SELECT actor_key FROM s)) u
    JOIN g USING (actor_key)""")
def _(t):
    rows = events(t).withColumn("type", F.expr(VIEWED))
    return evt.viewers(rows, "actor_user_id", "created_at", "event_id", "created_at", "duration_ms", "version")


@query("evt_favorites", "EVT-06", oracle=f"""SELECT actor_key FROM (SELECT coalesce(CAST(actor_user_id AS VARCHAR), 'anonymous') AS actor_key,
    arg_max(badge, (created_at, event_id)) AS b FROM ({EVENTS_SQL}) WHERE type = 'favorite' GROUP BY 1) WHERE b = 'added'""")
def _(t):
    marks = events(t).filter("type = 'favorite'")
    return evt.current_favorites(marks, "actor_user_id", "badge", "created_at", "event_id")


@query("evt_favorite_count", "EVT-06", oracle=f"""SELECT count(*) AS active FROM (SELECT actor_user_id,
    arg_max(badge, (created_at, event_id)) AS b FROM ({EVENTS_SQL}) WHERE type = 'favorite' GROUP BY 1) WHERE b = 'added'""")
def _(t):
    marks = events(t).filter("type = 'favorite'")
    found = evt.current_favorites(marks, "actor_user_id", "badge", "created_at", "event_id")
    return found.agg(F.count(F.lit(1)).alias("active"))


@query("evt_search_rows", "EVT-07", oracle=f"""SELECT event_id FROM ({EVENTS_SQL})
    WHERE contains(lower(coalesce(CAST(actor_user_id AS VARCHAR), 'anonymous')), '14') OR contains(lower(badge), '14')
      OR contains(lower(CAST(event_id AS VARCHAR)), '14')""")
def _(t):
    rows = events(t).withColumn("actor_key", evt.actor_key("actor_user_id"))
    return evt.search_rows(rows, "actor_key", ["badge", "event_id"], "14").select("event_id")


METADATA = """CASE event_id % 6
    WHEN 0 THEN concat('{"type":"download","format":"pdf","versionNumber":', event_id % 9, ',"title":"t', event_id, '"}')
    WHEN 1 THEN concat('{"type":"page_view","versionNumber":', event_id % 5, '}')
    WHEN 2 THEN concat('{"type":"favorite","favorited":', CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END, '}')
    WHEN 3 THEN '{"type":"refresh","trigger":"manual","versionNumber":4}'
    WHEN 4 THEN '{"type":"fork","scope":"chat"}' ELSE NULL END"""


@query("evt_metadata", "EVT-08", oracle="""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 9 AS INTEGER)
      WHEN 1 THEN CAST(event_id % 5 AS INTEGER) END AS version,
    CASE event_id % 6 WHEN 0 THEN 'pdf' WHEN 2 THEN CASE WHEN event_id % 4 = 0 THEN 'added' ELSE 'removed' END
      WHEN 3 THEN 'manual' WHEN 4 THEN 'chat' END AS badge,
    CASE event_id % 6 WHEN 0 THEN 't' || event_id END AS download_title FROM events""")
def _(t):
    rows = t.events.select("event_id", F.expr(METADATA).alias("metadata"))
    return evt.with_metadata(rows, "metadata").drop("metadata")
