"""Structured Streaming queries: each streams the events table to its end."""

from pyspark.sql import functions as F

from tablescope.plans.assets import EVENTS, EVENTS_SQL, SESSIONS_SQL, THROTTLE_SQL
from tablescope.plans.bindings import CLASSES, MESSAGES, MESSAGES_SQL, priced_sql, prices
from tablescope.plans.registry import query
from tablescope.sources.shared import scratch_path
from tablescope.streaming import streams as st


def event_stream(t):
    return st.read_stream(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)


#: Files a batch of arrivals is written to and read from, by as many tasks.
ARRIVAL_FILES = 12
LIMITED = "type = 'page_view' AND actor_user_id IS NOT NULL"


@query("str_throttle", "STR-01", oracle=f"""WITH x AS ({THROTTLE_SQL.format(1800)})
    SELECT event_id FROM x JOIN ({EVENTS_SQL}) USING (event_id)
    WHERE {LIMITED} AND created_at <= (SELECT date_trunc('milliseconds', max(created_at)) - INTERVAL 1 DAY FROM ({EVENTS_SQL}) WHERE {LIMITED})""")
def _(t):
    # three batches by the time of arrival, up to 20 hours after the event; the watermark is a day behind
    path = scratch_path(t.spark, "throttle-events")
    arrived = F.expr("ts + make_dt_interval(0, event_id % 20)")
    for low, high in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        t.events.filter((arrived >= low) & (arrived < high)).repartition(ARRIVAL_FILES).write.mode("append").parquet(path)
    rows = st.read_stream(t.spark, path, t.events.schema, files_per_batch=ARRIVAL_FILES).selectExpr(*EVENTS).filter(LIMITED)
    kept = st.throttled(rows, ["actor_user_id", "story_id"], "created_at", "event_id", 1800, "1 day")
    return st.append_to_parquet(kept, "throttle")


TOKENS = ["input_no_cache_tokens", "input_cache_read_tokens", "input_cache_write_tokens", "output_tokens", "total_tokens"]
COSTS = [f"{c}_cost" for c in (*CLASSES, "total")]


def usage_sql(label):
    return f"""SELECT strftime(created_at, '{label}') AS date, count(DISTINCT user_id) AS users,
    count(*) FILTER (WHERE role = 'user') AS message_count, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in TOKENS)},
    {', '.join(f'round(sum({c}), 9) AS {c}' for c in COSTS)} FROM ({priced_sql(MESSAGES_SQL)}) GROUP BY 1"""


def hourly_usage(t):
    usage = st.bucketed_usage(event_stream(t).selectExpr(*MESSAGES), "created_at", TOKENS, prices=prices(t))
    return st.upsert_batches(usage, ["start"], "usage")


def rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in COSTS})


@query("str_usage", "STR-02", oracle=usage_sql("%Y-%m-%d %H:00"))
def _(t):
    return rounded(st.merged_usage(hourly_usage(t), "hour"))


@query("str_usage_days", "STR-02", oracle=usage_sql("%Y-%m-%d"))
def _(t):
    return rounded(st.merged_usage(hourly_usage(t), "day"))


# sessions the watermark has passed: an hour behind the newest event, their gap included
CLOSED_SQL = SESSIONS_SQL.format("true").replace("SELECT actor_key, min(created_at) AS started_at",
                                                 "SELECT actor_key, max(en) AS last_end, min(created_at) AS started_at")


@query("str_sessions", "STR-03", oracle=f"""SELECT actor_key, started_at, duration_ms, segments FROM ({CLOSED_SQL})
    WHERE last_end + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""")
def _(t):
    rows = event_stream(t).selectExpr(*EVENTS).withColumn(
        "actor_key", F.coalesce(F.col("actor_user_id").cast("string"), F.lit("anonymous")))
    closed = st.append_to_parquet(st.view_sessions(rows, ["actor_key"], "created_at", "duration_ms"), "sessions")
    return closed.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


RUN_EVENTS = ["CAST(floor(event_id / 14.0) AS BIGINT) * 7 + event_id % 7 AS run_id", "ts",
              "CASE WHEN event_id % 14 < 7 THEN 'start' ELSE 'finish' END AS kind"]


@query("str_stale_runs", "STR-04", oracle=f"""WITH e AS (SELECT {', '.join(RUN_EVENTS)} FROM events),
    r AS (SELECT run_id, max(ts) FILTER (WHERE kind = 'start') AS s, max(ts) FILTER (WHERE kind = 'finish') AS f FROM e GROUP BY 1),
    w AS (SELECT least(max(ts) FILTER (WHERE kind = 'start'), max(ts) FILTER (WHERE kind = 'finish')) - INTERVAL 5 MINUTE AS mark FROM e)
    SELECT run_id, CASE WHEN f - s < INTERVAL 30 MINUTE THEN 'done' ELSE 'failed' END AS status FROM r, w
    WHERE f - s < INTERVAL 30 MINUTE OR s + INTERVAL 30 MINUTE < mark""")
def _(t):
    side = (lambda kind: event_stream(t).selectExpr(*RUN_EVENTS).filter(F.col("kind") == kind))
    return st.append_to_parquet(st.run_outcomes(side("start"), side("finish"), "run_id", "ts"), "runs")


@query("str_late_data", "STR-05", oracle="""SELECT count(*) AS seen, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-12') AS counted,
    count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-12') AS late FROM events""")
def _(t):
    # newer days arrive first, one file per batch; a watermark drops rows from the batch after next on
    path = scratch_path(t.spark, "late")
    for days in ("ts >= '2024-01-20'", "ts >= '2024-01-12' AND ts < '2024-01-20'", "ts < '2024-01-12'"):
        t.events.filter(days).coalesce(1).write.mode("append").parquet(path)
    rows = st.read_stream(t.spark, path, t.events.schema, files_per_batch=1)
    return st.counted_with_late(rows, "ts", "1 day", "1 hour", "late-counts")


@query("str_refresh", "STR-06", oracle="""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def _(t):
    target = scratch_path(t.spark, "refresh")
    by_type = (lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))
    st.refresh_results(event_stream(t), lambda: t.events, {"by_type": by_type}, target)
    return st.refreshed(t.spark, target, "by_type")


@query("str_refresh_aggregate", "STR-06", oracle="""SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, min(ts) AS first_at,
    max(ts) AS last_at, count(DISTINCT user_id % 50) AS users FROM events GROUP BY 1""")
def _(t):
    # a second refresh, when more files have come
    files, target = scratch_path(t.spark, "refresh-files"), scratch_path(t.spark, "refresh-aggregate")
    measures = {"n": ("count", F.lit(1)), "total": ("sum", F.col("value")), "first_at": ("min", F.col("ts")),
                "last_at": ("max", F.col("ts")), "users": ("distinct", F.col("user_id") % 50)}
    for part in (0, 1):
        t.events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(files)
        st.refresh_aggregate(st.read_stream(t.spark, files, t.events.schema), ["event_type"], measures, target)
    return st.refreshed_aggregate(t.spark, target, measures).withColumn("total", F.round("total", 2))
