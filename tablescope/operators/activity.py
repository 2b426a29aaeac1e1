"""Activity feeds, runs, logs and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.ordered import top_per_key

STALE_MINUTES = 30


def audience_feed(
    activities: DataFrame, owned: DataFrame, shared: DataFrame, story_shares: DataFrame, chat_shares: DataFrame,
    user: Column, limit: int,
) -> DataFrame:
    """Newest activities the user may see.

    A refresh reaches its actor, the owner (``owned``: asset_id) and those the asset is shared with
    (``shared``: asset_id); a share reaches its recipients (``*_shares``: share_id), not the sharer.
    """
    refreshed = activities.filter(F.col("type") == "story.refreshed")
    by_me = F.coalesce(F.col("user_id") == user, F.lit(False))
    reach = owned.select("asset_id").unionByName(shared.select("asset_id")).distinct()
    branches = [
        refreshed.filter(by_me),
        refreshed.filter(~by_me).join(reach, "asset_id", "left_semi"),
    ]
    for kind, ids in (("story.shared", story_shares), ("chat.shared", chat_shares)):
        others = activities.filter((F.col("type") == kind) & (F.col("user_id") != user))
        branches.append(others.join(ids.select("share_id").distinct(), "share_id", "left_semi"))
    feed = branches[0]
    for b in branches[1:]:
        feed = feed.unionByName(b)
    return feed.orderBy(F.col("created_at").desc(), F.col("activity_id").desc()).limit(limit)


def fail_stale(runs: DataFrame, as_of: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Runs still going after the limit become failed, completed now."""
    cutoff = as_of - F.make_dt_interval(mins=F.lit(minutes))
    stale = (F.col("status") == "running") & (F.col("started_at") <= cutoff)
    return runs.withColumns(
        {
            "completed_at": F.when(stale, as_of).otherwise(F.col("completed_at")),
            "error": F.when(stale, "Run exceeded the time limit.").otherwise(F.col("error")),
            "status": F.when(stale, "failed").otherwise(F.col("status")),
        }
    )


def merge_feeds(a: DataFrame, b: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True).orderBy(*order).limit(limit)


def latest_runs(runs: DataFrame, key: str) -> DataFrame:
    """Newest run per automation in one aggregation."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("started_at", "run_id")).alias("_r")).select(
        key, "_r.*"
    )


def run_history(runs: DataFrame, key: str, exclude: Column | None = None, limit: int = 10) -> DataFrame:
    """Last runs per automation, one run left out."""
    rows = runs.filter(F.col("run_id") != exclude) if exclude is not None else runs
    return top_per_key(rows, [key], [F.col("started_at").desc(), F.col("run_id").desc()], limit)


def latest_failures(runs: DataFrame, key: str) -> DataFrame:
    """The newest refresh of each asset, kept only if it failed (a later success hides it)."""
    newest = latest_runs(runs, key).filter(F.col("status") == "failed")
    return newest.select(
        key,
        F.coalesce("error", F.lit("Refresh failed.")).alias("error"),
        F.coalesce("completed_at", "started_at").alias("failed_at"),
    )


def list_logs(logs: DataFrame, level: str | None, source: str | None, since: Column | None, limit: int) -> DataFrame:
    if level:
        logs = logs.filter(F.col("level") == level)
    if source:
        logs = logs.filter(F.col("source") == source)
    if since is not None:
        logs = logs.filter(F.col("created_at") >= since)
    return logs.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(limit)


def keep_recent_logs(logs: DataFrame, cutoff: Column) -> DataFrame:
    return logs.filter(F.col("created_at") >= cutoff)


def supersede(memories: DataFrame, added: DataFrame) -> DataFrame:
    """Old and new memories; one named by ``supersedes_id`` gets the new one as ``superseded_by``."""
    replaced = added.filter(F.col("supersedes_id").isNotNull()).groupBy("supersedes_id").agg(
        F.max("memory_id").alias("_by")
    )
    both = memories.join(added.select("memory_id"), "memory_id", "left_anti").unionByName(
        added.drop("supersedes_id").withColumn("superseded_by", F.lit(None).cast("long"))
    )
    out = both.join(replaced, both["memory_id"] == replaced["supersedes_id"], "left")
    return out.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by", "supersedes_id")


def active_memories(memories: DataFrame, user: Column, exclude_chat: Column | None = None) -> DataFrame:
    """A user's memories that were not superseded, other chats' or no chat's."""
    rows = memories.filter((F.col("user_id") == user) & F.col("superseded_by").isNull())
    if exclude_chat is not None:
        rows = rows.filter(F.col("chat_id").isNull() | (F.col("chat_id") != exclude_chat))
    return rows.orderBy(F.col("created_at").desc(), "memory_id")
