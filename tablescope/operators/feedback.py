"""Feedback reconciliation: friction totals, read costs, links between votes and recommendations.

recommendations: rec_id, status, impact_score, created_at; refs (one row per trigger reference):
rec_id, chat_id, target_id; links: rec_id, message_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPACT_FLOOR = 5
READ_COST_LIMIT = 25
CHARS_PER_TOKEN = 4
MIN_TOKENS_PER_READ = 1_000
MIN_TOTAL_TOKENS = 8_000


def in_window(start: Column, end: Column) -> Column:
    return (F.col("created_at") >= start) & (F.col("created_at") < end)


def window_totals(
    parts: DataFrame, feedback: DataFrame, messages: DataFrame, analysis_chats: DataFrame, start: Column, end: Column
) -> DataFrame:
    """Tool errors, down-votes and regenerations in [start, end), analysis chats left out.

    Each table is filtered before it meets the messages; the three counts are one-row sums.
    """
    chats = analysis_chats.select("chat_id").distinct()
    live = messages.select("message_id", "chat_id").join(chats, "chat_id", "left_anti")
    errors = parts.filter((F.col("tool_state") == "output-error") & in_window(start, end)).select("message_id")
    downs = feedback.filter((F.col("vote") == "down") & in_window(start, end)).select("message_id")
    redone = messages.filter(F.col("superseded") & in_window(start, end)).select("message_id")
    kinds = {"errors": errors, "downvotes": downs, "regenerations": redone}
    tagged = None
    for kind, rows in kinds.items():
        part = rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        tagged = part if tagged is None else tagged.unionByName(part)
    joined = tagged.join(live, "message_id")
    zero = F.lit(0).cast("long")
    return joined.agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), zero).alias(k) for k in kinds]
    )


def read_costs(reads: DataFrame, path: Column, content: Column, max_chars: int, limit: int = READ_COST_LIMIT) -> DataFrame:
    """Cost of reading each file, heaviest first: what a reader was shown is capped at ``max_chars``."""
    raw = F.length(content).cast("long")
    shown = F.least(raw, F.lit(max_chars).cast("long"))
    zero = F.lit(0).cast("long")
    sums = reads.groupBy(path.alias("file_path")).agg(
        F.count(F.lit(1)).alias("read_count"),
        F.coalesce(F.sum(shown), zero).alias("total_chars"),
        F.coalesce(F.max(shown), zero).alias("max_chars"),
        F.coalesce(F.max(raw), zero).alias("max_raw_chars"),
    )
    top = sums.orderBy(F.col("total_chars").desc(), F.col("file_path").asc_nulls_last()).limit(limit)
    tokens = (lambda c: F.ceil(F.col(c) / CHARS_PER_TOKEN).cast("long"))
    return top.filter(F.coalesce(F.col("file_path"), F.lit("")) != "").select(
        "file_path",
        "read_count",
        tokens("total_chars").alias("total_tokens"),
        F.floor(tokens("total_chars") / F.col("read_count") + 0.5).cast("long").alias("avg_tokens"),
        tokens("max_chars").alias("max_tokens"),
        (F.col("max_raw_chars") > max_chars).alias("truncated"),
    )


def flag_costs(costs: DataFrame) -> DataFrame:
    """Flag files against the means of the batch; the first rule that applies decides."""
    names = ("read_count", "total_tokens", "avg_tokens")
    mean = costs.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    flag = (
        F.when(F.col("truncated"), "truncated_on_read")
        .when((F.col("total_tokens") < MIN_TOTAL_TOKENS) & (F.col("max_tokens") < MIN_TOKENS_PER_READ), None)
        .when(
            (F.col("read_count") >= F.greatest(F.lit(2.0), mean["read_count"]))
            & (F.col("total_tokens") >= mean["total_tokens"]),
            "frequent_and_expensive",
        )
        .when((F.col("read_count") <= 2) & (F.col("max_tokens") >= 2 * mean["avg_tokens"]), "rare_but_outlier")
    )
    return costs.withColumn("flag", flag)


def unlinked_downvotes(feedback: DataFrame, links: DataFrame) -> DataFrame:
    """Down-votes of messages that no link names. Links of one message are merged inside the map tasks, so no task holds them."""
    linked = links.select("message_id").distinct()
    return feedback.filter(F.col("vote") == "down").join(linked, "message_id", "left_anti")


def attach_feedback(feedback: DataFrame, refs: DataFrame) -> DataFrame:
    """``rec_id`` per vote: the first recommendation naming the message, else the only one of its chat.

    First means lowest ``seq``. References are reduced to one row per target and per chat before the join.
    """
    by_target = refs.filter(F.col("target_id").isNotNull()).groupBy("target_id").agg(
        F.min_by("rec_id", "seq").alias("_strong")
    )
    by_chat = refs.groupBy("chat_id").agg(
        F.min("rec_id").alias("_lo"), F.max("rec_id").alias("_hi")
    )
    only = by_chat.filter(F.col("_lo") == F.col("_hi")).select("chat_id", F.col("_lo").alias("_weak"))
    rows = feedback.join(by_target, feedback["message_id"] == by_target["target_id"], "left").drop("target_id")
    rows = rows.join(only, "chat_id", "left")
    return rows.withColumn("rec_id", F.coalesce("_strong", "_weak")).drop("_strong", "_weak")


def link_owners(links: DataFrame, recommendations: DataFrame, refs: DataFrame) -> DataFrame:
    """Every link with whether it is stale: a message has one owner.

    Not dismissed beats dismissed, a recommendation that names the message beats others, then impact,
    then the newest, then the lowest id.
    """
    named = refs.select("rec_id", F.col("target_id").alias("message_id"), F.lit(True).alias("_origin")).distinct()
    rows = links.join(recommendations, "rec_id").join(named, ["rec_id", "message_id"], "left")
    strength = F.struct(
        (F.col("status") != "dismissed").alias("a"),
        F.coalesce("_origin", F.lit(False)).alias("o"),
        F.col("impact_score").alias("i"),
        F.col("created_at").alias("c"),
        (-F.col("rec_id")).alias("r"),
    )
    owners = rows.groupBy("message_id").agg(F.max_by("rec_id", strength).alias("owner"))
    return links.join(owners, "message_id").withColumn("stale", F.col("rec_id") != F.col("owner"))


def fingerprint(file: Column, subject: Column) -> Column:
    return F.sha2(F.concat_ws(" ", file, subject), 256)


def set_digest(ids: DataFrame, key: str, value: str) -> DataFrame:
    """Digest of a group's distinct sorted ids (the ids of one recommendation)."""
    joined = F.array_join(F.sort_array(F.collect_set(F.col(value).cast("string"))), ",")
    return ids.groupBy(key).agg(F.sha2(joined, 256).alias("digest"))


def impacts(findings: DataFrame, refs: DataFrame, totals: DataFrame) -> DataFrame:
    """Impact per finding: share of all friction in points, plus five per distinct chat.

    ``findings``: finding_id, count; ``refs``: finding_id, chat_id; ``totals``: one row of window totals.
    """
    friction = totals.select(F.col("errors") + F.col("downvotes") + F.col("regenerations")).scalar()
    counted = findings.groupBy("finding_id").agg(F.sum("count").alias("_count"))
    chats = refs.select("finding_id", "chat_id").distinct().groupBy("finding_id").agg(
        F.count("chat_id").alias("affected_chats")
    )
    share = F.when(friction == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("_count") / friction))
    rows = counted.join(chats, "finding_id", "left").withColumn(
        "affected_chats", F.coalesce("affected_chats", F.lit(0).cast("long"))
    )
    points = F.floor(F.col("failure_share") * 100 + 0.5).cast("long") + F.col("affected_chats") * 5
    return rows.withColumn("failure_share", share).withColumn("impact_score", points).drop("_count")


def reconcile(
    existing: DataFrame, recorded: DataFrame, resolved: DataFrame, dismissed: DataFrame, floor: int = IMPACT_FLOOR
) -> DataFrame:
    """Actions that bring stored recommendations in line with what a run recorded.

    existing: fingerprint, rec_id, status; recorded: fingerprint, seq, impact_score (last seq wins);
    resolved, dismissed: fingerprint.
    """
    last = recorded.groupBy("fingerprint").agg(
        F.max_by(F.struct("seq", "impact_score"), "seq").alias("_f")
    ).select("fingerprint", F.col("_f.seq").alias("seq"), F.col("_f.impact_score").alias("impact_score"))
    gone = resolved.select("fingerprint").distinct().withColumn("_listed", F.lit(True))
    banned = dismissed.select("fingerprint").distinct()
    rows = last.join(existing, "fingerprint", "full_outer").join(gone, "fingerprint", "left")
    rows = rows.join(banned, "fingerprint", "left_anti")
    known, said = F.col("rec_id").isNotNull(), F.col("seq").isNotNull()
    action = (
        F.when(said & known, "update")
        .when(said & (F.col("impact_score") >= floor), "insert")
        .when(~said & F.col("_listed") & (F.col("status") == "open"), "resolve")
    )
    reopen = F.when(said & known, F.col("status") == "applied")
    out = rows.withColumn("action", action).filter(F.col("action").isNotNull())
    return out.select("action", "fingerprint", "rec_id", "seq", "impact_score", reopen.alias("reopen"))


def resolve_targets(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Chat of each target id: a tool call id wins over an equal message id."""
    by_message = messages.select(
        F.col("message_id").cast("string").alias("target_id"), "chat_id", F.lit(0).alias("_prio")
    )
    by_call = (
        parts.filter(F.col("tool_call_id").isNotNull())
        .select("message_id", F.col("tool_call_id").alias("target_id"))
        .join(messages.select("message_id", "chat_id"), "message_id")
        .select("target_id", "chat_id", F.lit(1).alias("_prio"))
    )
    return by_message.unionByName(by_call).groupBy("target_id").agg(
        F.max_by("chat_id", F.struct("_prio", "chat_id")).alias("chat_id")
    )


def repair_refs(refs: DataFrame, targets: DataFrame, chats: DataFrame) -> DataFrame:
    """The resolved target's chat wins; else the recorded chat if it exists; else the reference goes."""
    found = targets.select("target_id", F.col("chat_id").alias("_resolved"))
    valid = chats.select(F.col("chat_id").alias("_valid")).distinct()
    rows = refs.join(found, "target_id", "left").join(valid, F.col("chat_id") == F.col("_valid"), "left")
    repaired = rows.withColumn("chat_id", F.coalesce("_resolved", "_valid")).filter(F.col("chat_id").isNotNull())
    return repaired.drop("_resolved", "_valid").select(*refs.columns).distinct()


def list_recommendations(recommendations: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    rows = recommendations.filter(F.col("status").isin(statuses)) if statuses else recommendations
    return rows.orderBy(F.col("impact_score").desc(), F.col("rec_id").asc())


def linked_feedback(links: DataFrame, recommendations: DataFrame, feedback: DataFrame) -> DataFrame:
    return links.join(recommendations.select("rec_id", "status", "impact_score"), "rec_id").join(feedback, "message_id")


def first_admin(members: DataFrame) -> DataFrame:
    """Earliest admin per project."""
    admins = members.filter(F.col("role") == "admin")
    return admins.groupBy("project_id").agg(F.min_by("user_id", F.struct("created_at", "user_id")).alias("user_id"))
