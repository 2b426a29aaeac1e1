"""Conversation analytics over chat, message, part and feedback tables.

chats: chat_id, user_id, title, updated_at ...; messages: message_id, chat_id, role, source, created_at,
superseded (boolean), token columns; parts: message_id, ord, type, text, tool_state, created_at;
feedback: message_id, vote, explanation, created_at. Ties in time are broken by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMER = "Former member"


def first_user_source(messages: DataFrame) -> DataFrame:
    """Source of each chat's first user message that was not superseded; it may be null."""
    asked = messages.filter((F.col("role") == "user") & ~F.col("superseded"))
    first = F.min_by(F.struct("source"), F.struct("created_at", "message_id"))
    return asked.groupBy("chat_id").agg(first.alias("_s")).select("chat_id", F.col("_s.source").alias("source"))


def chat_metrics(chats: DataFrame, messages: DataFrame, parts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per chat: messages, tokens, cost, votes, down-vote texts and tool outcomes.

    Child tables are summed per message first, so no join multiplies rows and a busy chat only meets
    already-small rows; all three joins share the message key.
    """
    per_part = parts.groupBy("message_id").agg(
        F.count_if(F.col("tool_state") == "output-error").alias("_err"),
        F.count_if(F.col("tool_state") == "output-available").alias("_ok"),
    )
    down = F.col("vote") == "down"
    per_vote = feedback.groupBy("message_id").agg(
        F.count_if(down).alias("_down"),
        F.count_if(F.col("vote") == "up").alias("_up"),
        F.array_sort(F.collect_list(F.when(down, F.col("explanation")))).alias("_why"),
    )
    live = messages.filter(~F.col("superseded"))
    rows = live.join(per_part, "message_id", "left").join(per_vote, "message_id", "left")
    zero = F.lit(0).cast("long")
    sums = rows.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("number_of_messages"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("input_cache_read_tokens").alias("cache_read_tokens"),
        F.sum("total_cost").alias("total_cost"),
        F.sum("_down").alias("downvotes"),
        F.sum("_up").alias("upvotes"),
        F.sum("_err").alias("tool_errors"),
        F.sum("_ok").alias("tool_successes"),
        F.expr(
            "listagg(nullif(array_join(_why, ' '), ''), ' ') WITHIN GROUP (ORDER BY message_id)"
        ).alias("feedback_text"),
    )
    counts = [
        "number_of_messages", "total_tokens", "cache_read_tokens", "downvotes", "upvotes",
        "tool_errors", "tool_successes",
    ]
    out = chats.join(sums, "chat_id", "left")
    fill = {c: F.coalesce(c, zero) for c in counts}
    fill["total_cost"] = F.coalesce("total_cost", F.lit(0.0))
    fill["feedback_text"] = F.coalesce("feedback_text", F.lit(""))
    return out.withColumns(fill)


def search_chats_table(metrics: DataFrame, text: str) -> DataFrame:
    """Literal, case-insensitive search in titles, names, roles and counts."""
    needle = text.strip().lower()
    if not needle:
        return metrics
    columns = [
        "title", "user_name", "role_name", "number_of_messages", "total_tokens", "downvotes", "upvotes",
        "tool_errors", "tool_successes",
    ]
    hits = [F.contains(F.lower(F.col(c).cast("string")), F.lit(needle)) for c in columns]
    return metrics.filter(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def tool_state(errors: str = "tool_errors", ok: str = "tool_successes") -> Column:
    return (
        F.when(F.col(errors) > 0, "toolsWithErrors")
        .when(F.col(ok) > 0, "toolsNoErrors")
        .otherwise("noToolsUsed")
    )


FACETS = {
    "userName": lambda v: F.col("user_name") == v,
    "userRole": lambda v: F.col("role_name") == v,
    "source": lambda v: F.col("source") == v,
    "toolState": lambda v: tool_state() == v,
    "feedback": lambda v: {
        "noFeedback": (F.col("downvotes") == 0) & (F.col("upvotes") == 0),
        "hasUpvotes": F.col("upvotes") > 0,
        "hasDownvotes": F.col("downvotes") > 0,
    }[v],
}


def filter_facets(metrics: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Values of one facet are alternatives; facets add up."""
    for facet, values in chosen.items():
        if values:
            metrics = metrics.filter(reduce(lambda a, b: a | b, [FACETS[facet](v) for v in values]))
    return metrics


def filter_days(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Inclusive UTC day range, as a half-open range the scan can use."""
    c, kind = F.col(column), df.schema[column].dataType
    end = F.lit(last).cast(kind) + F.expr("INTERVAL 1 DAY")
    return df.filter((c >= F.lit(first).cast(kind)) & (c < end))


def tiered(primary: str, secondary: str, descending: bool) -> list[Column]:
    """Both zero, then only the primary zero, then by the primary."""
    tier = F.when((F.col(primary) == 0) & (F.col(secondary) == 0), 0).when(F.col(primary) == 0, 1).otherwise(2)
    keys = [tier, F.col(primary)]
    return [k.desc() if descending else k.asc() for k in keys]


def order_chats(sorting: list[tuple[str, bool]], updated: str = "updated_at", key: str = "chat_id") -> list[Column]:
    """Sort keys from (column, descending) pairs; the newest update decides last, then the id."""
    out: list[Column] = []
    for column, descending in sorting:
        if column == "feedback":
            out += tiered("downvotes", "upvotes", descending)
        elif column == "toolState":
            out += tiered("tool_errors", "tool_successes", descending)
        else:
            out.append(F.col(column).desc() if descending else F.col(column).asc())
    return [*out, F.col(updated).desc(), F.col(key).asc()]


def chat_page(metrics: DataFrame, sorting: list[tuple[str, bool]], page: int, size: int) -> DataFrame:
    """One page and the total under the same predicate."""
    total = metrics.agg(F.count(F.lit(1))).scalar()
    return metrics.orderBy(*order_chats(sorting)).offset(page * size).limit(size).withColumn("total", total)


def facet_counts(metrics: DataFrame) -> DataFrame:
    """Counts by user, by role and by tool state in one pass."""
    rows = metrics.select("user_name", "role_name", tool_state().alias("tool_state"))
    sets = rows.groupingSets(
        [[F.col("user_name")], [F.col("role_name")], [F.col("tool_state")]],
        F.col("user_name"), F.col("role_name"), F.col("tool_state"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping("user_name").alias("_u"),
        F.grouping("role_name").alias("_r"),
    )
    facet = F.when(F.col("_u") == 0, "userName").when(F.col("_r") == 0, "userRole").otherwise("toolState")
    value = F.coalesce("user_name", "role_name", "tool_state")
    return sets.select(facet.alias("facet"), value.alias("value"), "n").filter(F.col("value").isNotNull())


def own_chats(chats: DataFrame, user_id: int, automation_runs: DataFrame) -> DataFrame:
    """A user's chats that are neither deleted nor runs of an automation (``chat_id``)."""
    own = chats.filter((F.col("user_id") == user_id) & ~F.coalesce("deleted", F.lit(False)))
    return own.join(automation_runs.select("chat_id"), "chat_id", "left_anti")


def search_user_chats(chats: DataFrame, messages: DataFrame, parts: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Title hits first, then chats with a text hit; each chat once, newest first.

    All ``chats`` are searched; ``own_chats`` are those that a user may find.
    """
    needle = F.lit(text.lower())
    titled = chats.filter(F.contains(F.lower("title"), needle)).select(
        "chat_id", "title", "updated_at", F.lit(0).alias("tier"), F.lit(None).cast("string").alias("matched_text")
    )
    hit_messages = parts.filter(F.contains(F.lower("text"), needle)).groupBy("message_id").agg(
        F.min_by("text", F.struct("ord", "text")).alias("matched_text")
    )
    hit_chats = (
        hit_messages.join(messages.select("message_id", "chat_id"), "message_id")
        .groupBy("chat_id")
        .agg(F.min_by("matched_text", "message_id").alias("matched_text"))
    )
    said = chats.join(hit_chats, "chat_id").select(
        "chat_id", "title", "updated_at", F.lit(1).alias("tier"), "matched_text"
    )
    said = said.join(titled.select("chat_id"), "chat_id", "left_anti")
    return titled.unionByName(said).orderBy("tier", F.col("updated_at").desc(), "chat_id").limit(limit)


# fixed values: platform labels of thread columns and message sources, in the order they are tried
THREAD_LABELS = {
    "slack_thread": "Slack",
    "teams_thread": "Teams",
    "whatsapp_thread": "WhatsApp",
    "telegram_thread": "Telegram",
    "mattermost_thread": "Mattermost",
}
SOURCE_LABELS = {
    "mcp": "MCP",
    "contextRecommendations": "Context recommendations",
    "admin": "Admin",
}
PLATFORM_ORDER = [
    "Web",
    "Admin",
    "MCP",
    "Context recommendations",
    "Slack",
    "Teams",
    "WhatsApp",
    "Telegram",
    "Mattermost",
]


def with_platform(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Label of the first thread id set, else of the first source any message has, else Web."""
    seen = messages.groupBy("chat_id").agg(
        *[F.max(F.col("source") == s).alias(f"_has_{s}") for s in SOURCE_LABELS]
    )
    threads = [F.when(F.col(c).isNotNull(), label) for c, label in THREAD_LABELS.items()]
    sources = [F.when(F.col(f"_has_{s}"), label) for s, label in SOURCE_LABELS.items()]
    joined = chats.join(seen, "chat_id", "left")
    return joined.withColumn("platform", F.coalesce(*threads, *sources, F.lit("Web"))).drop(
        *[f"_has_{s}" for s in SOURCE_LABELS]
    )


def shared_with(
    chats: DataFrame, shares: DataFrame, access: DataFrame, members: DataFrame, user: Column
) -> DataFrame:
    """Shares the user may see: project-wide as a member, or named; never the user's own or deleted chats.

    ``shares``: share_id, chat_id, visibility; ``access``: share_id, user_id; ``members``: project_id, user_id.
    """
    mine = members.filter(F.col("user_id") == user).select("project_id").distinct()
    named = access.filter(F.col("user_id") == user).select("share_id").distinct()
    open_chats = chats.filter(~F.col("deleted") & (F.col("user_id") != user))
    rows = shares.join(open_chats, "chat_id")
    by_project = rows.filter(F.col("visibility") == "project").join(mine, "project_id", "left_semi")
    by_name = rows.filter(F.col("visibility") == "specific").join(named, "share_id", "left_semi")
    return by_project.unionByName(by_name)


def visible_chats(
    chats: DataFrame, shares: DataFrame, access: DataFrame, members: DataFrame, user: Column
) -> DataFrame:
    """The user's own chats and those shared with them, told apart by ``kind``."""
    own = chats.filter((F.col("user_id") == user) & ~F.col("deleted")).withColumn("kind", F.lit("own"))
    shared = shared_with(chats, shares, access, members, user).select(*chats.columns).distinct()
    return own.unionByName(shared.withColumn("kind", F.lit("shared")))


def without_automations(chats: DataFrame, runs: DataFrame) -> DataFrame:
    return chats.join(runs.select("chat_id"), "chat_id", "left_anti")


LIST_FILTERS = {
    "all": lambda: F.lit(True),
    "mine": lambda: F.col("kind") == "own",
    "starred": lambda: F.col("is_starred"),
    "shared": lambda: F.col("is_shared_by_me"),
    "shared_with_me": lambda: F.col("kind") == "shared",
}


def filter_list(chats: DataFrame, filters: list[str]) -> DataFrame:
    """Any chosen filter admits a chat; none or ``all`` admits every one."""
    if not filters or "all" in filters:
        return chats
    return chats.filter(reduce(lambda a, b: a | b, [LIST_FILTERS[f]() for f in filters]))


def date_group(updated: Column, as_of: Column) -> Column:
    """Today, Yesterday, This week (from Monday) or Older; the first that fits."""
    today = F.date_trunc("day", as_of)
    return (
        F.when(updated >= today, "Today")
        .when(updated >= today - F.make_dt_interval(F.lit(1)), "Yesterday")
        .when(updated >= F.date_trunc("week", as_of), "This week")
        .otherwise("Older")
    )


def star_group(starred: Column) -> Column:
    return F.when(starred, "Starred").otherwise("Chats")


def platform_rank(platform: Column) -> Column:
    """Place of a platform in the fixed display order."""
    return F.array_position(F.array(*[F.lit(p) for p in PLATFORM_ORDER]), platform)


def group_sizes(chats: DataFrame, label: Column, rank: Column | None = None) -> DataFrame:
    """Groups with their size and newest update; the members stay rows of ``chats``."""
    rank = label if rank is None else rank
    return chats.groupBy(label.alias("label"), rank.alias("rank")).agg(
        F.count(F.lit(1)).alias("chats"), F.max("updated_at").alias("updated_at")
    )


def transcript(messages: DataFrame, parts: DataFrame, chats: DataFrame) -> DataFrame:
    """Live messages of live chats with their parts, in reading order."""
    live = messages.filter(~F.col("superseded")).join(chats.filter(~F.col("deleted")), "chat_id", "left_semi")
    rows = live.select("chat_id", "message_id", "role", F.col("created_at").alias("said_at")).join(parts, "message_id")
    return rows.orderBy("chat_id", "said_at", "message_id", "ord")


def message_texts(parts: DataFrame) -> DataFrame:
    """Text parts of a message joined by spaces, in part order (a message has few parts)."""
    text = parts.filter((F.col("type") == "text") & F.col("text").isNotNull())
    return text.groupBy("message_id").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY ord, text)").alias("text")
    )


def recent_feedback(feedback: DataFrame, parts: DataFrame, limit: int) -> DataFrame:
    """Newest votes with the text they were cast on.

    The cut comes first, so texts are only put together for the votes shown.
    """
    newest = feedback.orderBy(F.col("created_at").desc(), F.col("message_id").desc()).limit(limit)
    shown = parts.join(newest.select("message_id"), "message_id", "left_semi")
    return newest.join(message_texts(shown), "message_id", "left")


def message_lengths(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Characters of text per message; 0 without text."""
    chars = parts.filter(F.col("type") == "text").groupBy("message_id").agg(F.sum(F.length("text")).alias("chars"))
    out = messages.select("message_id", "chat_id", "role").join(chars, "message_id", "left")
    return out.withColumn("chars", F.coalesce("chars", F.lit(0).cast("long")))


def latest_model(messages: DataFrame) -> DataFrame:
    """Provider and model of the newest assistant message per chat."""
    answered = messages.filter((F.col("role") == "assistant") & F.col("provider").isNotNull())
    newest = F.max_by(F.struct("provider", "model_id"), F.struct("created_at", "message_id"))
    return answered.groupBy("chat_id").agg(newest.alias("_m")).select("chat_id", "_m.*")


def latest_by_json_id(parts: DataFrame, payload: str, path: str, order: list[str]) -> DataFrame:
    """Newest live part per id found inside a JSON payload."""
    rows = parts.filter(~F.col("superseded")).withColumn("json_id", F.get_json_object(payload, path))
    newest = F.max_by(F.struct(*parts.columns), F.struct(*order))
    return rows.filter(F.col("json_id").isNotNull()).groupBy("json_id").agg(newest.alias("_r")).select("json_id", "_r.*")


def members_with_access(users: DataFrame, project_roles: DataFrame, org_roles: DataFrame) -> DataFrame:
    """Users with a project role, else an organisation role; others are left out."""
    joined = users.join(project_roles, "user_id", "left").join(org_roles, "user_id", "left")
    return joined.withColumn("access", F.coalesce("project_role", "org_role")).filter(F.col("access").isNotNull())


def email_domains(users: DataFrame) -> DataFrame:
    """Distinct domains of verified addresses."""
    domain = F.lower(F.trim(F.split_part(F.col("email"), F.lit("@"), F.lit(2))))
    found = users.filter(F.col("verified")).select(domain.alias("domain"))
    return found.filter(F.col("domain") != "").distinct()
