"""Token usage, cost and budget analytics over messages and auxiliary inferences.

``messages``: message_id, chat_id, user_id, role, source, provider, model_id, created_at, token columns.
``inferences``: inference_id, chat_id, user_id, provider, model_id, created_at, token columns.
``message_id`` is the primary key, so counting rows equals counting distinct messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.dates import (
    bucket_label,
    bucket_series_column,
    lookback_start,
    period_start_by,
)
from tablescope.operators.ordered import CHUNK_ROWS, running, top_per_key

# fixed values: the message sources and the token classes with a price
SOURCES = (
    "slack",
    "teams",
    "telegram",
    "mattermost",
    "whatsapp",
    "web",
    "mcp",
    "contextRecommendations",
    "admin",
)
TOKEN_CLASSES = ("input_no_cache", "input_cache_read", "input_cache_write", "output")
WARNING_RATIO = 0.8


def merge_prices(builtin: DataFrame, declared: DataFrame) -> DataFrame:
    """Built-in rates overlaid field by field by declared ones; a missing rate is 0."""
    b, d = builtin.alias("b"), declared.alias("d")
    keys = ["provider", "model_id"]
    joined = b.join(d, keys, "full_outer")
    return joined.select(
        *keys, *[F.coalesce(f"d.{c}", f"b.{c}", F.lit(0.0)).alias(c) for c in TOKEN_CLASSES]
    )


def with_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per token class in USD (rates are per million tokens) and the total.

    Catalyst broadcasts the price list while it is under the broadcast threshold.
    """
    rates = prices.select(
        F.col("provider").alias("_p"), F.col("model_id").alias("_m"),
        *[F.col(c).alias(f"_rate_{c}") for c in TOKEN_CLASSES],
    )
    priced = rows.join(
        rates, (F.col("provider") == F.col("_p")) & (F.col("model_id") == F.col("_m")), "left"
    )
    costs = {
        f"{c}_cost": F.coalesce(f"{c}_tokens", F.lit(0))
        * F.coalesce(F.col(f"_rate_{c}"), F.lit(0.0))
        / 1_000_000.0
        for c in TOKEN_CLASSES
    }
    priced = priced.withColumns(costs)
    total = F.lit(0.0)
    for name in costs:
        total = total + F.col(name)
    return priced.withColumn("total_cost", total).drop("_p", "_m", *[f"_rate_{c}" for c in TOKEN_CLASSES])


def snake(source: str) -> str:
    return "context_recommendations" if source == "contextRecommendations" else source


COUNT_COLUMNS = ["message_count", *[f"{snake(s)}_message_count" for s in SOURCES]]
SUM_COLUMNS = [
    *[f"{c}_tokens" for c in TOKEN_CLASSES], "total_tokens",
    *[f"{c}_cost" for c in TOKEN_CLASSES], "total_cost",
]


def _sums(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]


def message_usage(priced: DataFrame, granularity: str) -> DataFrame:
    """User messages in total and per source, tokens and cost, per time bucket."""
    is_user = F.col("role") == "user"
    counts = [F.count_if(is_user).alias("message_count")]
    counts += [
        F.count_if(is_user & (F.col("source") == s)).alias(f"{snake(s)}_message_count") for s in SOURCES
    ]
    return priced.groupBy(bucket_label("created_at", granularity).alias("date")).agg(
        *counts, *_sums(SUM_COLUMNS)
    )


def inference_usage(priced: DataFrame, granularity: str) -> DataFrame:
    """Auxiliary inferences in the same shape, with no messages."""
    return priced.groupBy(bucket_label("created_at", granularity).alias("date")).agg(
        *[F.lit(0).cast("long").alias(c) for c in COUNT_COLUMNS],
        *_sums(SUM_COLUMNS),
    )


def combine_usage(*parts: DataFrame) -> DataFrame:
    """Union of bucketed usages, summed again per bucket."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("date").agg(*_sums([*COUNT_COLUMNS, *SUM_COLUMNS]))


def fill_buckets(
    usage: DataFrame, as_of: Column, unit: str, value: int, granularity: str, most: int | None = None
) -> DataFrame:
    """One row per bucket of the lookback, zeros where nothing happened; an error if there are more than ``most``."""
    series = bucket_series_column(as_of, unit, value, granularity)
    if most is not None:
        asked = F.format_string(f"%d {granularity} buckets asked for, at most {most} are allowed", F.size(series))
        series = F.when(F.size(series) <= most, series).otherwise(F.raise_error(asked))
    dates = usage.sparkSession.range(1).select(F.explode(series).alias("_start"))
    dates = dates.select(bucket_label("_start", granularity).alias("date"))
    measures = [c for c in usage.columns if c != "date"]
    return dates.join(usage, "date", "left").na.fill(0, measures)


def in_lookback(rows: DataFrame, as_of: Column, unit: str, value: int) -> DataFrame:
    # in the column's own type, so that the scan gets the filter
    start = lookback_start(as_of, unit, value).cast(rows.schema["created_at"].dataType)
    return rows.filter(F.col("created_at") >= start)


def with_message_provider(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``usage_provider``: a user message takes the provider of the first assistant message after it that has one,
    unless another user message lies between; other rows keep their own.

    After and between are strict: messages of one instant neither answer nor close each other. So the scan is over
    instants, and an instant with an answer ends the search even if a user wrote at it too. Of several answers at one
    instant the least id counts.
    """
    answer = F.when((F.col("role") == "assistant") & F.col("provider").isNotNull(), F.struct("message_id", "provider"))
    instants = messages.groupBy("chat_id", "created_at").agg(
        F.min(answer)["provider"].alias("_answer"), F.bool_or(F.col("role") == "user").alias("_asked")
    )
    # the next question closes the search with a null inside the struct
    marker = F.when(F.col("_answer").isNotNull() | F.col("_asked"), F.struct(F.col("_answer").alias("p")))
    after = running(
        instants, ["chat_id"], ["created_at"], chunk_rows,
        {"_next": ("last", marker)}, inclusive=False, backward=True,
    ).select(F.col("chat_id").alias("_chat"), F.col("created_at").alias("_at"), F.col("_next.p").alias("_after"))
    same = F.col("chat_id").eqNullSafe(F.col("_chat")) & F.col("created_at").eqNullSafe(F.col("_at"))
    usage = F.when(F.col("role") == "user", F.col("_after")).otherwise(F.col("provider"))
    return messages.join(after, same).withColumn("usage_provider", usage).drop("_chat", "_at", "_after")


def with_message_source(messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``usage_source``: an assistant message takes the source of the latest user message at or before
    it, even a null one; other rows keep their own. Of user messages at one instant the greatest id is the latest."""
    marker = F.when(F.col("role") == "user", F.struct(F.col("source").alias("s")))
    # at one instant users come first, whatever the ids, so that an answer sees them
    sided = messages.withColumn("_side", F.when(F.col("role") == "user", 0).otherwise(1))
    out = running(
        sided, ["chat_id"], ["created_at", "_side", "message_id"], chunk_rows,
        {"_asked": ("last", marker)},
    )
    usage = F.when(F.col("role") == "assistant", F.col("_asked.s")).otherwise(F.col("source"))
    return out.withColumn("usage_source", usage).drop("_asked", "_side")


def with_inference_source(inferences: DataFrame, messages: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As-of across tables: an inference takes the source of the chat's latest earlier user message.

    Both tables go through one ordered scan as a tagged union, so no row pairs are formed.
    """
    asked = messages.filter(F.col("role") == "user").select(
        "chat_id", "created_at", F.lit(0).alias("_side"), F.col("message_id").alias("_id"),
        F.struct(F.col("source").alias("s")).alias("_asked"), F.lit(None).cast(_struct_type(inferences)).alias("_row"),
    )
    asking = inferences.select(
        "chat_id", "created_at", F.lit(1).alias("_side"), F.col("inference_id").alias("_id"),
        F.lit(None).cast("struct<s:string>").alias("_asked"), F.struct("*").alias("_row"),
    )
    out = running(
        asked.unionByName(asking), ["chat_id"], ["created_at", "_side", "_id"],
        chunk_rows, {"_latest": ("last", F.col("_asked"))},
    )
    return out.filter(F.col("_side") == 1).select("_row.*", F.col("_latest.s").alias("usage_source"))


def _struct_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def filter_usage(
    rows: DataFrame,
    providers: list[str] | None = None,
    users: list | None = None,
    sources: list[str] | None = None,
) -> DataFrame:
    """Multi-value filters; an empty one is off."""
    for column, values in (("usage_provider", providers), ("user_id", users), ("usage_source", sources)):
        if values:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows


def usage_totals(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count_if(F.col("role") == "user").alias("total_messages"),
        F.countDistinct("user_id").alias("unique_users"),
    )


def used_providers(messages: DataFrame, inferences: DataFrame) -> DataFrame:
    both = messages.select("provider").unionByName(inferences.select("provider"))
    return both.filter(F.col("provider").isNotNull()).distinct()


def effective_budgets(project: DataFrame, config: DataFrame) -> DataFrame:
    """One budget per key and provider: the configured one wins over the project's."""
    both = project.withColumn("origin", F.lit("project")).unionByName(config.withColumn("origin", F.lit("config")))
    return top_per_key(both, ["provider"], [F.col("origin").asc()], 1).drop("rank")


def period_spend(priced: DataFrame, budgets: DataFrame, as_of: Column) -> DataFrame:
    """Spend per provider and user since the start of that provider's own period."""
    starts = budgets.select(
        F.col("provider").alias("_provider"),
        period_start_by(as_of, F.col("period")).cast(priced.schema["created_at"].dataType).alias("_start"),
    )
    since = priced.join(
        starts, (F.col("provider") == F.col("_provider")) & (F.col("created_at") >= F.col("_start"))
    )
    return since.groupBy("provider", "user_id").agg(F.sum("total_cost").alias("spend"))


def project_spend(spend: DataFrame) -> DataFrame:
    return spend.groupBy("provider").agg(F.round(F.sum("spend"), 2).alias("spend"))


def user_spend(spend: DataFrame) -> DataFrame:
    known = spend.filter(F.col("user_id").isNotNull())
    return known.select("provider", "user_id", F.round("spend", 2).alias("spend"))


def budget_status(spend: DataFrame, budgets: DataFrame) -> DataFrame:
    """Status per provider and user from the worst of the project and the user ratio."""
    users, project = user_spend(spend), project_spend(spend).withColumnRenamed("spend", "project_spend")
    rows = users.join(project, "provider").join(budgets, "provider")
    ratio_project = F.when(F.col("limit_usd") > 0, F.col("project_spend") / F.col("limit_usd"))
    ratio_user = F.when(F.col("per_user_limit_usd") > 0, F.col("spend") / F.col("per_user_limit_usd"))
    worst = F.greatest(ratio_project, ratio_user)
    level = (
        F.when(worst >= 1, "exceeded").when(worst >= WARNING_RATIO, "warning").otherwise("ok")
    )
    return rows.select("provider", "user_id", F.round(worst, 4).alias("worst_ratio"), level.alias("level"))


def chat_token_totals(messages: DataFrame) -> DataFrame:
    columns = [*[f"{c}_tokens" for c in TOKEN_CLASSES], "total_tokens"]
    return messages.groupBy("chat_id").agg(*_sums(columns))


def storage_by_user(files: DataFrame, user: str, size: str) -> DataFrame:
    """Files and bytes per user, heaviest first."""
    usage = files.groupBy(user).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))
    return usage.orderBy(F.col("bytes").desc(), F.col(user).asc())
