"""Row-scoped views over the application tables of one project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.chats import first_user_source


def messages_view(
    parts: DataFrame, messages: DataFrame, chats: DataFrame, feedback: DataFrame, users: DataFrame, project
) -> DataFrame:
    """Part-grain messages of one project; a vote sits on the first part only, admin chats are hidden.

    The scope filter runs on chats before any join; the vote is attached per message and kept on the
    smallest part order found by an aggregate, so a message with many parts is not gathered in one task.
    """
    scoped = chats.filter(F.col("project_id") == project)
    kept = scoped.join(first_user_source(messages), "chat_id", "left").filter(
        F.col("source").isNull() | (F.col("source") != "admin")
    )
    heads = kept.select("chat_id", "title", F.col("user_id").alias("owner_id"), F.col("source").alias("chat_source"))
    said = messages.select(
        "message_id", "chat_id", "role", F.col("source").alias("message_source"), "superseded", "total_tokens"
    ).join(heads, "chat_id")
    said = said.join(users, said["owner_id"] == users["user_id"], "left").drop("user_id")
    first = parts.groupBy("message_id").agg(F.min("ord").alias("_first"))
    votes = feedback.select("message_id", "vote", "explanation").join(first, "message_id")
    votes = votes.withColumnRenamed("_first", "ord")
    return parts.join(votes, ["message_id", "ord"], "left").join(said, "message_id")


def memories_view(memories: DataFrame, chats: DataFrame, project) -> DataFrame:
    """Memories reached through a chat of the project."""
    return memories.join(chats.filter(F.col("project_id") == project), "chat_id", "left_semi")


def project_view(df: DataFrame, project, columns: list[str]) -> DataFrame:
    """Rows of the project, exposed columns only."""
    return df.filter(F.col("project_id") == project).select(*columns)


def events_view(events: DataFrame, users: DataFrame, project) -> DataFrame:
    """Events of the project with the actor's name where known."""
    named = users.select(F.col("user_id").alias("_u"), F.col("user_name").alias("actor_user_name"))
    rows = events.filter(F.col("project_id") == project)
    return rows.join(named, rows["actor_user_id"] == F.col("_u"), "left").drop("_u")


def scoped_sql(spark: SparkSession, text: str, views: dict[str, DataFrame]) -> DataFrame:
    """Result of SQL that names the scoped frames in braces, as ``{v_messages}``.

    The names hold for this statement alone: nothing stays in the session, so two projects can be asked at once and neither
    replaces or sees the other's views.
    """
    return spark.sql(text, **views)
