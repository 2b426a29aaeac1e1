"""Event logs: throttling, sessions, viewers, favourites."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.operators.ordered import CHUNK_ROWS, running, with_chunks
from tablescope.sources.shared import cut_lineage

THROTTLE_SECONDS = 120
SESSION_GAP_SECONDS = 3600
ANONYMOUS = "anonymous"

METADATA = (
    "struct<type:string,versionNumber:int,format:string,trigger:string,scope:string,favorited:boolean,title:string>"
)


def asset_events(events: DataFrame, users: DataFrame, asset_type: str, asset_id: Column, limit: int) -> DataFrame:
    """Newest events of an asset with the actor's name; a chat also shows downloads made in it."""
    if asset_type == "story":
        mine = (F.col("asset_type") == "story") & (F.col("story_id") == asset_id)
    else:
        mine = (F.col("chat_id") == asset_id) & ((F.col("asset_type") == "chat") | (F.col("type") == "download"))
    # the cut comes before the join: only the shown rows look up a name
    newest = events.filter(mine).orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(limit)
    names = users.select(F.col("user_id").alias("actor_user_id"), F.col("user_name").alias("actor_name"))
    return newest.join(names, "actor_user_id", "left")


# ---- throttle


def _next_kept(ts: np.ndarray, window: int) -> np.ndarray:
    """Index of the next event kept after each event is kept; ``len(ts)`` if none."""
    return np.searchsorted(ts, ts + window, side="right")


def _chunk_steps(ts: np.ndarray, window: int, start: int) -> tuple[list[int], list[int]]:
    """What a chunk does to the last kept time, as steps (lowest entry, exit).

    An entry below the first step behaves like no entry. Equal neighbouring exits are merged.
    """
    ts = np.asarray(ts, dtype=np.int64)
    jump = _next_kept(ts, window)
    end = np.where(jump < len(ts), jump, np.arange(len(ts)))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    exits = np.append(ts[end], -1)  # -1: nothing kept, an entry too old to matter later
    first = int(np.searchsorted(ts, start + window, side="left"))
    lows = np.concatenate(([np.iinfo(np.int64).min], ts[:first] - window))
    outs = exits[: first + 1]
    fresh = np.concatenate(([True], outs[1:] != outs[:-1]))
    return lows[fresh].tolist(), outs[fresh].tolist()


def _kept_in_chunk(ts: np.ndarray, window: int, entry: int) -> list[int]:
    ts = np.asarray(ts, dtype=np.int64)
    jump = _next_kept(ts, window)
    at = int(np.searchsorted(ts, entry + window, side="right")) if entry >= 0 else 0
    kept = []
    while at < len(ts):
        kept.append(at)
        at = int(jump[at])
    return kept


def throttle(
    events: DataFrame, keys: list[str], ts: str, event_id: str,
    window_seconds: int = THROTTLE_SECONDS, chunk_seconds: int = 3600,
) -> DataFrame:
    """Events kept when one is dropped if a kept event of its key lies at most the window before it.

    An event more than the window after the one before it is always kept and starts an island; what follows
    within the window of that start is always dropped. Only events further into an island depend on what was
    kept before them, and those go to ``_chain``.
    """
    if chunk_seconds < window_seconds:
        raise ValueError("a chunk must be at least as long as the window")
    window, width = window_seconds * 1_000_000, chunk_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # of events at one instant only the first can be kept
    rows = events.groupBy(*keys, micros.alias("_t")).agg(F.min(event_id).alias("_id"))
    chunk = F.floor(F.col("_t") / width).cast("long")
    rows = running(rows, keys, ["_t"], chunk, {"_before": ("max", F.col("_t"))}, inclusive=False)
    starts = F.col("_before").isNull() | (F.col("_t") - F.col("_before") > window)
    rows = running(rows, keys, ["_t"], chunk, {"_island": ("last", F.when(starts, F.col("_t")))})
    # three branches read the islands, so they are written once
    rows = cut_lineage(rows.select(*keys, "_island", "_t", "_id"), "islands")
    first = rows.filter(F.col("_t") == F.col("_island")).select("_id")
    further = rows.filter(F.col("_t") - F.col("_island") > window)
    kept = first.unionByName(_chain(further, [*keys, "_island"], window, width))
    return events.join(kept.select(F.col("_id").alias(event_id)), event_id, "left_semi")


def _chain(rows: DataFrame, keys: list[str], window: int, width: int) -> DataFrame:
    """Ids kept by the greedy rule, whose first row per key is kept.

    Time chunks per key make it parallel: each chunk is reduced to a step function of the last kept time,
    the short list of step functions is walked per key, and each chunk then picks its rows knowing where it
    starts. A busy key costs one task per chunk, never one task for all its events. Keys are many, islands of a few
    events mostly, so the walk takes the rows of a sorted partition in one go and not key by key.
    """
    chunks = (
        rows.withColumn("_chunk", F.floor(F.col("_t") / width).cast("long"))
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_t", "_id"))).alias("_e"))
        .withColumns({"_ts": F.col("_e._t"), "_ids": F.col("_e._id")})
        .drop("_e")
    )

    @F.pandas_udf("struct<low:array<long>,exit:array<long>>")
    def steps(times: pd.Series, chunk: pd.Series) -> pd.DataFrame:
        made = [_chunk_steps(t, window, c * width) for t, c in zip(times, chunk)]
        return pd.DataFrame({"low": [m[0] for m in made], "exit": [m[1] for m in made]})

    stepped = chunks.select(*keys, "_chunk", steps("_ts", "_chunk").alias("_s")).select(*keys, "_chunk", "_s.*")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for batch in batches:
            entries = []
            for first, lows, exits in zip(*(batch.column(c).to_pylist() for c in ("_first", "low", "exit"))):
                entry = -1 if first else last
                entries.append(entry)
                last = exits[bisect_right(lows, entry) - 1 if entry >= 0 else 0]
            named = [*keys, "_chunk"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, named), pa.array(entries, pa.int64())], names=[*named, "_entry"])

    in_order = Window.partitionBy(*keys).orderBy("_chunk")
    listed = stepped.withColumn("_first", F.row_number().over(in_order) == 1).sortWithinPartitions(*keys, "_chunk")
    schema = stepped.select(*keys, "_chunk", F.lit(0).cast("long").alias("_entry")).schema
    entries = listed.mapInArrow(walk, schema)

    @F.pandas_udf("array<int>")
    def pick(times: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_kept_in_chunk(t, window, e) for t, e in zip(times, entry)])

    picked = chunks.join(entries, [*keys, "_chunk"]).withColumn("_at", F.explode(pick("_ts", "_entry")))
    return picked.select(F.element_at("_ids", F.col("_at") + 1).alias("_id"))


def throttle_page_views(
    events: DataFrame, actor: str, asset: list[str], ts: str = "created_at", event_id: str = "event_id"
) -> DataFrame:
    """Only page views with an actor are throttled; everything else is stored."""
    limited = (F.col("type") == "page_view") & F.col(actor).isNotNull()
    free = events.filter(~F.coalesce(limited, F.lit(False)))
    return free.unionByName(throttle(events.filter(limited), [actor, *asset], ts, event_id))


# ---- groups and sessions


def actor_key(actor: str) -> Column:
    return F.coalesce(F.col(actor).cast("string"), F.lit(ANONYMOUS))


def group_by_actor(events: DataFrame, actor: str, ts: str = "created_at") -> DataFrame:
    """Rows with their actor group and the group's newest time, to be ordered by it.

    The group stays rows: an actor with a third of the events is never packed into one value.
    """
    keyed = events.withColumn("actor_key", actor_key(actor))
    last = keyed.groupBy("actor_key").agg(F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("items"))
    return keyed.join(last, "actor_key")


def order_groups(grouped: DataFrame, ts: str = "created_at", event_id: str = "event_id") -> DataFrame:
    return grouped.orderBy(F.col("last_at").desc(), "actor_key", F.col(ts).desc(), F.col(event_id).desc())


def sessionise(
    segments: DataFrame, keys: list[str], start: str, duration_ms: str, segment_id: str,
    version: str | None = None, gap_seconds: int = SESSION_GAP_SECONDS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sessions of view segments: a segment joins if it starts less than the gap after all before it ended.

    A session has its start, the summed duration and the newest version known.
    """
    begin = F.unix_millis(F.col(start).cast("timestamp"))
    rows = segments.select(
        *keys, F.col(start).alias("_at"), begin.alias("_start"), F.col(segment_id).alias("_id"),
        F.coalesce(F.col(duration_ms), F.lit(0)).cast("long").alias("_ms"),
        (F.col(version) if version else F.lit(None).cast("int")).alias("_version"),
    )
    order, chunk = ["_start", "_id"], F.col("_part")
    # written once: both scans read it twice
    rows = cut_lineage(with_chunks(rows, keys, "_start", chunk_rows, "_part"), "session-segments")
    ends = running(
        rows, keys, order, chunk, {"_before": ("max", F.col("_start") + F.col("_ms"))}, inclusive=False
    )
    opens = F.col("_before").isNull() | (F.col("_start") - F.col("_before") >= gap_seconds * 1000)
    marked = running(
        ends, keys, order, chunk, {"_session": ("last", F.when(opens, F.struct("_start", "_id")))}
    )
    known = F.when(F.col("_version").isNotNull(), F.struct("_start", "_id"))
    return marked.groupBy(*keys, "_session").agg(
        F.min("_at").alias("started_at"),
        F.sum("_ms").alias("duration_ms"),
        F.max_by("_version", known).alias("version"),
        F.count(F.lit(1)).alias("segments"),
    ).drop("_session")


def viewers(
    events: DataFrame, actor: str, ts: str, event_id: str, started_at: str, duration_ms: str, version: str
) -> DataFrame:
    """Per actor the sessions, or the raw page views where there is none; with total time and last event."""
    rows = events.filter(F.col("type").isin("page_view", "view_duration")).withColumn("actor_key", actor_key(actor))
    groups = rows.groupBy("actor_key").agg(
        F.max(ts).alias("last_at"),
        F.coalesce(F.sum(F.when(F.col("type") == "view_duration", F.col(duration_ms))), F.lit(0).cast("long")).alias(
            "total_ms"
        ),
        F.count_if(F.col("type") == "view_duration").alias("_segments"),
    )
    sessions = sessionise(
        rows.filter(F.col("type") == "view_duration"), ["actor_key"], started_at, duration_ms, event_id, version
    ).select("actor_key", "started_at", "duration_ms", "version")
    # an actor has sessions exactly when there is a view segment
    views = rows.filter(F.col("type") == "page_view").select(
        "actor_key", F.col(ts).alias("started_at"), F.lit(None).cast("long").alias("duration_ms"),
        F.col(version).alias("version"), F.lit(True).alias("_view"),
    )
    both = sessions.withColumn("_view", F.lit(False)).unionByName(views).join(groups, "actor_key")
    return both.filter(~F.col("_view") | (F.col("_segments") == 0)).drop("_view", "_segments")


def current_favorites(events: DataFrame, actor: str, badge: str, ts: str, event_id: str) -> DataFrame:
    """Actors whose newest favourite event is ``added``."""
    keyed = events.withColumn("actor_key", actor_key(actor))
    newest = keyed.groupBy("actor_key").agg(F.max_by(F.struct(badge), F.struct(ts, event_id)).alias("_b"))
    return newest.filter(F.col(f"_b.{badge}") == "added").select("actor_key")


def search_rows(rows: DataFrame, group_label: str, columns: list[str], text: str) -> DataFrame:
    """All rows of a group whose label matches, else the rows that match."""
    if not text:
        return rows
    needle = F.lit(text.lower())
    test = F.lit(False)
    for c in (group_label, *columns):
        test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), needle), F.lit(False))
    return rows.filter(test)


def with_metadata(events: DataFrame, metadata: str) -> DataFrame:
    """Version, badge and title from the metadata, by its type."""
    m = F.from_json(metadata, METADATA)
    kind = m["type"]
    version = F.when(kind.isin("page_view", "download", "fork", "view_duration"), m["versionNumber"])
    badge = (
        F.when(kind == "download", m["format"])
        .when(kind == "refresh", m["trigger"])
        .when(kind == "fork", m["scope"])
        .when(kind == "favorite", F.when(m["favorited"], "added").otherwise("removed"))
    )
    return events.withColumns(
        {"version": version, "badge": badge, "download_title": F.when(kind == "download", m["title"])}
    )
