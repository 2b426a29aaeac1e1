"""Versioned assets, sharing, folders and cached results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.sources.shared import cut_lineage

SHARED_FOLDER_ID = "__shared_with_me__"
SHARED_FOLDER_NAME = "Shared with me"
RESULT_TTL_DAYS = 7


def latest_versions(versions: DataFrame, asset: str, version: str, tie: list[str] = ()) -> DataFrame:
    """Newest version per asset, merged inside the map tasks before the shuffle."""
    rest = [c for c in versions.columns if c != asset]
    newest = F.max_by(F.struct(*rest), F.struct(version, *tie))
    return versions.groupBy(asset).agg(newest.alias("_v")).select(asset, "_v.*")


def listed_assets(assets: DataFrame, versions: DataFrame, asset: str, version: str, archived: bool) -> DataFrame:
    """Assets with their newest version, archived or not, newest update first."""
    kept = assets.filter(F.col("archived") == archived)
    rows = kept.join(latest_versions(versions, asset, version), asset)
    return rows.orderBy(F.col("updated_at").desc(), asset)


def next_version(versions: DataFrame, assets: DataFrame, asset: str, version: str) -> DataFrame:
    """Version number the next edit of each asset gets; 1 for a new one."""
    top = versions.groupBy(asset).agg(F.max(version).alias("_top"))
    return assets.select(asset).join(top, asset, "left").select(
        asset, (F.coalesce("_top", F.lit(0)) + 1).alias("next_version")
    )


def version_history(versions: DataFrame, asset: str, version: str) -> DataFrame:
    return versions.orderBy(asset, version)


def shared_assets(shares: DataFrame, assets: DataFrame, latest: DataFrame, access: DataFrame) -> DataFrame:
    """Shares with asset, newest version and how many users were named."""
    counts = access.groupBy("share_id").agg(F.count("user_id").alias("shared_with_count"))
    rows = shares.join(assets, "asset_id").join(latest, "asset_id").join(counts, "share_id", "left")
    return rows.withColumn("shared_with_count", F.coalesce("shared_with_count", F.lit(0).cast("long")))


def visible_shares(shares: DataFrame, access: DataFrame, user: Column) -> DataFrame:
    """Project-wide shares, and specific ones naming the user."""
    named = access.filter(F.col("user_id") == user).select("share_id").distinct()
    wide = shares.filter(F.col("visibility") == "project")
    return wide.unionByName(shares.filter(F.col("visibility") == "specific").join(named, "share_id", "left_semi"))


def folder_list(
    folders: DataFrame, items: DataFrame, shares: DataFrame, access: DataFrame, user: Column, archived: bool = False
) -> DataFrame:
    """Visible folders with item counts; a virtual first row when something is shared with the user."""
    counts = items.groupBy("folder_id").agg(F.count("asset_id").alias("asset_count"))
    seen = folders.filter(
        (F.col("archived") == archived) & ((F.col("visibility") == "public") | (F.col("owner_id") == user))
    )
    rows = seen.join(counts, "folder_id", "left").select(
        F.col("folder_id").cast("string").alias("folder_id"), F.col("name"),
        F.coalesce("asset_count", F.lit(0).cast("long")).alias("asset_count"),
    )
    if archived:
        return rows
    mine = access.filter(F.col("user_id") == user).join(
        shares.filter(F.col("visibility") == "specific").select("share_id"), "share_id"
    )
    virtual = mine.agg(F.count(F.lit(1)).alias("asset_count")).filter(F.col("asset_count") > 0)
    return rows.unionByName(
        virtual.select(F.lit(SHARED_FOLDER_ID).alias("folder_id"), F.lit(SHARED_FOLDER_NAME).alias("name"), "asset_count")
    )


def _closure(folders: DataFrame, node: str, parent: str, own: Column, above: Column) -> DataFrame:
    """``id, flag, cyclic`` of each folder: whether ``own`` holds for it or a folder over it, or ``above`` says so of its parent.

    Pointer doubling: after round k
    every folder knows about its 2^k nearest ancestors, so a chain of depth d takes log2(d) rounds. A folder is written
    again only while it is open: once it has the flag or no more ancestors it is set aside. What is open after as many
    rounds as any tree of this size could take is on a cycle or below one.
    """
    first = folders.select(F.col(node).alias("id"), F.col(parent).alias("up"), own.alias("flag"), above.alias("_over"))
    first = first.select("id", "up", (F.col("flag") | F.coalesce("_over", F.lit(False))).alias("flag"))
    still = F.col("up").isNotNull() & ~F.col("flag")
    step = cut_lineage(first, "closure")
    rounds = math.ceil(math.log2(max(2, step.count()))) + 1
    done = step.filter(~still)
    open_ = step.filter(still)
    for _ in range(rounds):
        if open_.isEmpty():
            break
        known = done.unionByName(open_).select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("flag").alias("_flag"))
        step = open_.join(known, F.col("up") == F.col("_id"), "left").select(
            "id", F.col("_up").alias("up"), F.coalesce("_flag", F.lit(False)).alias("flag")
        )
        step = cut_lineage(step, "closure")
        done = done.unionByName(step.filter(~still))
        open_ = step.filter(still)
    return done.select("id", "flag", F.lit(False).alias("cyclic")).unionByName(open_.select("id", "flag", F.lit(True).alias("cyclic")))


def _under(folders: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """``id, flag, cyclic`` of each folder, flagged if one of ``roots`` (``node``) is over it."""
    marked = roots.select(F.col("node").alias("_root")).distinct()
    rows = folders.join(marked, F.col(parent) == F.col("_root"), "left")
    return _closure(rows, node, parent, F.lit(False), F.col("_root").isNotNull())


def descendants(folders: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """All folders below the roots (column ``node``), the roots themselves left out; cycle-safe."""
    return _under(folders, node, parent, roots).filter("flag").select(F.col("id").alias("node")).join(roots, "node", "left_anti")


def move_makes_cycle(folders: DataFrame, node: str, parent: str, moved: DataFrame, target: DataFrame) -> DataFrame:
    """Whether putting ``moved`` under ``target`` would make it its own ancestor: the target is the moved folder or below it."""
    below = _under(folders, node, parent, moved).filter("flag").select(F.col("id").alias("node"))
    inside = below.unionByName(moved.select("node"))
    return target.join(inside, "node", "left_semi").agg((F.count(F.lit(1)) > 0).alias("cycle"))


def folder_cycles(folders: DataFrame, node: str, parent: str) -> DataFrame:
    """Folders on a cycle or below one: they hang under no top-level folder and none whose parent is missing."""
    return _closure(folders, node, parent, F.lit(False), F.lit(False)).filter("cyclic").select(F.col("id").alias("node"))


def private_context(folders: DataFrame, node: str, parent: str, private: Column) -> DataFrame:
    """Each folder with whether it or an ancestor is private."""
    found = _closure(folders, node, parent, private, F.lit(False))
    return found.select(F.col("id").alias(node), F.col("flag").alias("is_private"))


def asset_items(own: DataFrame, standalone: DataFrame, shared: DataFrame) -> DataFrame:
    """Own, standalone and shared assets in one list; a shared asset that is one's own shows once."""
    mine = own.select("asset_id").unionByName(standalone.select("asset_id")).distinct()
    others = shared.join(mine, "asset_id", "left_anti")
    kind = F.when(F.col("visibility") == "specific", "shared-with-me").otherwise("shared-project")
    columns = ["asset_id", "title", "author", "created_at", "folder_id", "is_pinned", "is_favorited"]
    return (
        own.select(*columns).withColumn("kind", F.lit("own"))
        .unionByName(standalone.select(*columns).withColumn("kind", F.lit("own-standalone")))
        .unionByName(others.withColumn("kind", kind).select(*columns, "kind"))
    )


def search_items(items: DataFrame, text: str) -> DataFrame:
    if not text.strip():
        return items
    needle = F.lit(text.lower())
    return items.filter(F.contains(F.lower("title"), needle) | F.contains(F.lower("author"), needle))


def folder_level(items: DataFrame, folder_id: Column | None) -> DataFrame:
    """Items of one folder (null is the top level); the shared-with-me folder is its own list."""
    if folder_id is None:
        here = F.col("folder_id").isNull()
    else:
        here = F.col("folder_id") == folder_id
    return items.filter(here & (F.col("kind") != "shared-with-me"))


def item_sections(items: DataFrame) -> DataFrame:
    """Pinned first, then favourites, then the rest."""
    section = F.when(F.col("is_pinned"), "pinned").when(F.col("is_favorited"), "favorite").otherwise("entry")
    return items.withColumn("section", section)


def sort_items(items: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted with the title as ascending tie-break."""
    key = F.col(column).desc() if descending else F.col(column).asc()
    return items.orderBy(key, F.col("title").asc(), F.col("asset_id").asc())


def favorites(marks: DataFrame, assets: DataFrame, chats: DataFrame, user: Column, project: Column) -> DataFrame:
    """Favourite assets of a user in a project; a chat asset belongs to its chat's project."""
    home = chats.select(F.col("chat_id"), F.col("project_id").alias("_chat_project"))
    rows = marks.filter(F.col("user_id") == user).join(assets, "asset_id").join(home, "chat_id", "left")
    return rows.filter(F.coalesce("_chat_project", "project_id") == project).select("asset_id")


def cache_expired(cached_at: Column, previous_run: Column) -> Column:
    """Older than the last scheduled run; never without a schedule."""
    return F.coalesce(cached_at < previous_run, F.lit(False))


def backfill(wanted: DataFrame, cached: DataFrame, history: DataFrame, key: list[str], value: str) -> DataFrame:
    """Cached values, and for missing ids the value found in history."""
    missing = wanted.join(cached.select(*key), key, "left_anti")
    found = missing.join(history.select(*key, value), key)
    return wanted.join(cached.select(*key, value).unionByName(found.select(*key, value)), key, "left")


def unexpired(results: DataFrame, stored_at: str, as_of: Column, days: int = RESULT_TTL_DAYS) -> DataFrame:
    return results.filter(F.col(stored_at) > as_of - F.make_dt_interval(F.lit(days)))
