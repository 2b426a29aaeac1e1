"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation's turns are dealt into blocks of ``width`` columns ``t1 .. tw``, each holding a turn's id (its digest and its
bytes). ``GROUP BY block, key, ROLLUP(t1 .. tw)`` aggregates all prefixes together, and ``grouping_id`` tells how long
each is. ``key`` names the node that the block before ended in, so that long conversations go on in further blocks. A
node's name is the exclusive or of two 64-bit hashes of each of its turns with its depth; that is associative, so a very long
conversation is named in parts.

What a node says about its subtree comes from a second ROLLUP. Each node is owned by its smallest member; along a
conversation these grow, so it owns the last part of its path. A subtree is owned by the members of its top, whole but
for what the top's own owner owns above it. So the second ROLLUP sums what owners own, of owners only: copies that own nothing
cost nothing there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.ordered import running, with_row_number
from tablescope.sources.shared import cut_lineage

#: Turn-id columns of a block.
WIDTH = 8
#: A conversation starts with turns of the one whose id is the next lower multiple of this ...
FAMILY = 5
#: ... fewer than this many of them.
SHARED = 9
#: Ids of conversations that are joined to one string lie in a range of two to the power of this.
ID_BITS = 14
#: Rows of a very long conversation that are scanned together.
CHUNK = 4096

EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, id`` with ``id`` the digest and UTF-8 bytes of role and text; from here on no text is moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    # the length of the role tells where it ends
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.struct(digest.alias("digest"), size.alias("bytes")).alias("id")
    )


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """``conv_id, depth, id, length`` of the rebuilt conversations; one row of depth 0 for those without turns.

    ``turns`` are ``conv_id, turn, id``. The first ``h = crc32(conv_id) % shared`` turns come from the conversation whose id is
    ``conv_id - conv_id % family``, the rest are the own ones after the first ``h``.
    """
    numbered = with_row_number(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")])
    whole = numbered.groupBy("conv_id").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    lead = F.col("conv_id") - F.col("conv_id") % family
    member = F.struct("conv_id", "first", "n", h.alias("h"))
    # ids that share a lead are fewer than twice ``family``
    families = whole.groupBy(lead.alias("lead")).agg(F.collect_list(member).alias("members"))
    lead_n = F.coalesce(F.get(F.filter("members", lambda m: m["conv_id"] == F.col("lead")), F.lit(0))["n"], F.lit(0))
    families = families.withColumn("lead_n", lead_n)

    def length(m: Column) -> Column:
        return F.least(m["h"], F.col("lead_n")) + F.greatest(m["n"] - m["h"], F.lit(0))

    followers = F.transform("members", lambda m: F.struct(m["conv_id"].alias("conv_id"), m["h"].alias("h"), length(m).alias("length")))
    of_each = families.withColumn("followers", followers).select("lead", "lead_n", "followers", F.inline("members"))
    own_length = length({"h": F.col("h"), "n": F.col("n")})
    of_each = cut_lineage(
        of_each.select(
            "conv_id", "first", "h", F.least("h", "lead_n").alias("from_lead"), own_length.alias("length"),
            F.when(F.col("conv_id") == F.col("lead"), F.col("followers")).alias("followers"),
        ),
        "trie-conversations",
    )

    joined = numbered.join(of_each, "conv_id").withColumn("at", F.col("rn") - F.col("first") + 1)
    borrowed = F.transform(
        F.filter(F.coalesce("followers", F.array()), lambda f: F.col("at") <= f["h"]),
        lambda f: F.struct(f["conv_id"].alias("conv_id"), F.col("at").alias("depth"), f["length"].alias("length")),
    )
    own = F.struct("conv_id", (F.col("from_lead") + F.col("at") - F.col("h")).alias("depth"), "length")
    targets = F.when(F.col("at") > F.col("h"), F.array_append(borrowed, own)).otherwise(borrowed)
    rows = joined.select("id", F.inline(targets)).select("conv_id", "depth", "id", "length")
    blank = of_each.filter("length = 0").select("conv_id", F.lit(0).cast("long"), F.lit(None).cast(turns.schema["id"].dataType), "length")
    return rows.union(blank)


def _step(depth: Column, turn: Column) -> tuple[Column, Column]:
    """What a turn at a depth adds to the two halves of a node's name; nothing for no turn."""
    return tuple(
        F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(half), depth.cast("long"), turn["digest"]))
        for half in (1, 2)
    )


def blocks_of(rebuilt: DataFrame, width: int = WIDTH) -> DataFrame:
    """``conv_id, block, kx, ky, length, t1 ..``: the blocks of each conversation, keyed by the node before them."""
    block = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / width)).otherwise(0).cast("long")
    x, y = _step(F.col("depth"), F.col("id"))
    held = rebuilt.groupBy("conv_id", block.alias("block")).agg(
        F.max("length").alias("length"),
        F.bit_xor(x).alias("x"),
        F.bit_xor(y).alias("y"),
        F.array_sort(F.collect_list(F.struct("depth", "id"))).alias("ids"),  # at most ``width``
    )
    columns = [F.get("ids", F.lit(i))["id"].alias(f"t{i + 1}") for i in range(width)]
    rows = cut_lineage(held.select("conv_id", "block", "length", "x", "y", *columns), "trie-blocks")
    keyed = running(
        rows, ["conv_id"], ["block"], F.floor(F.col("block") / CHUNK),
        {"kx": ("xor", F.col("x")), "ky": ("xor", F.col("y"))}, inclusive=False,
    )
    return cut_lineage(keyed.fillna(0, ["kx", "ky"]), "trie-keyed")


def rolled_up(blocks: DataFrame, aggregates: str, width: int = WIDTH) -> DataFrame:
    """``aggregates`` (SQL) per node, with its name ``x, y``, its parent's ``px, py``, its ``depth`` and the ``bytes`` of its last
    text."""
    columns = [f"t{i + 1}" for i in range(width)]
    found = blocks.sparkSession.sql(
        f"SELECT block, kx, ky, {', '.join(columns)}, {width} - bit_count(grouping_id()) AS used, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, kx, ky, ROLLUP({', '.join(columns)})",
        blocks=blocks,
    )
    last = F.coalesce(*(F.when(F.col("used") == i + 1, F.col(c)) for i, c in enumerate(columns)))
    # the unused columns of a node are null; a conversation that ends earlier has null in a used one
    real = found.filter(last.isNotNull() | ((F.col("used") == 0) & (F.col("block") == 0)))
    depth = F.col("block") * width + F.col("used")
    names = {"x": F.col("kx"), "y": F.col("ky")}
    for i, c in enumerate(columns):
        for half, step in zip("xy", _step(F.col("block") * width + i + 1, F.col(c))):
            names[half] = names[half].bitwiseXOR(step)
    named = real.withColumns({**names, "depth": depth, "bytes": F.coalesce(last["bytes"], F.lit(0)), "_last": last})
    px, py = (F.when(F.col("depth") > 0, F.col(h).bitwiseXOR(s)) for h, s in zip("xy", _step(F.col("depth"), F.col("_last"))))
    return named.withColumns({"px": px, "py": py}).drop("block", "kx", "ky", "used", "_last", *columns)


def end_digests(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """``x, y, ends_sha256``: the digest of the ascending ids, comma-joined, of the conversations that end at a node.

    Ids are sorted and joined in ranges of limited size on many tasks; the digest itself, sequential by nature, streams over
    those strings and holds one at a time.
    """
    at_end = F.col("length") <= (F.col("block") + 1) * width
    ends = blocks.filter(at_end).select(
        F.col("kx").bitwiseXOR(F.col("x")).alias("x"), F.col("ky").bitwiseXOR(F.col("y")).alias("y"), "conv_id",
        F.shiftright("conv_id", ID_BITS).alias("part"),
    )
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = ends.groupBy("x", "y", "part").agg(ids.alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, seen = None, None
        for batch in batches:
            done = []
            for x, y, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y) == node:
                    seen.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, seen.hexdigest()))
                    node, seen = (x, y), hashlib.sha256(ids.encode())
            if done:
                yield as_batch(done)
        if node is not None:
            yield as_batch([(*node, seen.hexdigest())])

    def as_batch(done: list) -> pa.RecordBatch:
        x, y, digest = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(digest)], ["x", "y", "ends_sha256"])

    ordered = parts.repartition("x", "y").sortWithinPartitions("x", "y", "part").select("x", "y", "ids")
    return ordered.mapInArrow(digests, "x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, width: int = WIDTH, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, from ``conversations`` (``conv_id, turn, role, text`` and any others).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``. Turns go by ``turn``, null first, those of one number by the digest of role and text. Null role or text
    counts as empty. A row repeated is a turn repeated. Rows without ``conv_id`` belong to no conversation. An empty table gives an
    empty result; other columns are not read. Turns and nodes are told apart by 128-bit digests.
    """
    blocks = blocks_of(rebuilt_turns(turn_ids(conversations), family, shared), width)
    found = cut_lineage(rolled_up(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs", width), "trie-nodes")
    children = found.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = found.join(children, ["x", "y"], "left").fillna(0, ["n_children"])
    nodes = cut_lineage(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie-children")

    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    owning = blocks.join(owned, "conv_id")
    below = rolled_up(owning, "sum(saved) AS saved_below, sum(leaves) AS n_leaves", width).select("x", "y", "saved_below", "n_leaves")
    # what a node's owner owns above it
    placed = running(
        nodes, ["conv_id"], ["depth"], F.floor(F.col("depth") / CHUNK), {"above": ("sum", F.col("saved"))}, inclusive=False
    )
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    return (
        placed.join(below, ["x", "y"])
        .join(end_digests(blocks, width), ["x", "y"], "left")
        .join(parents, ["px", "py"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("saved_below") - F.coalesce("above", F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
        )
    )
