"""Near duplicates by Jaccard similarity of word n-grams, as a blocked sparse product of the incidence matrix.

Rows of the matrix are distinct n-gram sets, columns are n-grams; the product of two rows is their overlap. Of the
columns of a row only a prefix matters for finding partners: under any one order of all n-grams, rows A and B with
``100 |A n B| >= 80 |A u B|`` have one of their first ``n - ceil(0.8 n) + 1`` n-grams in common, and ``e + 1`` of them if
the prefixes are longer by ``e``. The order here is by hash, with n-grams seen very often put last. Spark deals the
columns out in blocks of their hashes. Within a column

1. every row is paired with a few leaders of the column only, which is linear in the column, and the rows that prove to
   be similar are joined to components. Leaders are the rows with the least share of n-grams nobody else has, as what is
   similar to any row of a group is most likely similar to those;
2. what is left are pairs in different components. As similar rows share more than ``e`` columns, each row leaves out the
   ``e`` widest of its own (widest by a count over all rows), and the columns that still hold several components and are
   not wide have their pairs multiplied;
3. rows of wide columns, short ones mostly that consist of a much used passage, are taken up again with all their
   n-grams, now in the order of their exact counts, so that what is much used comes last.

Overlaps accumulate per pair over the columns. A pair is dropped if its sizes differ too much, if either row has too many
n-grams of its own, or if what its prefixes have in common and all they leave out cannot reach the overlap its sizes ask
for; the whole rows of the others are multiplied. So groups of copies, exact or near, cost as much as their size and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import named
from tablescope.llm.graph import components
from tablescope.sources.shared import cut_lineage

WORDS = 5
#: Least similarity, in hundredths.
SIMILAR = 80
#: N-grams that one task has seen this often are candidates for the list of frequent ones ...
FREQUENT_IN_TASK = 2
#: ... which holds this many at most. It only decides the order of columns, so that no result depends on it.
FREQUENT = 50_000
#: A row's prefix is longer than need be by one n-gram in so many.
LONGER = 20
#: Columns of more rows than this are wide.
WIDE = 32
#: Bits of a row's sketch, in words of 64.
SKETCH = 8
#: Rows of a column that all its rows are paired with first.
LEADERS = 4
#: So many ids, some 64 MB in memory, are broadcast at most.
BROADCAST_IDS = 2_000_000

#: Rows handled at once.
STEP_ROWS = 500
#: Bytes of text that are hashed at once; some ten arrays of 8 bytes for each are held meanwhile.
CHUNK = 1 << 18

#: Odd multipliers and a finaliser's constants (fixed values of no meaning).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
OF_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of texts, A-Z lower-cased.

    A text of fewer words has one n-gram, of all its words; a text without words has none. Many texts are hashed at
    once: a word's hash is a difference of running sums of its bytes times powers of an odd number, shifted back by the
    inverse power of its place.
    """

    def __init__(self, size: int = WORDS):
        self.size = size
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _powers(self, count: int) -> None:
        if len(self.powers) < count:
            inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
            self.powers, self.inverses = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count, m, np.uint64)])) for m in (STEP, inverse)
            )

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for text in texts:
            held.append(text.encode() if text else b"")
            size += len(held[-1]) + 1
            if size >= CHUNK:
                yield from self._chunk(held)
                held, size = [], 0
        if held:
            yield from self._chunk(held)

    def _chunk(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", np.uint8)
        self._powers(len(data))
        space = IS_SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(OF_BYTE[data] * self.powers[: len(data)], dtype=np.uint64)])
        words = _mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        places = np.cumsum([1, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(starts, places)
        grams = _mixed(self._rolled(words, self.size)) if len(words) >= self.size else words[:0]
        for begin, end in zip(bounds.tolist(), bounds[1:].tolist()):
            if end - begin >= self.size:
                found = np.sort(grams[begin : end - self.size + 1])
                different = np.empty(len(found), bool)
                different[0] = True
                np.not_equal(found[1:], found[:-1], out=different[1:])
                yield found[different]
            else:
                yield _mixed(self._rolled(words[begin:end], end - begin)) if end > begin else words[:0]

    @staticmethod
    def _rolled(words: np.ndarray, width: int) -> np.ndarray:
        count = len(words) - width + 1
        total = np.full(count, width, np.uint64)
        for i in range(width):
            total = (total + words[i : i + count]) * STEP
            total ^= total >> np.uint64(29)
        return total


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    return n + (-similar * n // 100) + 1 + n // LONGER if n else 0


def frequent_ngrams(docs: DataFrame, size: int, similar: int, most: int) -> np.ndarray:
    """The most frequent n-grams among the prefixes by hash; at most ``most``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, many = Shingler(size), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                for found in shingler.sets(batch.column(0).slice(at, STEP_ROWS).to_pylist()):
                    held.append(found[: prefix_length(len(found), similar)])
                    many += len(held[-1])
                if many > 2_000_000:
                    yield counts(held)
                    held, many = [], 0
        if held:
            yield counts(held)
        pa.default_memory_pool().release_unused()

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        held.clear()
        values.sort()
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
        times = np.diff(np.append(first, len(values)))
        often = times >= FREQUENT_IN_TASK
        return pa.RecordBatch.from_arrays(
            [pa.array(values[first][often].view(np.int64)), pa.array(times[often])], names=["ngram", "times"]
        )

    rows = docs.select("text").mapInArrow(counted, "ngram long, times long").groupBy("ngram").agg(F.sum("times").alias("times"))
    top = rows.orderBy(F.desc("times"), "ngram").limit(most).select("ngram").toPandas()  # bounded by ``most``
    return np.sort(top["ngram"].to_numpy(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, size: int, similar: int, frequent: np.ndarray) -> DataFrame:
    """Per document: ``doc_id``, ``n`` (its n-grams), ``node`` (hash of the set), ``prefix`` (its first n-grams) and a
    ``sketch``: for each of some bits, whether the n-grams that belong to it are odd in number."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def first_of(found: np.ndarray, last: np.ndarray) -> np.ndarray:
        length = prefix_length(len(found), similar)
        if not len(last):
            return found[:length]
        for some in (found[: 2 * length], found):
            often = last[np.minimum(np.searchsorted(last, some), len(last) - 1)] == some
            seldom = some[~often]
            if len(seldom) >= length or len(some) == len(found):
                break
        return np.concatenate([seldom, some[often]])[:length]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(size), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                sizes, nodes, firsts, sketches = [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                for found in shingler.sets(part.column(1).to_pylist()):
                    sizes.append(len(found))
                    nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                    firsts.append(first_of(found, last))
                    sketches.append(sketch_of(found))
                offsets = np.cumsum([len(f) for f in firsts]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.array(nodes, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64))),
                        pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sketches)), SKETCH).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "node", "prefix", "sketch"],
                )
        pa.default_memory_pool().release_unused()

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {key_type}, n long, node long, prefix array<long>, sketch array<long>")


def sketch_of(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def whole_rows(docs: DataFrame, wanted: DataFrame, size: int, exploded: bool = False) -> DataFrame:
    """``node, ngrams`` (packed, sorted) of the documents in ``wanted`` (``rep``), or ``node, ngram`` one by one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                sets = list(shingler.sets(batch.column(0).slice(at, STEP_ROWS).to_pylist()))
                packed = [f.tobytes() for f in sets]
                nodes = np.array([xxhash.xxh3_64_intdigest(p) for p in packed], np.uint64).view(np.int64)
                if exploded:
                    grams = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                    columns = [pa.array(np.repeat(nodes, [len(f) for f in sets])), pa.array(grams)]
                else:
                    columns = [pa.array(nodes), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "ngram" if exploded else "ngrams"])
        pa.default_memory_pool().release_unused()

    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    if exploded:
        return texts.select("text").mapInArrow(rows, "node long, ngram long")
    return texts.select("text").mapInArrow(rows, "node long, ngrams binary").dropDuplicates(["node"])


def _share(similar: int, n: Column) -> Column:
    """``ceil(similar n / 100)`` in whole numbers."""
    return F.floor((similar * n + 99) / 100)


def _spare(similar: int, n: Column) -> Column:
    """How many of its columns ``seldom_columns`` leaves out of a row of ``n`` n-grams."""
    return F.floor(_share(similar, n) / LONGER)


def in_size(similar: int, na: str, nb: str) -> Column:
    """Whether rows of so many n-grams can be similar at all."""
    return 100 * F.least(na, nb) >= similar * F.greatest(na, nb)


def sketches_allow(similar: int, a: str, b: str, total: Column) -> Column:
    """Whether the sketches of two rows of ``total`` n-grams let them be similar: bits that differ between them are n-grams
    that only one of the rows has. A row without a sketch is allowed all."""
    differ = F.lit(0)
    for i in range(SKETCH):
        differ = differ + F.coalesce(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])), F.lit(0))
    return (100 + similar) * (total - differ) >= 2 * similar * total


def may_be_similar(similar: int, seldom: bool = False) -> Column:
    """Whether the overlap ``both`` of the prefixes of two rows of ``na`` and ``nb`` n-grams allows for enough in all.

    Up to the end of the shorter-reaching prefix the overlap is ``both``; beyond it are at most the n-grams that the
    prefix of the row it belongs to leaves out. Where ``both`` is counted over ``seldom`` columns only, what the rows left
    out comes on top: as both go by one order, the common columns that either left out are the widest common ones, and
    no more than the larger of the two numbers.
    """

    def left_out(n: Column) -> Column:
        return _share(similar, n) - 1 - F.floor(n / LONGER)

    beyond = F.greatest(left_out(F.col("na")), left_out(F.col("nb")))
    if seldom:
        beyond = beyond + F.greatest(_spare(similar, F.col("na")), _spare(similar, F.col("nb")))
    return in_size(similar, "na", "nb") & ((F.col("both") + beyond) * (100 + similar) >= similar * (F.col("na") + F.col("nb")))


def open_columns(members: DataFrame) -> DataFrame:
    """``members`` (``ngram, node, n, most, place, sketch, root``) of the columns that hold several components, with the least as
    ``first`` and the number of rows as ``width``. ``most`` is how many n-grams of a row others may have."""
    several = (
        members.groupBy("ngram")
        .agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count("*").alias("width"))
        .filter("first <> last")
    )
    return members.join(several.select("ngram", "first", "width"), "ngram")


def meeting(members: DataFrame, similar: int) -> DataFrame:
    """``a, b, na, nb`` of the pairs of rows in different components that meet in a column, once per column.

    Where ``place`` is known, the place of a column in its row's order, the column must be early enough in both: of the
    overlap that the sizes ask for, the first n-gram in common has all the others behind it. Where sketches are known,
    bits that differ between them are n-grams that only one of the rows has.
    """
    left, right = (
        side.select("ngram", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "most", "place", "sketch", "root")))
        for x, side in (("a", members.filter("root <> first")), ("b", members))
    )
    total = F.col("n_a") + F.col("n_b")
    spare = 1 - F.floor((similar * total + 99 + similar) / (100 + similar))
    return left.join(right, "ngram").filter(
        (F.col("root_a") > F.col("root_b"))
        & in_size(similar, "n_a", "n_b")
        & ((100 + similar) * F.least("most_a", "most_b") >= similar * total)
        & sketches_allow(similar, "sketch_a", "sketch_b", total)
        & (F.col("place_a") <= F.col("n_a") + spare)
        & (F.col("place_b") <= F.col("n_b") + spare)
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb"))


def seldom_columns(members: DataFrame, similar: int) -> DataFrame:
    """``members`` of open columns without the widest ones of each row.

    Similar rows share more columns than either leaves out here, so the narrowest one they share is left to both.
    """
    spare = _spare(similar, F.col("n"))
    widest = Window.partitionBy("node").orderBy(F.desc("width"), F.desc("ngram"))
    kept = members.withColumn("widest", F.row_number().over(widest)).filter(F.col("widest") > spare)
    return kept.select("ngram", "node", "n", "most", "place", "sketch", "root")


def counted_prefixes(docs: DataFrame, rows: DataFrame, size: int, similar: int) -> DataFrame:
    """``ngram, node, n, most, place, sketch, root`` of the prefixes of ``rows`` (``node, rep, n, sketch, root``) in the order
    of exact counts.

    N-grams of one row only come first in its order and are of no use to pairs, so the others alone are ranked. Rows
    with too few of those to be similar to anything are left out.
    """
    found = whole_rows(docs, rows.select("rep"), size, exploded=True)
    entries = cut_lineage(found.join(rows.select("node", "n", "root"), "node").distinct(), "ngram-wide")
    counts = entries.groupBy("ngram").agg(F.count("*").alias("width")).filter("width > 1")
    shared = entries.join(counts, "ngram")
    of_row = Window.partitionBy("node")
    placed = shared.withColumn("place", F.row_number().over(of_row.orderBy("width", "ngram"))).withColumn(
        "most", F.count("*").over(of_row)
    )
    least = _share(similar, F.col("n"))
    placed = placed.withColumn("place", F.col("n") - F.col("most") + F.col("place"))
    near = placed.filter((F.col("most") >= least) & (F.col("place") <= F.col("n") - least + 1))
    return near.select("ngram", "node", "n", "most", "place", "root").join(rows.select("node", "sketch"), "node")


def similar_pairs(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similar: int) -> DataFrame:
    """Those of ``pairs`` (``a, b`` and any others) whose whole rows overlap enough, as ``a, b``, written."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                kept.append(100 * both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))
        pa.default_memory_pool().release_unused()

    pairs = cut_lineage(pairs.select("a", "b"), "ngram-candidates")
    # sketches first: whole rows are fetched for the pairs that pass
    of_a, of_b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    sketched = pairs.join(of_a, "a").join(of_b, "b").filter(sketches_allow(similar, "sa", "sb", F.col("na") + F.col("nb")))
    pairs = cut_lineage(sketched.select("a", "b"), "ngram-sketched")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut_lineage(nodes.join(asked, "node", "left_semi").select("rep"), "ngram-wanted")
    rows = cut_lineage(whole_rows(docs, wanted, size), "ngram-rows")
    joined = pairs.join(rows.select(F.col("node").alias("a"), F.col("ngrams").alias("x")), "a").join(
        rows.select(F.col("node").alias("b"), F.col("ngrams").alias("y")), "b"
    )
    return cut_lineage(joined.select("a", "b", "x", "y").mapInArrow(overlaps, "a long, b long"), "ngram-links")


def near_duplicates(docs: DataFrame, size: int = WORDS, similar: int = SIMILAR, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text`` and any others, not read).

    ``component_id`` is the least id reachable by links of at least ``similar`` hundredths, the row's own included. Null
    and empty texts, and texts without words, have no n-grams and link with nothing. Rows of equal sets are one row of
    the matrix. Rows that share an id are one document: what one links with, all do. A null id is never least, and a set
    that only rows without an id have links with nothing. An empty table gives an empty result. Sets are told apart by 64-bit
    hashes, which errs once in some 6e9 distinct sets.
    """
    listed = frequent_ngrams(docs, size, similar, frequent)
    table = cut_lineage(prefixes(docs, size, similar, listed), "ngram-prefixes")
    filled = table.filter("n > 0")
    nodes = cut_lineage(filled.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "ngram-nodes")

    sizes = nodes.select("node", "n")
    entries = filled.select("node", F.explode("prefix").alias("ngram"))
    columns = entries.groupBy("ngram").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    shared = cut_lineage(entries.join(columns.select("ngram"), "ngram", "left_semi").distinct(), "ngram-shared")
    of_prefix = F.col("n") - _share(similar, F.col("n")) + 1 + F.floor(F.col("n") / LONGER)
    known = shared.groupBy("node").agg(F.count("*").alias("known")).join(sizes, "node")
    known = known.select(
        "node", "n",
        # what nobody's prefix has, others may still have beyond theirs; places in the order by hash are not used
        F.col("n").alias("most"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<long>").alias("sketch"),
        F.struct((1 - F.col("known") / of_prefix).alias("own"), "node").alias("rank"),
    )
    hits = cut_lineage(shared.join(known, "node"), "ngram-hits")
    order = F.row_number().over(Window.partitionBy("ngram").orderBy("rank"))
    leaders = hits.select("ngram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rank").alias("lead"), order.alias("order"))
    leaders = leaders.filter(F.col("order") <= LEADERS).drop("order")
    followers = hits.select("ngram", F.col("node").alias("b"), F.col("n").alias("nb"), "rank")
    # sizes are known here, so pairs that cannot be similar are not counted
    stars = followers.join(leaders, "ngram").filter(F.expr("lead < rank") & in_size(similar, "na", "nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    links = similar_pairs(docs, nodes, stars.filter(may_be_similar(similar)), size, similar)
    found = components(links)

    placed = hits.drop("rank").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    seldom = cut_lineage(open_columns(seldom_columns(open_columns(placed), similar)), "ngram-seldom")
    summed = meeting(seldom.filter(F.col("width") <= WIDE), similar).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    # a pair with a wide column among those left is taken up below; all others have them all counted here
    few = summed.filter(may_be_similar(similar, seldom=True)).select("a", "b")
    wide = seldom.filter(F.col("width") > WIDE).select("node", "n", "root").distinct()
    wide = cut_lineage(wide.join(nodes.select("node", "rep", "sketch"), "node"), "ngram-wide-rows")
    counted = cut_lineage(open_columns(counted_prefixes(docs, wide, size, similar)), "ngram-counted")
    pairs = few.unionByName(meeting(counted, similar).select("a", "b")).distinct()
    more = similar_pairs(docs, nodes, pairs, size, similar)
    shared_ids = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter(
        "doc_id IS NOT NULL AND a <> b"
    )
    same_id = filled.join(shared_ids.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    final = components(links.unionByName(more).unionByName(same_id))

    named = nodes.join(final, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "root").select("node", "component_id")
    alone = table.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = filled.join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(alone)


def of_checked_size(ids: DataFrame, most: int) -> DataFrame:
    """``ids``, to be broadcast if they were counted and are at most ``most``; else as Spark joins them."""
    ids = cut_lineage(ids, "checked-ids")
    return F.broadcast(ids) if ids.count() <= most else ids


def without_near_duplicates(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS, **options) -> DataFrame:
    """One document of each group, the one of least id, with the columns of ``docs``; rows without words all stay.

    Rows of one id are one document. Rows without an id stay if nothing with an id is like them. Up to ``broadcast_ids``
    ids to drop go to the texts, so that no text is shuffled; beyond that the texts are shuffled once.
    """
    found = cut_lineage(near_duplicates(docs.select("doc_id", "text"), **options), "ngram-components")
    dropped = found.filter("n_shingles > 0 AND doc_id <> component_id").select("doc_id").distinct()
    again = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = of_checked_size(again, broadcast_ids)
    kept = docs.join(of_checked_size(dropped, broadcast_ids), "doc_id", "left_anti")
    if not again.isEmpty():
        repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(repeated)
    return kept.select(*map(named, docs.columns))
