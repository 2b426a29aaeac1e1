"""Interaction audit of five filters: how much each removes, alone and behind the others, in every order.

All files of a table are worked off as available-now micro-batches. Four filters look at one text; the fifth fails
documents whose text a smaller id has, anywhere in the table. State keyed by text holds the least id seen so far, and what
its documents failed. A document emits ``+1`` for its part and mask of failures; when a smaller id arrives for its text,
its earlier mask is retracted (``-1``) and counted again with the fifth failure. A sink adds these changes up by batch,
and the sum of all is the table's histogram of masks. The 120 orders follow from that histogram alone.

Before rows are keyed by text, each task combines its own: of many copies of one text it passes on the ones of least id and
counts of all others, which have failed already, under keys that spread.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablescope.sources.shared import cut_lineage, scratch_path
from tablescope.streaming.streams import read_stream, run_available, with_rocksdb

FILTERS = "ABCDE"
#: Bit of each filter in a mask.
FEW_WORDS, FEW_DISTINCT, CAPITALS, SIGNS, REPEATED = (1 << i for i in range(len(FILTERS)))

LEAST_WORDS = 50
#: Hundredths of the words that must be distinct, and of the code points that may be A to Z.
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGN_BYTES = [bytes([c]) for c in b"#$%&*|"]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: The table is worked off in about this many micro-batches.
BATCHES = 4
#: Texts whose digests share one state, about.
TEXTS = 256
#: Rows, without their texts, that a task combines at once.
COMBINED = 200_000
#: Texts read from a batch at once, and the size from which words are not listed.
STEP, LONG_TEXT = 200, 1 << 22
#: Odd multiplier that spreads the keys of rows that no state concerns (a fixed value of no meaning).
SPREAD = np.uint64(0x9E3779B97F4A7C15)

CHANGE = "part string, mask int, good boolean, toxic boolean, n long"


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; those of very long texts are not held in a list."""
    if len(text) < LONG_TEXT:
        words = text.split()  # splits bytes at the space and U+0009 to U+000D only
        return len(words), len(set(words))
    count, seen = 0, set()
    for found in WORD.finditer(text):
        count += 1
        seen.add(found.group())
    return count, len(seen)


def own_mask(text: bytes, code_points: int) -> int:
    """The filters that a text fails by itself."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, UPPER))
    return (
        FEW_WORDS * (words < LEAST_WORDS)
        | FEW_DISTINCT * (100 * distinct < LEAST_DISTINCT * words)
        | CAPITALS * (100 * capitals > MOST_CAPITALS * code_points)
        | SIGNS * any(sign in text for sign in SIGN_BYTES)
    )


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, x, y`` of ``docs`` (``doc_id, source, text``): the digest ``x, y`` stands for the text from here on."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for at in range(0, batch.num_rows, STEP):
                texts = batch.column(2).slice(at, STEP)
                for text, code_points in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist()):
                    masks.append(own_mask(text, code_points))
                    digests.append(xxhash.xxh3_128_digest(text))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                ["doc_id", "part", "mask", "x", "y"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(judge, "doc_id long, part string, mask int, x long, y long")


def combined(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, part, mask, x, y, good, toxic``) counted as ``n`` within each task.

    Of each text seen, those of the least id stay by themselves. The others, and rows without an id, need no state
    (``settled``): their masks are final, so they are counted by part and mask.
    """
    of_part = ["part", "mask", "good", "toxic"]
    names = ["x", "y", "doc_id", *of_part, "n", "settled"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many >= COMBINED:
                yield from counted(pa.Table.from_batches(held))
                held, many = [], 0
        if many:
            yield from counted(pa.Table.from_batches(held))

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nameless = table.filter(pc.is_null(table["doc_id"]))
        table = table.filter(pc.is_valid(table["doc_id"]))
        least = table.group_by(["x", "y"]).aggregate([("doc_id", "min")])
        table = table.join(least, ["x", "y"])
        first = pc.equal(table["doc_id"], table["doc_id_min"])
        open_rows = table.filter(first).group_by(["x", "y", "doc_id", *of_part]).aggregate([([], "count_all")])
        open_rows = open_rows.rename_columns([n if n != "count_all" else "n" for n in open_rows.column_names])
        yield from open_rows.append_column("settled", pa.array(np.zeros(len(open_rows), bool))).select(names).to_batches()
        later = table.filter(pc.invert(first))
        later = later.set_column(later.column_names.index("mask"), "mask", pc.bit_wise_or(later["mask"], pa.scalar(REPEATED, pa.int32())))
        for rest, key in ((later, "doc_id"), (nameless, "x")):
            done = rest.group_by(of_part).aggregate([(key, "min"), ([], "count_all")])
            # any key will do; these spread and are the same when the task is run again
            spread = (done[f"{key}_min"].to_numpy().astype(np.int64).view(np.uint64) * SPREAD).view(np.int64)
            columns = {
                "x": pa.array(spread), "y": pa.array(np.zeros(len(done), np.int64)), "doc_id": pa.nulls(len(done), pa.int64()),
                **{c: done[c] for c in of_part}, "n": done["count_all"], "settled": pa.array(np.ones(len(done), bool)),
            }
            yield from pa.table(columns).select(names).to_batches()

    return rows.select("doc_id", "x", "y", *of_part).mapInArrow(
        combine, "x long, y long, doc_id long, part string, mask int, good boolean, toxic boolean, n long, settled boolean"
    )


class LeastId(StatefulProcessor):
    """Per text the least id and its documents by part; emits changes to the counters of parts and masks.

    The texts of a bucket of digests share one state, a handful that is read and written at once.
    """

    FIELDS = ("x", "y", "doc_id", "part", "mask", "good", "toxic", "n")

    def __init__(self, repeated: int):
        self.repeated = repeated

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ("long", "long", "long", "string", "int", "boolean", "boolean", "long")
        self.least = handle.getValueState("least", ", ".join(f"{f} array<{k}>" for f, k in zip(self.FIELDS, kinds)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        news: dict[tuple, list[Row]] = {}
        for r in rows:
            if r.settled:
                yield self.change(r, r.n)
            else:
                news.setdefault((r.x, r.y), []).append(r)
        if not news:
            return
        stored = self.least.get()  # none yet for a new bucket
        held: dict[tuple, list[Row]] = {}
        for values in zip(*stored) if stored is not None else ():
            kept = Row(*self.FIELDS)(*values)
            held.setdefault((kept.x, kept.y), []).append(kept)
        changed = False
        for text, found in news.items():
            before = held.get(text, [])
            low = min(r.doc_id for r in found)
            if before and before[0].doc_id > low:
                for r in before:
                    yield self.change(r, -r.n)
                    yield self.change(r, r.n, self.repeated)
                before = []
            elif before:
                low = before[0].doc_id
            least = [r for r in found if r.doc_id == low]
            for r in found:
                yield self.change(r, r.n, 0 if r.doc_id == low else self.repeated)
            if least:
                changed = True
                held[text] = self.by_part([*before, *least])
        if changed:
            self.least.update(tuple([r[f] for of_text in held.values() for r in of_text] for f in self.FIELDS))

    @staticmethod
    def change(r: Row, n: int, more: int = 0) -> Row:
        return Row(part=r.part, mask=r.mask | more, good=r.good, toxic=r.toxic, n=n)

    @classmethod
    def by_part(cls, rows: list[Row]) -> list[Row]:
        """Rows of one text and id, one per part."""
        counts: dict[str, int] = {}
        for r in rows:
            counts[r.part] = counts.get(r.part, 0) + r.n
        r = rows[0]
        return [Row(*cls.FIELDS)(r.x, r.y, r.doc_id, part, r.mask, r.good, r.toxic, n) for part, n in counts.items()]

    def close(self) -> None:
        pass


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``part, mask, n, good, toxic`` of the table at ``path``, streamed in about ``batches`` micro-batches."""
    with_rocksdb(spark)
    table = spark.read.parquet(path)
    buckets = max(1, table.count() // TEXTS)  # the files' own row counts
    of_doc = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    of_doc = cut_lineage(of_doc.filter("good OR toxic"), "audit-labels")  # read again by every micro-batch
    files = max(1, math.ceil(len(table.inputFiles()) / batches))
    # a pattern that only ``path`` matches: streams take a single file by a pattern only
    stream = read_stream(spark, f"{path[:-1]}[{path[-1]}]", table.schema, files_per_batch=files)
    rows = judged(stream.select("doc_id", "source", "text")).join(of_doc, "doc_id", "left").fillna(False, ["good", "toxic"])
    keyed = combined(rows).withColumn("bucket", F.pmod("x", F.lit(buckets)))
    changes = keyed.groupBy("bucket").transformWithState(
        statefulProcessor=LeastId(REPEATED), outputStructType=CHANGE, outputMode="Update", timeMode="None"
    )
    target = scratch_path(spark, "audit")
    keys = ["part", "mask", "good", "toxic"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        """One small table per micro-batch; a batch that is run again overwrites its own."""
        batch.groupBy(*keys).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{target}/changes/batch={batch_id}")

    # a table without files has no micro-batch
    spark.createDataFrame([], CHANGE).write.parquet(f"{target}/changes/batch=-1")
    run_available(changes, sink, "update", target)
    summed = spark.read.schema(f"{CHANGE}, batch long").parquet(f"{target}/changes").groupBy(*keys).agg(F.sum("n").alias("n"))
    counted = summed.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
    )
    return counted.filter("n > 0")


def orders_of(counts: DataFrame) -> DataFrame:
    """Every part, order and step from ``counts`` (``part, mask, n, good, toxic``); at most 32 masks a part.

    What a step does depends on its filter and the set of filters before it only, so 80 cases serve all 600 steps.
    """
    cases: dict[tuple[int, int], list[str]] = {}
    for order in itertools.permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before = sum(1 << b for b in order[:step])
            cases.setdefault((before, f), []).append("".join(FILTERS[i] for i in order))
    listed = F.array(*(
        F.struct(
            F.lit(before).alias("before"), F.lit(1 << f).alias("bit"), F.lit(before.bit_count() + 1).alias("step"),
            F.array(*map(F.lit, orders)).alias("orders"),
        )
        for (before, f), orders in cases.items()
    ))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(listed))

    def total(what: str, among) -> Column:
        return F.aggregate(F.filter("masks", lambda m: among(m["mask"])), F.lit(0).cast("long"), lambda s, m: s + m[what])

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("bit")) != 0

    def earlier(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("before")) != 0

    every = math.factorial(len(FILTERS))
    share = F.aggregate(
        F.filter("masks", lambda m: fails(m["mask"])), F.lit(0).cast("long"),
        # the filter comes first among those failed in as many orders as any other of them
        lambda s, m: s + m["n"] * (F.lit(every) / F.bit_count(m["mask"])).cast("long"),
    )
    here = (lambda mask: fails(mask) & ~earlier(mask))
    return rows.select(
        "part", F.explode("orders").alias("filter_order"), "step",
        total("n", lambda mask: ~fails(mask) & ~earlier(mask)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda mask: fails(mask) & earlier(mask)).alias("redundant"),
        total("n", lambda mask: mask == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per part, order of the five filters and step, for the table of documents at ``path`` (``doc_id, source, text``
    and any others, not read) and ``labels`` (``doc_id, quality, toxic``).

    Null source is the part of the empty string, null text the empty text. Rows of one id do not repeat each other; a row
    without an id never fails as repeated, makes no other fail, and has no labels. An id with several labels is good, or toxic, if one of
    them says so. A table without rows has no parts and gives no rows. Texts are told apart by 128-bit digests.
    """
    return orders_of(mask_counts(spark, path, labels, batches))
