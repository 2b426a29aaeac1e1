"""Mixing sources to target weights by hash thresholds.

Every document gets a 64-bit hash of its id and text. A source that shall give ``f + r`` times its words, ``f`` whole
and ``r`` a fraction, takes each document ``f`` times and those under a hash threshold once more. The threshold comes
from nested histograms: words by source and leading hash bits, then the same for the next bits of the one bucket the
budget ends in, until that bucket is a single hash. Rows are never sorted; a source of any size adds one histogram row
per bucket and task to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import named, text_or_empty, words
from tablescope.sources.shared import cut_lineage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Leading hash bits told apart by each level of histograms; together all 64.
LEVELS = (12, 20, 32)


def _key(source: Column) -> Column:
    """A join key that tells null from every name."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source))


def _bucket(level: int) -> Column:
    """The bits of ``h`` the level looks at; the leading bits keep their sign, so buckets rise with ``h``."""
    below = 64 - sum(LEVELS[: level + 1])
    high = F.shiftright("h", below)
    return high if level == 0 else high.bitwiseAND(F.lit((1 << LEVELS[level]) - 1).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words each source shall give: ``share`` of all words by weight, at most ``most`` times a source's own.

    ``sizes`` has one row per source (``key, source, source_size``). What a source at its limit leaves is shared by the
    others by weight, again and again; that ends where every source gives ``min(limit, weight * level)`` for one common
    level. With sources in order of ``limit / weight`` the level is the largest of the ratios of what is left to share
    to the weights left. The windows here run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.array(*map(F.lit, weights))[(F.col("rank") - 1) % len(weights)].cast("double")
    )
    limit = F.col("source_size") * F.lit(most)
    filling = Window.orderBy(limit / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    full = F.sum("source_size").over(whole) * F.lit(share)
    used = F.coalesce(F.sum(limit).over(filling), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    levels = ranked.withColumn("level", (full - used) / weight_left)
    return levels.withColumn("target", F.least(limit, F.col("weight") * F.max("level").over(whole)).cast("double")).drop(
        "rank", "level", "weight"
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: ``source_size``, ``target``, whole ``copies`` and the highest hash that is taken once more.

    ``sized`` has ``key, source, size, h``. ``last`` is null where no document is taken once more. The document (or the
    documents of one hash) the budget ends in is taken if that comes nearer to the target.
    """
    per_source = sized.groupBy("key").agg(
        F.min("source").alias("source"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")
    )
    goal = targets(per_source, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = cut_lineage(
        goal.withColumn("copies", copies.cast("int"))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("before", F.lit(0).cast("long"))
        .withColumn("end", F.lit(0).cast("long")),
        "mix-targets",
    )
    rows = sized.select("key", "size", "h")
    by_source = Window.partitionBy("key").orderBy("bucket")
    for level, bits in enumerate(LEVELS):
        hist = rows.groupBy("key", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        summed = hist.withColumn("upto", F.sum("words").over(by_source))
        over = (
            summed.join(state.select("key", "budget", F.col("before").alias("base")), "key")
            .filter(F.col("base") + F.col("upto") > F.col("budget"))
            .groupBy("key")
            .agg(F.min(F.struct("bucket", "words", (F.col("base") + F.col("upto")).alias("through"))).alias("at"))
        )
        state = cut_lineage(
            state.join(over, "key", "left").select(
                "key",
                "source",
                "source_size",
                "target",
                "copies",
                "budget",
                F.coalesce(F.col("at.through") - F.col("at.words"), "before").alias("before"),
                (F.shiftleft(F.col("end"), bits) + F.coalesce(F.col("at.bucket"), F.lit(0))).alias("end"),
                F.col("at.through").alias("through"),
                F.col("at.bucket").isNull().alias("all"),
            ),
            "mix-level",
        )
        bucket = _bucket(level)
        rows = (
            rows.withColumn("bucket", bucket)
            .join(over.select("key", F.col("at.bucket").alias("bucket")), ["key", "bucket"], "left_semi")
            .drop("bucket")
        )
    nearer = F.col("through") - F.col("budget") < F.col("budget") - F.col("before")
    last = (
        F.when(F.col("budget") <= 0, None)
        .when(F.col("all"), F.lit((1 << 63) - 1))
        .when(nearer, F.col("end"))
        .when(F.col("end") > F.lit(-(1 << 63)), F.col("end") - 1)
    )
    return state.select("key", "source_size", "target", "copies", last.cast("long").alias("last"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``docs`` (``doc_id, text, source`` and any others) as ``doc, size, source_size, target, times``.

    ``doc`` holds the whole input row; ``times`` is how often the mix takes it (0 to ``most``). Size is the number of
    words. Null and empty texts have size 0 and are taken as often as their hash says; a null source is one source,
    after all names. Equal rows have equal hashes and are taken alike. An empty table gives an empty result. Columns of
    any name are kept apart inside ``doc``.
    """
    text = text_or_empty()
    rows = docs.select(
        F.struct(*map(named, docs.columns)).alias("doc"),
        _key(F.col("source")).alias("key"),
        F.size(words(text)).cast("long").alias("size"),
        F.xxhash64("doc_id", text).alias("h"),
    )
    sized = cut_lineage(
        docs.select(
            _key(F.col("source")).alias("key"), "source", F.size(words(text)).cast("long").alias("size"),
            F.xxhash64("doc_id", text).alias("h"),
        ),
        "mix-sizes",
    )
    ends = cut_lineage(thresholds(sized, weights, share, most), "mix-ends")
    again = F.coalesce((F.col("h") <= F.col("last")).cast("int"), F.lit(0))
    return rows.join(ends, "key").select(
        "doc", "size", "source_size", "target", (F.col("copies") + again).alias("times")
    )


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: its id, size, its source's size and target, and the words the mix takes of it."""
    return mix(docs.select("doc_id", "text", "source"), **options).select(
        F.col("doc.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
        "times",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, **options).filter(F.col("times") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
