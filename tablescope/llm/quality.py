"""Quality rules whose cutoffs are chosen under a bound on false rejections.

A rule rejects a document if a share, such as that of symbols among its characters, is above a cutoff. Good documents
of the labelled holdout tell how often a cutoff errs. With ``k`` errors among ``n`` good documents, a cutoff is certified
for a rate if an exact binomial test rejects that its true rate is higher: ``P(X <= k | n, rate) <= level``, which is the
Clopper-Pearson upper bound being at most the rate. The rate per stratum is divided by the number of rules, so that all
rules together stay below it; the level is divided by the number of rules and strata (Bonferroni). Cutoffs of one rule
are nested and tested from the loosest on until one fails, which needs no further correction. So with the stated
confidence no stratum loses more than the stated share of its good documents to all rules. Among its certified cutoffs
a rule uses the one that gains most: junk caught, less a multiple of good documents lost. Without a certified cutoff
(too few labels, say) a rule rejects nothing in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import SPACE_CLASS, WORD_CLASS, let, text_or_empty, words
from tablescope.sources.shared import cut_lineage

SYMBOLS = r"#*$%&|<>"
#: Share of a stratum's good documents that all rules together may reject, and the risk that they reject more.
FALSE_REJECTION, RISK = 0.05, 0.05
#: Cutoffs of every rule, from the loosest; fixed beforehand, as cutoffs taken from the holdout would need a correction.
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.075, 0.05, 0.04, 0.03, 0.02, 0.01)
#: Lost good documents weigh so many times as much as caught junk.
LOSS = 10.0
RULES = ("symbols", "repeats", "dup_lines", "shouting")
LEAST_WORDS = 50


def _repeat_words(found: Column) -> Column:
    """Words of an array that lie in a three-word window occurring twice or more."""

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(ordered: Column) -> Column:
            twice = F.filter(
                ordered,
                lambda s, j: (F.get(ordered, j - 1)["h"].eqNullSafe(s["h"]))
                | (F.get(ordered, j + 1)["h"].eqNullSafe(s["h"])),
            )
            return F.sort_array(F.transform(twice, lambda s: s["i"]))

        def total(at: Column) -> Column:
            widths = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), p + 3) - p))
            return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

        some = let(let(marked, positions), total)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(windows(found), covered)


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of ``docs`` (``doc_id, text`` and the stratum's column): counts, shares of the rules, ``base_failed``.

    Null and empty texts have zero of everything and fail the base rule. Windows of words are compared by 64-bit hashes.
    """
    text = text_or_empty()
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CLASS))
    counted = (
        docs.select("doc_id", F.col(stratum).alias("stratum"), text.alias("t"))
        .select(
            "doc_id",
            "stratum",
            let(words(F.col("t")), lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            )).alias("of_words"),
            F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace("t", "[^A-Z!]+", "")).cast("long").alias("n_loud"),
            let(lines, lambda x: F.struct(
                F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
            )).alias("of_lines"),
        )
        .select("doc_id", "stratum", "of_words.*", "n_symbols", "n_loud", "of_lines.*")
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return counted.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_loud", "word_chars").alias("shouting"),
    )


def _log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps up, good to some 1e-10 for x >= 1."""
    y = x + 8
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """``P(X <= k)`` of a binomial count, for ``k <= n * rate``.

    Terms are summed from the ``k``-th down. Their ratios fall, so what lies beyond the last one summed is bounded by a
    geometric series, which is added; the result errs upwards only.
    """
    n, k = n.cast("double"), k.cast("double")
    first = (
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    )
    terms = F.least(k, F.ceil(12 * F.sqrt(n)) + 50).cast("long")
    odds = (1 - rate) / rate

    def ratio(i: Column) -> Column:
        return i / (n - i + 1) * F.lit(odds)

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] * ratio(k - j + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    rest_ratio = ratio(k - terms)
    total = F.aggregate(
        steps, start, add, lambda s: s["sum"] + s["term"] * F.when(rest_ratio < 1, rest_ratio / (1 - rest_ratio)).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.exp(first) * total)


def certified_cutoffs(
    measured: DataFrame, labels: DataFrame, rate: float = FALSE_REJECTION, risk: float = RISK, loss: float = LOSS
) -> DataFrame:
    """``stratum`` and one column per rule: its cutoff there, null where the rule rejects nothing.

    ``measured`` comes from ``metrics``; ``labels`` has ``doc_id, quality`` (1 good, 0 junk; others and nulls are not
    used; an id with both is good). All labelled documents are used, as counts by stratum, rule, cutoff and label.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    stacked = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in RULES)))
    # the number of nested cutoffs below a share says all about it, so counts merge inside the map tasks
    passed = F.aggregate(
        F.array(*map(F.lit, CUTOFFS)), F.lit(0), lambda a, c: a + F.when(F.col("share") > c, 1).otherwise(0)
    )
    counts = (
        measured.filter("NOT base_failed")
        .join(known, "doc_id")
        .select("stratum", "quality", stacked.alias("s"))
        .select("stratum", "quality", "s.*")
        .groupBy("stratum", "rule", "quality", passed.alias("above"))
        .agg(F.count("*").alias("times"))
    )
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("cutoff")) for i, c in enumerate(CUTOFFS))))
    first = len(CUTOFFS)

    def total(quality: int, over: Column = F.lit(True)) -> Column:
        return F.coalesce(F.sum(F.when((F.col("quality") == quality) & over, F.col("times"))), F.lit(0))

    # a share above ``above`` cutoffs counted from the loosest would be above the tightest first
    rejected = F.col("above") >= F.lit(first) - F.col("g.place")
    tested = (
        counts.select("*", grid.alias("g"))
        .groupBy("stratum", "rule", F.col("g.cutoff").alias("cutoff"))
        .agg(
            total(1).alias("good"), total(0).alias("junk"), total(1, rejected).alias("lost"), total(0, rejected).alias("caught")
        )
    )
    tested = cut_lineage(tested, "quality-tests")
    strata = F.greatest(F.lit(1), tested.select(F.struct("stratum")).distinct().agg(F.count("*")).scalar())
    per_rule = rate / len(RULES)
    # lost documents grow as the cutoff falls, so the cutoffs that pass are the loosest ones, as in testing one by one
    passes = (F.col("lost") <= F.col("good") * per_rule) & (
        binomial_at_most(F.least(F.col("lost"), F.col("good")), F.col("good"), per_rule) <= risk / (len(RULES) * strata)
    )
    gain = F.coalesce(F.try_divide(F.col("caught"), F.col("junk")), F.lit(0.0)) - loss * F.col("lost") / F.col("good")
    best = F.max_by("cutoff", F.struct(gain.alias("gain"), "cutoff"))
    chosen = tested.filter(passes & (F.col("caught") > 0) & (F.col("good") > 0)).filter(gain > 0)
    return chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(best)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    ``kept`` is false if the base rule fails or a share is above its stratum's cutoff. A null stratum is one of its own.
    Repeated rows are judged alike; rows without an id are judged but not used as holdout; an empty table gives an
    empty result; other columns are not read.
    """
    measured = cut_lineage(metrics(docs, stratum), "quality-metrics")
    cutoffs = cut_lineage(certified_cutoffs(measured, labels, **options), "quality-cutoffs")
    named = cutoffs.select(F.col("stratum").alias("of"), *(F.col(r).alias(f"{r}_cutoff") for r in RULES))
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False))
    return measured.join(named, F.col("stratum").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~over).alias("kept"),
    )
