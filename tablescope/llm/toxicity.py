"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Two models, of toxic and of ordinary labelled documents, give each letter a likelihood after the letters before it in
its word. Orders above ``SHARED_ORDER`` have counts of their own class; their interpolation ends in continuation counts
shared by both classes, so an expression that neither class has seen enough of is judged alike by both and says
nothing. A word's evidence is the difference of its log-likelihoods. A document's are length-normalised: the mean over
all its words, over the most toxic window of words, and over its most toxic words. A logistic curve over these, fitted
on a fold of labelled documents that the counts leave out, is the score. Counts and curve are of all labelled documents;
Spark sums both, and only the counts of distinct n-grams and the sums of a Newton step reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablescope.llm.common import named, received, send
from tablescope.llm.ngram_join import STEP, _mixed, of_checked_size
from tablescope.sources.shared import cut_lineage

ORDER = 6
SHARED_ORDER = 2
#: Folds by ``crc32(id as text)``: 0 is held out, this one fits the curve, the others give the counts.
FOLDS, CURVE_FOLD = 5, 4
WINDOW = 4
TOP = 3
#: Words a task keeps the evidence or the counts of; workers are used again, so what one task holds weighs on later ones.
CACHE_WORDS = 60_000
#: Words whose n-grams are counted at once; Spark merges the counts inside the map tasks.
GRAM_WORDS = 10_000
#: Letters of text whose words are judged at once.
CHUNK = 1 << 18
#: So many labels, some 70 MB in memory, are broadcast at most.
BROADCAST_LABELS = 1_000_000

WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, curve`` of all labelled documents that are not held out.

    One row per id; an id with both labels counts as toxic. Rows without id or label are left out.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("fold", fold(F.col("doc_id")))
        .filter("fold <> 0")
    )
    return known.select("doc_id", "toxic", (F.col("fold") == CURVE_FOLD).alias("curve"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, toxic, ordinary``: how often each word is in documents of either class (``text, toxic``)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    seen[toxic.as_py()].update(WORD.findall(text.as_py().lower()))
            if len(seen[0]) + len(seen[1]) > CACHE_WORDS:
                yield packed(seen)
                seen = {0: Counter(), 1: Counter()}
        yield packed(seen)

    def packed(seen: dict[int, Counter]) -> pa.RecordBatch:
        words = list({**seen[0], **seen[1]})
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([seen[c][w] for w in words], pa.int64()) for c in (1, 0))],
            names=["word", "toxic", "ordinary"],
        )

    rows = docs.select("text", "toxic").mapInArrow(counted, "word string, toxic long, ordinary long")
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def ngram_counts(words: DataFrame, order: int) -> pa.Table:
    """``gram, toxic, ordinary``: the counts of every n-gram of letters up to ``order``, words between ``^`` and ``$``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, GRAM_WORDS) for b in batches for at in range(0, b.num_rows, GRAM_WORDS)):
            letters, line, place = _lines(batch.column(0).to_pylist())
            times = [c.to_numpy(zero_copy_only=False).astype(float)[line] for c in batch.columns[1:]]
            grams, sums = [], ([np.empty(0)], [np.empty(0)])
            keys = np.zeros(len(letters) + 1, np.uint64)  # of the n-grams that start at each letter
            for n in range(1, min(order, len(letters)) + 1):
                keys = _longer(keys[:-1], letters[n - 1 :])
                # within a line, and not its mark of the start alone
                starts = np.flatnonzero(place[n - 1 :] >= max(n - 1, 1))
                _, first, gram = np.unique(keys[starts], return_index=True, return_inverse=True)
                found = np.lib.stride_tricks.sliding_window_view(letters, n)[starts[first]]
                grams += np.ascontiguousarray(found).view(f"U{n}").ravel().tolist()
                for held, t in zip(sums, times):
                    held.append(np.bincount(gram, t[starts], len(first)))
            columns = [pa.array(grams, pa.string()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in sums)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "toxic", "ordinary"])

    rows = (
        words.select("word", "toxic", "ordinary")
        .mapInArrow(counted, "gram string, toxic long, ordinary long")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    return rows.toArrow()  # distinct n-grams, which grow far slower than the texts: 1.5 times in five times the labels


def _longer(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of n-grams that are longer by a letter; that of no letters is 0."""
    return _mixed((hashes + letters.astype(np.uint64) + np.uint64(1)) * STEP)


def _lines(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of ``words``, each between ``^`` and ``$``, the word each letter is in and its place there."""
    letters = np.frombuffer("".join(f"^{word}$" for word in words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    line = np.repeat(np.arange(len(words)), sizes)
    return letters, line, np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Sums:
    """Sums of the rows of ``values`` by key, 0 for other keys; sorted arrays, which take little more than the numbers.

    Keys are hashes, so the leading bits of one tell where the few are that it can be among.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        found, place = np.unique(keys, return_inverse=True)
        bits = max(1, len(found).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(found, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(found, ~np.uint64(0))  # no key is larger
        self.values = np.column_stack([np.bincount(place, v, len(self.keys)) for v in values.T])

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts[keys >> self.shift]
        before = np.flatnonzero(self.keys[at] < keys)
        while len(before):
            at[before] += 1
            before = before[self.keys[at[before]] < keys[before]]
        found = self.values[at]
        found[self.keys[at] != keys] = 0.0
        return found


class LetterModel:
    """Evidence of words: log-likelihood as toxic less log-likelihood as ordinary.

    ``counts`` are those of all n-grams, parts of others included, as ``{gram: (toxic, ordinary)}`` or as ``ngram_counts`` gives them. They are kept
    by 64-bit hashes.
    """

    def __init__(self, counts: dict[str, tuple[int, int]] | pa.Table, order: int = ORDER, shared: int = SHARED_ORDER):
        if isinstance(counts, dict):
            columns = [pa.array(list(counts), pa.string()), *(pa.array([p[c] for p in counts.values()], pa.int64()) for c in (0, 1))]
            counts = pa.table(columns, names=["gram", "toxic", "ordinary"])
        self.order, self.shared = order, shared
        pairs = np.column_stack([counts.column(c).to_numpy().astype(float) for c in ("toxic", "ordinary")])
        sizes = pc.utf8_length(counts.column("gram")).to_numpy()
        keys, contexts = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        tails, tail_contexts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for size in range(1, order + 1):
            at = np.flatnonzero(sizes == size)
            letters = np.array(counts.column("gram").take(pa.array(at)).to_pylist(), f"U{size}").view(np.uint32).reshape(-1, size)
            key, tail = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for i in range(size):
                context, tail_context = key, tail
                key = _longer(key, letters[:, i])
                tail = _longer(tail, letters[:, i]) if i else tail
            keys[at], contexts[at] = key, context
            if 1 < size <= shared + 1:
                tails.append(tail)
                tail_contexts.append(tail_context)
        self.uniform = 1.0 / (int((sizes == 1).sum()) + 2)
        long = sizes > shared
        self.counts = Sums(keys[long], pairs[long])
        # per class and context: the sum of the counts after it and how many letters follow it
        self.after = Sums(contexts[long], np.column_stack([pairs[long], pairs[long] > 0]))
        # for the shared orders: in how many contexts one letter longer a gram occurs, and the same per context
        tail, first, times = np.unique(np.concatenate(tails), return_index=True, return_counts=True)
        self.spread = Sums(tail, times[:, None])
        self.spread_after = Sums(np.concatenate(tail_contexts)[first], np.column_stack([times, np.ones(len(times))]))
        once, twice = int((pairs == 1).sum()), int((pairs == 2).sum())
        self.discount = min(0.9, max(0.5, once / (once + 2 * twice))) if once + twice else 0.75
        self.word: dict[str, float] = {}
        self.before: dict[str, float] = {}  # words that go unless they are met again

    def likelihoods(self, letters: np.ndarray, place: np.ndarray) -> np.ndarray:
        """As toxic and as ordinary, of each letter after the ones before it in its line, in which it has ``place``."""
        found = np.full((len(letters), 2), self.uniform)
        keys = np.zeros(len(letters) + 1, np.uint64)  # of the n-grams that start at each letter
        for size in range(1, min(self.order, len(letters)) + 1):
            contexts = keys[:-1]
            keys = _longer(contexts, letters[size - 1 :])
            if size <= self.shared + 1:
                starts = np.flatnonzero(place[size - 1 :] >= size - 1)
            else:  # what follows an n-gram was counted only if that was
                starts = starts[own.any(axis=1) & (starts < len(keys))]
                starts = starts[place[starts + size - 1] >= size - 1]
            if size <= self.shared:
                own = self.spread.of(keys[starts])
                total, kinds = np.hsplit(self.spread_after.of(contexts[starts]), 2)
            else:
                after = self.after.of(contexts[starts])
                seen = after[:, 2:].any(axis=1)  # the others stay as they are
                starts = starts[seen]
                total, kinds = np.hsplit(after[seen], 2)
                own = self.counts.of(keys[starts])
            lower = found[starts + size - 1]
            higher = (np.maximum(own - self.discount, 0.0) + self.discount * kinds * lower) / np.maximum(total, 1.0)
            found[starts + size - 1] = np.where(total > 0, higher, lower)
        return found

    def likelihood(self, gram: str, c: int) -> float:
        letters = np.array([gram]).view(np.uint32)
        return float(self.likelihoods(letters, np.arange(len(letters)))[-1, c])

    def learn(self, words: list[str]) -> None:
        """Sets the evidence of ``words`` in ``word``: the mean over their letters and the end."""
        letters, line, place = _lines(words)
        logs = np.log(self.likelihoods(letters, place))
        sums = np.bincount(line, np.where(place > 0, logs[:, 0] - logs[:, 1], 0.0), len(words))
        self.word.update(zip(words, (sums / (np.bincount(line, minlength=len(words)) - 1)).tolist()))

    def features(self, texts: Iterable[str | None]) -> Iterator[tuple[float, float, float]]:
        """Per text the mean evidence of its words, of its most toxic window and of its most toxic words; 0 without words."""
        held, size = [], 0
        for text in texts:
            held.append(WORD.findall(text.lower()) if text else [])
            size += len(text or "")
            if size >= CHUNK:
                yield from self._features(held)
                held, size = [], 0
        yield from self._features(held)

    def _features(self, texts: list[list[str]]) -> Iterator[tuple[float, float, float]]:
        if len(self.word) > CACHE_WORDS:
            self.before, self.word = self.word, {}
        new = set().union(*texts).difference(self.word)
        self.word.update({word: self.before[word] for word in new.intersection(self.before)})
        new = list(new.difference(self.before))
        if new:
            self.learn(new)
        for words in texts:
            if not words:
                yield 0.0, 0.0, 0.0
                continue
            values = np.fromiter(map(self.word.__getitem__, words), float, len(words))
            sums = np.cumsum(np.concatenate([[0.0], values]))
            width = min(WINDOW, len(words))
            window = (sums[width:] - sums[:-width]).max() / width
            top = np.partition(values, len(words) - min(TOP, len(words)))[-min(TOP, len(words)) :].mean()
            yield sums[-1] / len(words), window, top


FEATURES = ("mean", "window", "top")


def exact_sums(rows: DataFrame, values: list[Column]) -> np.ndarray:
    """Sums of ``values`` over ``rows``: decimals, so that they do not depend on the order of the rows."""
    sums = rows.agg(*[F.sum(v.cast("decimal(28,12)")).alias(f"s{i}") for i, v in enumerate(values)]).first()
    return np.array([float(v or 0) for v in sums])


def fit_logistic(
    points: DataFrame, count: int, ridge: float = 1e-2, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features of the ``count`` rows of ``points`` (``toxic`` and the features), and the weights
    (constant first) of a logistic curve. Each Newton step sums its gradient and second derivatives over all rows."""
    mean = exact_sums(points, [F.col(c) for c in FEATURES]) / count
    off = [F.col(c) - float(m) for c, m in zip(FEATURES, mean)]
    scale = np.sqrt(exact_sums(points, [o * o for o in off]) / count) + 1e-9
    z = [F.lit(1.0), *(o / float(s) for o, s in zip(off, scale))]
    places = [(i, j) for i in range(len(z)) for j in range(i + 1)]
    w = np.zeros(len(z))
    for _ in range(rounds):
        line = sum((float(v) * x for v, x in zip(w[1:], z[1:])), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
        held = points.select("toxic", p.alias("p"), *(x.alias(f"z{i}") for i, x in enumerate(z)))
        p, at = F.col("p"), [F.col(f"z{i}") for i in range(len(z))]
        sums = exact_sums(held, [*((p - F.col("toxic")) * x for x in at), *(p * (1 - p) * at[i] * at[j] for i, j in places)])
        curved = ridge * np.eye(len(z))
        for (i, j), v in zip(places, sums[len(z) :]):
            curved[i, j] += v
            curved[j, i] += v if i != j else 0.0
        step = np.linalg.solve(curved, sums[: len(z)] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def features_of(rows: DataFrame, model, with_text: bool = False) -> DataFrame:
    """``doc, mean, window, top`` of ``rows`` (``doc, text``), and the text itself where asked for."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = received(model)
        for batch in batches:
            found = np.array(list(letters.features(t.as_py() for t in batch.column(1))), float).reshape(-1, 3).T
            columns = [*batch.columns[: 1 + with_text], *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *FEATURES])
        letters.word.clear()
        letters.before.clear()
        pa.default_memory_pool().release_unused()

    names = ["doc", "text"][: 1 + with_text]
    schema = StructType([rows.schema[n] for n in names])
    for name in FEATURES:
        schema = schema.add(name, "double")
    return rows.select("doc", "text").mapInArrow(measured, schema)


def learnt_from(docs: DataFrame, labels: DataFrame, broadcast_labels: int) -> tuple[DataFrame, DataFrame]:
    """``text, toxic`` of the labelled documents that give the counts, and of those that fit the curve.

    Up to ``broadcast_labels`` labels go to the texts, so that no text is shuffled; beyond that each text of the folds
    that are learnt from is shuffled once, with those of its own part.
    """
    chosen = of_checked_size(labelled(labels), broadcast_labels)
    # ids of one type that are equal have one fold
    same = docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType
    parts = []
    for of_part, folds in (("NOT curve", [f for f in range(1, FOLDS) if f != CURVE_FOLD]), ("curve", [CURVE_FOLD])):
        texts = docs.select("doc_id", "text")
        texts = texts.filter(fold(F.col("doc_id")).isin(folds)) if same else texts
        parts.append(texts.join(chosen.filter(of_part), "doc_id").select("text", "toxic"))
    return parts[0], parts[1]


def scored(docs: DataFrame, labels: DataFrame, with_text: bool = True, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``doc, score`` for every row of ``docs`` (``doc_id, text`` and any others), and ``text`` unless it is not wanted.

    ``doc`` holds the row's columns but for the text, under any names. The models learn from all ``labels`` (``doc_id,
    toxic``) whose fold is not 0. Null and empty texts, and texts without letters, get
    the score of no evidence. Without labelled documents, or with one class of them only, every score is the share of
    toxic ones (0.0 without any). Rows without an id are scored and not learnt from. Equal texts score alike. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    known, curve = learnt_from(docs, labels, broadcast_labels)
    counts = ngram_counts(word_counts(known), ORDER)
    shared = send(spark, LetterModel(counts))
    curve = curve.select(F.struct("toxic").alias("doc"), "text")
    # written: each step of the fit reads these four numbers per document of the fold
    fit = cut_lineage(features_of(curve, shared).select("doc.toxic", *FEATURES), "toxicity-curve")
    count, toxic = fit.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows = docs.select(F.struct(*(named(c) for c in docs.columns if c != "text")).alias("doc"), "text")
    found = features_of(rows, shared, with_text)
    carried = ["doc", "text"][: 1 + with_text]
    if not 0 < toxic < count:
        return found.select(*carried, F.lit(toxic / count if count else 0.0).alias("score"))
    mean, scale, weights = fit_logistic(fit, count)
    line = F.lit(float(weights[0]))
    for name, m, s, w in zip(FEATURES, mean, scale, weights[1:]):
        line = line + (F.col(name) - float(m)) / float(s) * float(w)
    return found.select(*carried, (1 / (1 + F.exp(-line))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``predicted`` is 1 from a score of 0.5 on."""
    return scored(docs.select("doc_id", "text"), labels, with_text=False, **options).select(
        "doc.doc_id",
        F.coalesce(fold(F.col("doc.doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    kept = scored(docs, labels, **options).filter("score < 0.5")
    return kept.select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
