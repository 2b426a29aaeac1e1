"""Language of a text by a bidirectional gated recurrent network over its bytes.

A text is read in windows of bytes. In each, one recurrence runs from the left and one from the right; at every position the
two states together give a probability per language, and a document's is the mean over all its positions. The network is trained in
numpy by backpropagation through time, on the label of every position, from a bounded sample of labelled documents.

Arrays are laid out as ``(features, windows)``: one time step of many windows is one small matrix product. A position behind
a text's end holds a symbol that leaves the state as it is, so windows of any length go together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.ordered import top_per_key

#: Bytes of a window, units of each direction's state, windows handled at once.
WINDOW, UNITS, BLOCK = 128, 12, 1024
#: The symbol behind a text's end.
PAD = 256
#: Labelled documents per language, and windows of each, that the network learns from at most.
SAMPLE, WINDOWS = 200, 8
#: Passes over the sample, windows per step, and the first step size.
EPOCHS, MINIBATCH, RATE = 4, 64, 0.02
#: Of this many parts of the ids, the one numbered 1 is held out.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Texts are read from a batch so many at once, and a text's bytes in pieces of so many windows.
STEP, PIECE = 500, 1 << 14


def new_network(languages: int, units: int = UNITS, seed: int = 7, kind=np.float32) -> dict[str, np.ndarray]:
    """Weights of both directions (``Ef Uf Eb Ub``) and of the output (``Wf Wb c``).

    ``E`` holds what each symbol adds to the gates: rows ``z`` (keep), ``r`` (reset) and the new state. The gates are
    ``(tanh + 1) / 2``. The last symbol keeps all.
    """
    pick = np.random.default_rng(seed)
    net = {}
    for side in "fb":
        net["E" + side] = pick.normal(0, 0.3, (3 * units, PAD + 1))
        net["E" + side][:, PAD] = np.repeat([40.0, 0.0, 0.0], units)
        net["U" + side] = pick.normal(0, units**-0.5, (3 * units, units))
        net["W" + side] = pick.normal(0, units**-0.5, (languages, units))
    net["c"] = np.zeros((languages, 1))
    return {name: value.astype(kind) for name, value in net.items()}


def states(symbols: np.ndarray, E: np.ndarray, U: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """The states after each of ``symbols`` (``time, windows``); with ``keep`` also what their gradient needs."""
    steps, many = symbols.shape
    units = U.shape[1]
    out = np.empty((steps, units, many), E.dtype)
    held = []
    g, u = np.empty((3 * units, many), E.dtype), np.empty((3 * units, many), E.dtype)
    before = np.zeros((units, many), E.dtype)
    for t in range(steps):
        np.take(E, symbols[t], axis=1, out=g, mode="clip")
        np.matmul(U, before, out=u)
        gates, new, from_state = g[: 2 * units], g[2 * units :], u[2 * units :]
        gates += u[: 2 * units]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        if keep:
            raw = from_state.copy()
        from_state *= gates[units:]
        new += from_state
        np.tanh(new, out=new)
        if keep:
            held.append((gates.copy(), new.copy(), raw, before))
        state = out[t]
        np.subtract(before, new, out=state)
        state *= gates[:units]
        state += new
        before = state
    return out, held


def position_probabilities(net: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """``time, languages, windows``: the probability of each language at each position."""
    left, _ = states(symbols, net["Ef"], net["Uf"])
    right, _ = states(symbols[::-1], net["Eb"], net["Ub"])
    logits = net["Wf"] @ left + net["Wb"] @ right[::-1] + net["c"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradient(net: dict[str, np.ndarray], symbols: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the label at every position of its window, and its gradient through time."""
    units = net["Uf"].shape[1]
    sides = {"f": symbols, "b": symbols[::-1]}
    found = {side: states(rows, net["E" + side], net["U" + side], keep=True) for side, rows in sides.items()}
    left, right = found["f"][0], found["b"][0][::-1]
    logits = net["Wf"] @ left + net["Wb"] @ right + net["c"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    real = (symbols != PAD)[:, None, :]
    count = real.sum()
    at = np.arange(symbols.shape[1])
    loss = float(-(np.log(p[:, labels, at] + 1e-30) * real[:, 0]).sum() / count)
    p[:, labels, at] -= 1
    p *= real
    p /= count
    out = {"c": p.sum(axis=(0, 2))[:, None]}
    for side, h in (("f", left), ("b", right)):
        out["W" + side] = np.einsum("tkb,thb->kh", p, h)
        errors = np.matmul(net["W" + side].T, p)
        if side == "b":
            errors = errors[::-1]
        U, held = net["U" + side], found[side][1]
        into = np.empty((len(held), 3 * units, symbols.shape[1]), p.dtype)
        dU = np.zeros_like(U)
        after = np.zeros_like(h[0])
        for t in range(len(held) - 1, -1, -1):
            gates, new, raw, before = held[t]
            z, r = gates[:units], gates[units:]
            dh = errors[t] + after
            d_new = dh * (1 - z) * (1 - new * new)
            step = into[t]
            # the derivative of (tanh(a) + 1) / 2 is 2 s (1 - s)
            step[:units] = dh * (before - new) * 2 * z * (1 - z)
            step[units : 2 * units] = d_new * raw * 2 * r * (1 - r)
            step[2 * units :] = d_new
            to_state = np.concatenate([step[: 2 * units], d_new * r])
            dU += to_state @ before.T
            after = dh * z + U.T @ to_state
        flat = sides[side].ravel()
        dE = np.stack([np.bincount(flat, into[:, k].ravel(), PAD + 1) for k in range(3 * units)]).astype(U.dtype)
        dE[:, PAD] = 0
        out["U" + side], out["E" + side] = dU, dE
    return loss, out


def trained(
    symbols: np.ndarray, labels: np.ndarray, languages: int, units: int = UNITS, epochs: int = EPOCHS, rate: float = RATE
) -> dict[str, np.ndarray]:
    """A network trained on windows (``windows, time``) and the number of each one's language, by Adam; the same for the same input."""
    net = new_network(languages, units)
    pick = np.random.default_rng(11)
    mean, square = ({n: np.zeros_like(v) for n, v in net.items()} for _ in range(2))
    # languages with fewer windows are shown as often
    of_language = [np.flatnonzero(labels == k) for k in range(languages)]
    most = max(map(len, of_language))
    per_epoch = -(-most * languages // MINIBATCH)
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        shown = np.concatenate([np.resize(pick.permutation(rows), most) for rows in of_language])
        pick.shuffle(shown)
        for rows in np.array_split(shown, per_epoch):
            step += 1
            _, slope = gradient(net, np.ascontiguousarray(symbols[rows].T), labels[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
            now = rate * (1 - step / (steps + 1)) / max(1.0, size)
            for name, g in slope.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                net[name] -= now * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
    return net


def windows_of(text: bytes, window: int = WINDOW) -> np.ndarray:
    """All of ``text`` as rows of ``window`` symbols, the last one filled up."""
    rows = -(-len(text) // window)
    out = np.full(rows * window, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, window)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_windows(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, window: int = WINDOW) -> DataFrame:
    """``lang, bytes``: at most ``sample * windows`` windows per language, spread over the whole texts of at most ``sample``
    documents that are not held out, chosen by a hash of their ids."""
    known = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT) & F.col("text").rlike(r"\p{L}"))
    ranked = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("place")).distinct()
    chosen = top_per_key(ranked, ["lang"], [F.col("place"), F.col("doc_id")], sample).select("lang", "doc_id", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lang, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text.encode()
                starts = {round(i * max(0, len(text) - window) / max(1, windows - 1)) for i in range(windows)}
                rows += [(lang, place, text[s : s + window]) for s in sorted(starts)]
            if rows:
                lang, place, cuts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(place), pa.array(cuts, pa.binary())], ["lang", "place", "bytes"])

    # at most ``sample`` ids per language
    texts = known.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "place", "text")
    found = texts.mapInArrow(cut, "lang string, place long, bytes binary").distinct()
    return top_per_key(found, ["lang"], [F.col("place"), F.col("bytes")], sample * windows).select("lang", "bytes")


def learnt(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, **training) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """The languages and the network trained on the sample, which is bounded and fits the driver."""
    rows = sorted((r.lang, bytes(r.bytes)) for r in labelled_windows(docs, sample, windows).collect())
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return [], None
    symbols = np.concatenate([windows_of(cut) for _, cut in rows])
    return languages, trained(symbols, np.array([languages.index(lang) for lang, _ in rows]), len(languages), **training)


def classified(docs: DataFrame, languages: list[str], net: dict[str, np.ndarray] | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` (``doc_id, text``) by a trained network."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    if net is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((languages, net))

    def pooled(texts: list[bytes | None], net: dict[str, np.ndarray]) -> np.ndarray:
        """The mean of the position probabilities of each text; blocks are filled up to one size, so that a text's
        result does not depend on its neighbours."""
        sums = np.zeros((len(texts), len(net["c"])))
        held, owners, many = [], [], 0

        def flush(rows: np.ndarray, of: np.ndarray) -> None:
            block = np.full((BLOCK, WINDOW), PAD, np.intp)
            block[: len(rows)] = rows
            symbols = np.ascontiguousarray(block.T)
            p = position_probabilities(net, symbols)
            p *= (symbols != PAD)[:, None, :]
            # one after the other, in the order of the windows
            np.add.at(sums, of, p.sum(axis=0, dtype=np.float64).T[: len(rows)])

        for i, text in enumerate(texts):
            for at in range(0, len(text or b""), PIECE * WINDOW):
                rows = windows_of(text[at : at + PIECE * WINDOW])
                held.append(rows)
                owners.append(np.full(len(rows), i))
                many += len(rows)
                if many >= BLOCK:
                    rows, of = np.concatenate(held), np.concatenate(owners)
                    whole = many - many % BLOCK
                    for start in range(0, whole, BLOCK):
                        flush(rows[start : start + BLOCK], of[start : start + BLOCK])
                    held, owners, many = [rows[whole:]], [of[whole:]], many - whole
        if many:
            flush(np.concatenate(held), np.concatenate(owners))
        return sums / np.maximum([[len(t or b"")] for t in texts], 1)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = [t.encode() if t and LETTER.search(t) else None for t in part.column(1).to_pylist()]
                means = pooled(texts, net)
                best = means.argmax(axis=1)
                names = [UNKNOWN if t is None else languages[k] for t, k in zip(texts, best)]
                scores = np.where([t is None for t in texts], 0.0, np.minimum(means[np.arange(len(best)), best], 1.0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(classify, f"doc_id {key_type}, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang`` and any others, not read).

    The network learns from rows with an id, a language, a letter and a fold that is not held out; labels and ids never enter a
    prediction. Null texts and texts without a letter are ``und`` with score 0.0, as is everything if nothing can be
    learnt. Equal texts are judged alike, repeated rows each for themselves. A row without an id is judged and not
    learnt from, ``held_out`` is false for it. An empty table gives an empty result.
    """
    found = classified(docs, *learnt(docs, **options))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
