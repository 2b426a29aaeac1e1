import random
import zlib

import numpy as np
import pytest

from tablescope.llm import language_id as li

SYLLABLES = {"aa": ["ra", "to", "mi", "lu"], "bb": ["ör", "st", "en", "sch"], "cc": ["ши", "по", "ла", "тё"]}


def text(lang, words, pick):
    return " ".join("".join(pick.choices(SYLLABLES[lang], k=pick.randrange(1, 4))) for _ in range(words))


def corpus(n=360, seed=3):
    pick = random.Random(seed)
    langs = [pick.choice([*SYLLABLES, "aa", "aa"]) for _ in range(n)]
    return [(i, text(lang, pick.randrange(4, 150), pick), lang) for i, lang in enumerate(langs)]


QUICK = dict(sample=40, windows=4, epochs=3, units=6)


def test_gradient_equals_differences():
    net = li.new_network(3, 4, kind=np.float64)
    pick = np.random.default_rng(1)
    symbols = pick.integers(0, 6, (9, 5))
    symbols[5:, 2] = li.PAD
    labels = pick.integers(0, 3, 5)
    _, slope = li.gradient(net, symbols, labels)
    for name, weights in net.items():
        for _ in range(12):
            at = tuple(pick.integers(0, s) for s in weights.shape)
            if name[0] == "E":
                at = (at[0], int(pick.integers(0, 6)))
            here, low_high = weights[at], []
            for move in (1e-5, -1e-5):
                weights[at] = here + move
                low_high.append(li.gradient(net, symbols, labels)[0])
            weights[at] = here
            assert abs((low_high[0] - low_high[1]) / 2e-5 - slope[name][at]) < 1e-8


def plain(net, lang_count, data):
    """Mean position probabilities of one text, window by window and unit by unit."""
    total = np.zeros(lang_count)
    for at in range(0, len(data), li.WINDOW):
        cut = data[at : at + li.WINDOW]
        sides = []
        for side, order in (("f", cut), ("b", cut[::-1])):
            E, U = net["E" + side].astype(float), net["U" + side].astype(float)
            units, h, seen = U.shape[1], np.zeros(U.shape[1]), []
            for symbol in order:
                g, u = E[:, symbol], U @ h
                keep = (np.tanh(g[:units] + u[:units]) + 1) / 2
                reset = (np.tanh(g[units : 2 * units] + u[units : 2 * units]) + 1) / 2
                h = keep * h + (1 - keep) * np.tanh(g[2 * units :] + reset * u[2 * units :])
                seen.append(h)
            sides.append(seen if side == "f" else seen[::-1])
        for left, right in zip(*sides):
            logits = net["Wf"] @ left + net["Wb"] @ right + net["c"][:, 0]
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / len(data)


def test_scores_equal_a_plain_network(spark, make_docs):
    rows = [(i, t) for i, t, _ in corpus(30)]
    rows += [(100, text("bb", 900, random.Random(1))), (101, "ß"), (102, "ab" * 64), (103, "ab" * 64 + "c")]
    net = li.new_network(3, 5)
    got = {r.doc_id: r for r in li.classified(make_docs(rows), ["x", "y", "z"], net).collect()}
    for i, t in rows:
        want = plain(net, 3, t.encode())
        assert got[i].score == pytest.approx(want.max(), abs=1e-5)
        assert got[i].lang_pred == "xyz"[want.argmax()]


def test_held_out_accuracy_and_labels(spark, make_docs):
    rows = corpus()
    got = {r.doc_id: r for r in li.identify(make_docs(rows), **QUICK).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    # what is held out is not looked at
    turned = [(i, t, "zz" if got[i].held_out else lang) for i, t, lang in rows]
    assert {r.doc_id: r for r in li.identify(make_docs(turned), **QUICK).collect()} == got


def test_odd_rows(spark, make_docs, odd_rows):
    odd = [(None if i is None else 10_000 + i, t, None) for i, t in odd_rows]
    odd += [(20_000, "", "only blank"), (20_001, "١٢٣ ²³ _-", "only digits"), (20_002, "²", "aa"), (20_000, "same id, other text", None)]
    rows = corpus(150)
    got = li.identify(make_docs([*rows, *rows[:5], *odd]), **QUICK).collect()
    assert len(got) == len(rows) + 5 + len(odd)
    of = lambda i: [r for r in got if r.doc_id == i]
    for i in (10_001, 10_002, 10_003, 10_009, 20_001, 20_002):
        assert [(r.lang_pred, r.score) for r in of(i)] == [("und", 0.0)]
    assert all(r.lang_pred in ("aa", "bb", "cc") for i in (10_004, 10_007, 10_008, 10_010) for r in of(i))
    assert len({(r.lang_pred, r.score) for r in of(10_006)}) == 1
    assert len({(r.lang_pred, r.score) for r in of(0)}) == 1 and len(of(0)) == 2
    assert not any(r.held_out for r in of(None))


def test_nothing_to_learn(spark, make_docs):
    assert li.identify(make_docs([])).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)
    got = li.identify(make_docs([(held, "text of a language", "aa"), (None, "more", "bb"), (5, "no language", None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = li.identify(make_docs([(0, "one language only", "aa"), (2, "one", "aa")]), **QUICK).collect()
    assert {r.lang_pred for r in one} == {"aa"}
