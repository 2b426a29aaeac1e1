import pickle
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from tablescope.llm import common
from tablescope.llm import ngram_join as nj
from tablescope.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """Component of each row by comparing all pairs; rows of one id are one document."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if alike or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)].append(key)
    return [(key, len(s), min(least[root(i)], default=None)) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    """Near copies of some texts, one large group, a passage many texts share, and texts just about alike."""
    pick = random.Random(seed)

    def text(n):
        return [f"w{pick.randrange(5000)}" for _ in range(n)]

    rows, bases = [], [text(pick.choice([6, 30, 90, 200])) for _ in range(25)]
    passage, crowd = text(40), text(120)
    for i in range(260):
        kind = i % 4
        if kind == 0:
            words = list(pick.choice(bases))
        elif kind == 1:
            words = list(crowd)
        elif kind == 2:
            words = text(pick.choice([5, 40, 160])) + passage + text(pick.choice([0, 3, 60]))
        else:
            words = text(pick.choice([1, 3, 5, 6, 50]))
        for _ in range(pick.choice([0, 0, 1, 2, 3, 4]) if kind < 2 else 0):
            words[pick.randrange(len(words))] = f"x{pick.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w.upper() if pick.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("frequent, wide", [(nj.FREQUENT, nj.WIDE), (0, 3), (0, 1000)])
def test_components_are_those_of_all_pairs(make_docs, odd_rows, monkeypatch, frequent, wide):
    monkeypatch.setattr(nj, "WIDE", wide)
    rows = corpus(11) + [r for r in odd_rows if r[0] != 6] + [(6, "same text in two rows, word for word")] * 2
    rows = [r for r in rows if r[0] is not None]  # ids are what results are compared by
    got = nj.near_duplicates(make_docs(rows), frequent=frequent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))


def test_one_of_each_group_stays(make_docs):
    rows = corpus(12) + [(None, None), (None, "nobody has an id for this text"), (2001, ""), (2001, ""), (2002, "twin one two three four five"), (2002, "twin one two three four five")]
    docs = make_docs(rows)
    kept = nj.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, n, c in set(brute([r for r in rows if r[0] is not None and shingle_set(r[1])])) if i == c)
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect() if shingle_set(r.text)) == want
    assert kept.filter("doc_id IS NULL OR doc_id = 2001").count() == 4


def test_bound_drops_no_similar_pair(spark):
    """Over random sets: the prefixes of similar sets overlap as much as both bounds ask for."""
    pick = np.random.default_rng(5)
    cases = []
    for _ in range(1500):
        n = int(pick.integers(1, 150))
        a = np.unique(pick.integers(0, 2**40, n))
        b = np.unique(np.concatenate([a[pick.random(len(a)) < 0.9], pick.integers(0, 2**40, int(pick.integers(0, 1 + n // 6)))]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        seen = len(np.intersect1d(a[: nj.prefix_length(len(a))], b[: nj.prefix_length(len(b))]))
        for n in (len(a), len(b)):  # each leaves out fewer columns than they share
            assert seen > -(-80 * n // 100) // nj.LONGER
        cases.append((seen, len(a), len(b)))
    frame = spark.createDataFrame(cases, "both long, na long, nb long")
    assert len(cases) > 300 and frame.filter(~nj.may_be_similar(80)).count() == 0


def test_bound_over_seldom_columns(spark):
    """Two rows of 100 n-grams whose unshared ones come first, less the columns that ``seldom_columns`` leaves out."""
    n, spare = 100, 4
    similar = [both for both in range(85, 101) if 100 * both >= 80 * (2 * n - both)]
    cases = [(max(0, nj.prefix_length(n) - (n - both)) - spare, n, n) for both in similar]
    frame = spark.createDataFrame(cases, "both long, na long, nb long")
    assert similar[0] == 89 and frame.filter(~nj.may_be_similar(80, seldom=True)).count() == 0
    assert spark.range(1).select(nj._spare(80, nj.F.lit(n))).first()[0] == spare


def test_pair_among_rows_of_its_passage(make_docs):
    """Texts with two words changed (J = 0.818), unlike rows that are parts of what both have, and its n-grams twice
    each, so that all of them are on the list of frequent ones and come last."""
    pick, texts, pairs = random.Random(3), [], []
    for k in range(4):
        words = [f"w{pick.randrange(10**6)}" for _ in range(104)]
        other = [f"x{k}{i}" if i in (4, 99) else w for i, w in enumerate(words)]
        texts += [words[i : i + 44] for i in range(5, 99 - 43)[::5]]
        texts += [words[i : i + 5] for i in range(5, 95)] * 2
        pairs += [words, other]
    rows = [(i, " ".join(w)) for i, w in enumerate([*pairs, *texts])]
    want = brute(rows)
    assert [c for _, _, c in want[:8]] == [0, 0, 2, 2, 4, 4, 6, 6] and not {c for _, _, c in want[8:]} & {0, 2, 4, 6}
    got = nj.near_duplicates(make_docs(rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_empty_and_blank_tables(make_docs):
    empty = make_docs([(1, "a")]).filter("doc_id > 1")
    assert nj.near_duplicates(empty).count() == 0
    assert nj.without_near_duplicates(empty).count() == 0
    got = nj.near_duplicates(make_docs([(3, None), (4, " ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 0, 3), (4, 0, 4)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_to_drop_by_either_join(make_docs):
    """Small sets of ids go to the texts, others meet them in a shuffle; rows of one id and rows without one included."""
    copy = " ".join(f"a{i}" for i in range(30))
    rows = [(4, copy), (2, copy + " end"), (9, "one of its own"), (9, "another text"), (None, "no id here"), (7, ""), (7, None), (8, copy)]
    sent, met = (nj.without_near_duplicates(make_docs(rows), broadcast_ids=n) for n in (10, 0))
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    for kept in (sent, met):
        assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 7, 9]


def test_workers_hold_little_while_they_hash():
    """4 MB of texts are hashed in pieces, whose arrays stay below 20 MB."""
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(1000)]
    tracemalloc.start()
    sizes = [len(found) for found in nj.Shingler().sets(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [396] * 1000 and peak < 20e6


def test_sent_objects_are_not_held_packed_too():
    assert pickle.loads(pickle.dumps(common._Packed(pickle.dumps([1, 2])))) == [1, 2]
