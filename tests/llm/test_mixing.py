import random
import re

from tablescope.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Share by weight, cut at twice the size, share what is over again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def corpus(seed=3, n=600):
    pick = random.Random(seed)
    names = ["a", "b", "Z", "é", "ﬀ", "𝒳", None, "", "tiny"]
    rows = []
    for i in range(n):
        name = "a" if i % 3 == 0 else "tiny" if i == 1 else pick.choice(names[1:-1])
        rows.append((i, " ".join(["w"] * pick.randrange(40)), "en", name))
    return rows


def test_targets_and_sums(make_docs):
    rows = corpus()
    sizes, largest = {}, {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
        largest[source] = max(largest.get(source, 0), len(WORD.findall(text)))
    want = brute_targets(sizes)
    got = mixing.mixed_sizes(make_docs(rows)).collect()
    by_id = {r.doc_id: r for r in got}
    taken = dict.fromkeys(sizes, 0)
    for i, text, _, source in rows:
        r = by_id[i]
        assert r.size == len(WORD.findall(text)) and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(1, largest[source]), source
    again = {r.doc_id: r.taken for r in mixing.mixed_sizes(make_docs(rows[::-1])).collect()}
    assert again == {i: r.taken for i, r in by_id.items()}


def test_documents_repeat_as_sizes_say(make_docs):
    docs = make_docs(corpus(5, 200))
    times = {r.doc_id: r.times for r in mixing.mixed_sizes(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r["a.b"] == "x"
    assert got == {i: t for i, t in times.items() if t}


def test_odd_rows(make_docs, odd_rows):
    got = mixing.mixed_sizes(make_docs([*odd_rows, (50, "w w", "en", None)])).collect()
    assert len(got) == len(odd_rows) + 1
    assert all(r.size == 0 for r in got if r.doc_id in (1, 2, 3))
    assert len({r.taken for r in got if r.doc_id == 6}) == 1
    empty = make_docs([(1, "a")]).filter("doc_id > 1")
    assert mixing.mixed_sizes(empty).count() == 0
    assert mixing.mixed_documents(make_docs([(1, None), (2, "")])).columns == empty.columns


def test_one_hash_is_refined_to_the_end(spark):
    """Thresholds may end inside a group of equal hashes, at the least or the greatest hash, or take all."""
    rows = [("=s", "s", 10, h) for h in (-(1 << 63), -5, 0, 0, 7, (1 << 63) - 1)]
    sized = spark.createDataFrame(rows, "key string, source string, size long, h long")
    for share in (0.0, 0.17, 0.4, 0.5, 0.99, 1.0, 1.5, 2.0):
        r = mixing.thresholds(sized, share=share).first()
        taken = sum(10 * (r["copies"] + (r["last"] is not None and h <= r["last"])) for *_, h in rows)
        assert abs(taken - 60 * share) <= 10, (share, r)
