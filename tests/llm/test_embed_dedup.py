import numpy as np
import pytest

from tablescope.llm import embed_dedup as ed


def brute(rows):
    """Links and components by comparing all pairs in double precision."""
    keys, unit = [], {}
    for key, x in rows:
        keys.append(key)
        if x and None not in x and np.isfinite(x).all() and any(x):
            y = np.array(x, float) / np.abs(x).max()
            unit[key] = y / np.linalg.norm(y)
    links = {k: set() for k in keys}
    for a in unit:
        for b in unit:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a].add(b)
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            todo += [n for n in links[todo.pop()] if n not in seen and not seen.add(n)]
        out[k] = (len(links[k]), min(seen), min(seen) == k)
    return out


@pytest.mark.parametrize("dims", [64, 7, 2])
def test_links_and_components(spark, dims):
    """Tight groups, chains of vectors at the edge of the range, pairs just inside and outside, loose vectors."""
    pick = np.random.default_rng(dims)
    rows = [(1000 - i, pick.standard_normal(dims).tolist()) for i in range(80)]
    for g in range(6):
        centre = pick.standard_normal(dims)
        for i in range(30):
            spread = [0.01, 0.05, 0.1, 0.2, 0.3, 0.16][g]
            rows.append((2000 + 100 * g + i, ((centre + spread * np.linalg.norm(centre) / dims**0.5 * pick.standard_normal(dims)) * (i + 1)).tolist()))
    turn = np.eye(dims)
    for i in range(20):  # a chain: each links with its neighbours only
        angle = i * 0.3
        rows.append((3000 + i, (np.cos(angle) * turn[0] + np.sin(angle) * turn[1]).tolist()))
    odd = [(1, None), (2, []), (3, [0.0] * dims), (4, [None] + [1.0] * (dims - 1)), (5, [float("nan")] * dims),
           (6, [float("inf")] + [1.0] * (dims - 1)), (7, [1e300] * dims), (8, [1e-300] * dims), (9, [1.0] * (dims + 1)), (10, [2.0] * (dims + 1))]
    rows += odd
    frame = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, v string, class int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(frame).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert ed.near_duplicates(frame.filter("vec_id > 5")).count() == 0


def by_products(rows):
    """As ``brute``, for vectors of equal length in one array each, by products of blocks and merges of labels."""
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    least = ids.copy()
    while True:
        now = np.minimum(least, np.where(links, least, np.iinfo(np.int64).max).min(axis=1))
        if (now == least).all():
            return {int(k): (int(n), int(m), bool(m == k)) for k, n, m in zip(ids, links.sum(axis=1), least)}
        least = now


def planted(dims, loose, seed=3):
    """Loose vectors, a large group of exact copies, one of near copies beside it, groups near the limit and pairs."""
    pick = np.random.default_rng(seed)
    x = [*pick.standard_normal((loose, dims))]
    centre = pick.standard_normal(dims)
    x += [centre * (i + 1) for i in range(700)]
    x += [centre + 0.1 * pick.standard_normal(dims) for _ in range(600)]
    for spread in (0.2, 0.22, 0.23, 0.24, 0.3):
        centre = pick.standard_normal(dims)
        x += [centre + spread * pick.standard_normal(dims) for _ in range(80)]
    x += [x[i] + 0.2 * pick.standard_normal(dims) for i in range(0, loose, 7)]
    order = pick.permutation(len(x))
    return [(int(k) * 3 + 1, x[i].tolist()) for k, i in enumerate(order)]


def result(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(frame).collect()}


def test_rows_written_stay_few(spark, monkeypatch):
    """What is written grows with the vectors, not with cells around them or with pairs that may link."""
    rows = planted(64, 4000)
    written, cut = {}, ed.cut_lineage

    def counted(df, label="stage"):
        out = cut(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(ed, "cut_lineage", counted)
    assert result(spark, rows) == by_products(rows)
    assert sum(written.values()) <= 4 * len(rows), written


@pytest.mark.parametrize("dims", [64, 130, 12])
def test_many_chunks(spark, monkeypatch, dims):
    """Chunks and parts of few vectors: groups lie across them, pairs of chunks share tasks, parts link as a whole."""
    for name, value in (("LEAST_CHUNK", 300), ("PART", 32), ("ROWS", 16), ("SAMPLE", 700), ("LONG", 100)):
        monkeypatch.setattr(ed, name, value)
    rows = planted(dims, 1500, seed=dims)
    assert result(spark, rows) == by_products(rows)


def test_ids_at_the_ends_and_types_of_numbers(spark):
    """Ids of any sign and size, numbers of other types, a repeated id, groups of several lengths."""
    ends = [-(2**63), -5, 0, 2**63 - 1]
    for kind in ("float", "double", "int", "decimal(9,3)"):
        rows = [(k, [20 + i, 1, 2]) for i, k in enumerate(ends)] + [(7, [1, 20]), (8, [1, 21]), (8, [1, 21]), (9, [1, None]), (10, [0, 0])]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<int>").selectExpr("vec_id", f"CAST(embedding AS array<{kind}>) AS embedding")
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(frame).collect())
        assert got == sorted([*((k, 3, ends[0]) for k in ends), (7, 1, 7), (8, 1, 7), (8, 1, 7), (9, 0, 9), (10, 0, 10)])


def test_limit_is_in_double_precision(spark):
    """Pairs closer to the limit than codes or single precision tell."""
    rows, want = [], {}
    for i in range(40):
        turn = np.zeros(40)
        turn[i] = 1.0
        other = np.zeros(40)
        shift = (i - 19.5) * 1e-12
        other[i], other[(i + 1) % 40] = 0.95 + shift, (1 - (0.95 + shift) ** 2) ** 0.5
        rows += [(2 * i, turn.tolist()), (2 * i + 1, other.tolist())]
        want[2 * i] = int(shift > 0)
    got = result(spark, rows)
    assert {k: got[k][0] for k in want} == want
    assert ed.exact(spark.createDataFrame([(0, 1), (38, 39), (40, 41)], "a long, b long"),
                    spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect() == [(40, 41)]


def test_links_of_blocks():
    """Trees and forests join what the links join."""
    pick = np.random.default_rng(1)
    for share, groups in ((0.001, 1), (0.01, 1), (0.3, 1), (1.0, 20)):
        cells = pick.random((120, 200)) < share
        if groups > 1:
            cells &= (np.arange(120) % groups)[:, None] == np.arange(200) % groups
        rows, cols = np.nonzero(cells)
        want = ed.forest(rows, 120 + cols, 320)
        u, v = ed.spanning(cells)
        assert cells[u, v].all()
        got = ed.forest(u, 120 + v, 320)
        assert all((a == b).all() for a, b in zip(want, got))
    x = np.vstack([pick.standard_normal((300, 6)), np.ones((300, 6))]).astype(np.float32)
    lines, cuts, kids = ed.tree_of(x)
    at = np.zeros(len(x), int)
    while (on := np.flatnonzero(at >= 0)).size:
        at[on] = kids[at[on], ((x[on] * lines[at[on]]).sum(axis=1) > cuts[at[on]]).astype(int)]
    assert np.bincount(-1 - at).max() <= 320 and set(-1 - at) == set(range(len(set(at))))


def test_tree_of_copies_beside_loose_vectors():
    """Cuts that take off one vector each don't make the tree as deep as there are vectors."""
    aside = np.diag(0.9 * 0.997 ** np.arange(600))
    pairs = np.hstack([np.ones((600, 1)), aside])
    x = np.vstack([np.eye(1, 601).repeat(3000, axis=0), pairs, pairs * np.r_[1, -np.ones(600)]]).astype(np.float32)
    lines, cuts, kids = ed.tree_of(x)
    at, steps = np.zeros(len(x), int), 0
    while (on := np.flatnonzero(at >= 0)).size:
        at[on], steps = kids[at[on], ((x[on] * lines[at[on]]).sum(axis=1) > cuts[at[on]]).astype(int)], steps + 1
    assert steps <= ed.DEPTH and set(-1 - at) <= set(range(kids.size))
