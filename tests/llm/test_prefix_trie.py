import hashlib
import random
import zlib

from tablescope.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, block string, `a.b` string"


def expected(rows):
    """The trie by plain code: rebuilt conversations, every prefix, its members."""
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = (role or ""), (text or "")
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(lead, [])[:h] + turns[c][h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    # leaves and saved bytes travel from each node to all above it
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, of in members.items():
        own = (len(of) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += own
    out = []
    for path, of in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in of if len(built[c]) == len(path)))
        out.append((
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children.get(path, [])), leaves[path],
            saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows, **options):
    full = [(*r, "x", "y", "z") for r in rows]
    return sorted((tuple(r) for r in pt.prefix_trie(spark.createDataFrame(full, SCHEMA), **options).collect()), key=str)


def conversations(count, seed, longest=7, alphabet=3, low=0):
    pick = random.Random(seed)
    return [
        (c, t, pick.choice(["user", "assistant"]), "t" * pick.randrange(1, alphabet))
        for c in range(low, low + count) for t in range(pick.randrange(1, longest + 1))
    ]


def test_equals_plain_code(spark):
    rows = conversations(120, 1)
    assert got(spark, rows) == expected(rows)


def test_long_conversations_go_on_in_further_blocks(spark):
    rows = conversations(40, 2, longest=30, alphabet=2)
    rows += [(c, t, "user", "same") for c in (1000, 1001, 1002) for t in range(3 * 9 + c % 3)]
    assert got(spark, rows, width=3) == expected(rows)
    assert got(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "late"), (0, None, None, None), (0, None, "user", ""), (0, 2, "", None), (0, 2, None, ""),
        (3, 0, "user", "x" * 100_000), (3, 0, "user", "x" * 100_000), (4, 5, "ab", "c"), (9, 5, "a", "bc"), (14, 5, "a", "bc"),
        (-3, 0, "user", "minus"), (-5, 0, "user", "naïve 日本語 🙂"), (-5, 1, "user", "more"), (-4, 0, "user", "m"),
        (None, 0, "user", "of nobody"), (None, None, None, None), (10**15 + 1, 0, "user", "far"), (10**15 + 2, 0, "user", "far"),
    ]
    assert got(spark, rows) == expected(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # no leader, and more turns to take from it than there are
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(alone, 0, "user", "a"), (alone, 1, "user", "b")]
    found = got(spark, rows)
    assert found == expected(rows)
    assert [r[1:7] for r in found] == [(0, None, 1, 0, 1, 0)]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_copies_of_one_conversation(spark):
    """Many ends in one node: its ids come from several ranges."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(0, 40_000, 7) for t in range(2)]
    assert got(spark, rows) == expected(rows)


def test_one_very_long_conversation(spark):
    rows = [(0, t, "user", str(t % 5)) for t in range(300)] + [(1, t, "user", str(t % 5)) for t in range(290)]
    before = pt.CHUNK
    try:
        pt.CHUNK = 4
        assert got(spark, rows) == expected(rows)
    finally:
        pt.CHUNK = before
