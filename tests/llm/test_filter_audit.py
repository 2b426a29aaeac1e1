import itertools
import random
import re
from collections import Counter

import pytest

from tablescope.llm import filter_audit as fa
from tablescope.sources.shared import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mask(text):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def expected(rows, labels):
    """Every order applied to every document, step by step."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, source in rows:
        fails = plain_mask(text or "")
        fails["E"] = i is not None and i > least[text or ""]
        docs.append((i, source or "", {f for f in fails if fails[f]}))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = docs
        for step, f in enumerate(order, 1):
            here = [d for d in left if f in d[2]]
            left = [d for d in left if f not in d[2]]
            for part in {d[1] for d in docs}:
                of = [d for d in here if d[1] == part]
                failing = [d for d in docs if d[1] == part and f in d[2]]
                shapley[part, f] += len(of)
                out[part, order, step] = [
                    sum(d[1] == part for d in left), len(of), len(failing) - len(of), sum(d[2] == {f} for d in failing),
                    sum(d[0] in good for d in of), sum(d[0] in toxic for d in of),
                ]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def run(spark, files, labels, batches=99):
    """The audit of a table of several files, read one after the other, each in its own micro-batch."""
    path = scratch_path(spark, "audit-test")
    for rows in files:
        frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, n long")
        frame.coalesce(1).write.mode("append").parquet(path)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = fa.audit(spark, path, marks, batches).collect()
    rows = {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in found}
    assert len(rows) == len(found)
    return rows


def corpus(seed, n):
    pick = random.Random(seed)
    texts = [
        " ".join(pick.choice(["tree", "House", "RIVER", "a&b", "sky", f"w{pick.randrange(90)}"]) for _ in range(pick.choice([3, 20, 60, 200])))
        for _ in range(n // 3)
    ]
    rows = [(i, pick.choice(texts), pick.choice(["s1", "s2", None])) for i in range(n)]
    pick.shuffle(rows)
    return rows, [(i, pick.randrange(2), pick.randrange(2)) for i in range(0, n, 2)]


@pytest.mark.parametrize("combined", [1, 7, 200_000])
def test_smaller_ids_in_later_files_retract(spark, monkeypatch, combined):
    monkeypatch.setattr(fa, "COMBINED", combined)
    rows, labels = corpus(3, 240)
    rows.sort(reverse=True)
    want = expected(rows, labels)
    assert run(spark, [rows[:80], rows[80:160], rows[160:]], labels) == want


def test_one_batch(spark):
    rows, labels = corpus(4, 200)
    assert run(spark, [rows[:50], rows[50:]], labels, batches=1) == expected(rows, labels)


def test_odd_rows(spark, odd_rows):
    rows = [(i, t, "s") for i, t in odd_rows]
    rows += [(None, None, None), (6, "same text in two rows, word for word", "other"), (5, "same text in two rows, word for word", None)]
    rows += [(None, "same text in two rows, word for word", "s"), (-4, None, "s"), (90, "", "s")]
    labels = [(6, 1, 0), (6, 0, 1), (5, None, None), (None, 1, 1), (4, 1, None)]
    assert run(spark, [rows[::2], rows[1::2]], labels) == expected(rows, labels)


def test_empty_table_and_labels(spark):
    assert run(spark, [[]], []) == {}
    rows = [(1, "one", "a")]
    assert run(spark, [rows], []) == expected(rows, [])


def test_very_long_text_counts_its_words(monkeypatch):
    text = " ".join(f"w{i % 4000}" for i in range(9000)).encode() + b"\x0b\xc2\xa0x"
    want = fa.word_counts(text)
    monkeypatch.setattr(fa, "LONG_TEXT", 10)
    assert fa.word_counts(text) == want == (9001, 4001)
