import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tablescope.llm import pii, quality
from tablescope.llm.common import span_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts(make_docs, odd_rows):
    pick = random.Random(1)
    rows = [*odd_rows, *((100 + i, "".join(pick.choices("ab \n\t|#é🙂\r", k=pick.randrange(300)))) for i in range(60))]
    rows += [(200, "a b c a b c"), (201, "a a a a"), (202, "x y\nx y\n\nx y \n \n"), (203, "\x85a\x85 b\x1c")]
    got = quality.metrics(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in got) == sorted((str(i), *brute_counts(t)) for i, t in rows)


def test_binomial_bound(spark):
    cases = [(k, n) for n in (1, 7, 50, 400, 5000) for k in range(0, int(n * 0.05) + 1, max(1, n // 100))]
    frame = spark.createDataFrame(cases, "k long, n long")
    for rate in (0.0125, 0.05):
        rows = frame.filter(F.col("k") <= F.col("n") * rate).select("k", "n", quality.binomial_at_most(F.col("k"), F.col("n"), rate).alias("p"))
        for k, n, p in rows.collect():
            want = math.fsum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1)) if n < 1000 else math.fsum(
                math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)) for i in range(k + 1)
            )
            assert abs(p - want) <= 1e-7 * max(want, 1e-6), (k, n, rate)


def labelled_corpus():
    """Junk full of symbols; English has labels enough for cutoffs, the null language has not."""
    rows, labels = [], []
    for i in range(1500):
        junk = i % 5 == 0
        words = [f"w{i}q{j}" + ("###" if junk else "") for j in range(60)]
        rows.append((i, " ".join(words), "en" if i < 1400 else None))
        labels.append((i, 0 if junk else 1))
    return rows, labels


def test_cutoffs_are_certified(spark, make_docs):
    rows, labels = labelled_corpus()
    docs = make_docs([*rows, (None, None), (5000, rows[0][1], "xx")])
    frame = spark.createDataFrame([*labels, (None, 1), (7, None), (7, 1), (9, 5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, frame).collect()}
    assert len(got) == len(rows) + 2
    for i, _, lang in rows:
        assert got[i].kept == (lang is None or i % 5 != 0), i
    assert got[5000].kept and not got[None].kept
    none = quality.judge(docs, frame.filter("doc_id < 0"))
    assert none.filter("kept").count() == len(rows) + 1
    assert quality.judge(docs.filter("doc_id < 0"), frame).count() == 0


def test_false_rejections_stay_below_the_rate(spark):
    """Good documents with shares all over: no cutoff may lose more of a stratum than its rate allows."""
    pick = random.Random(4)
    rows = [(i, "s", False, pick.random() ** 6, 0.0, 0.0, 0.0) for i in range(4000)]
    measured = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, symbols double, repeats double, dup_lines double, shouting double")
    labels = measured.select("doc_id", F.when(F.col("symbols") > 0.6, F.col("doc_id") % 2).otherwise(1).cast("int").alias("quality"))
    cut = quality.certified_cutoffs(measured, labels, rate=0.2, loss=0.0).first()
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    lost = sum(i in good and s > cut["symbols"] for i, _, _, s, *_ in rows)
    n, rate = len(good), 0.05
    tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)) for i in range(lost + 1))
    assert tail <= 0.05 / 4 and cut["repeats"] is None


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def brute_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]():
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_base_spans(make_docs, odd_rows):
    pick = random.Random(2)
    texts = [
        "a.b+c@mail.example.com x@y z@q..com a@b.c_d@e.f", "1.2.3.4.5 256.1.1.1 0001.02.3.4 1.2.3 .1.2.3.4.5.6.7.8", "🙂 4481 1777-1945 6473, 4111111111111111 0",
        "+1 (928) 555-0085 and +12 +1234567890123456 +1-2-3-4-5-6-7-8-9.", "", "x@y.z@w.v",
    ] + ["".join(pick.choices("01a.@+ -()b", k=pick.randrange(60))) for _ in range(200)]
    rows = [*odd_rows, *enumerate(texts, 100)]
    got = span_columns(pii.personal_data(make_docs(rows), rounds=2), pii.BASE_KINDS).collect()
    want = sorted((str(i), hashlib.sha256(brute_base(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        if r.doc_id in (100, 102):
            assert brute_base(dict(rows)[r.doc_id]) in r.spans


def test_labelers_agree_on_further_kinds(make_docs):
    """Well-formed data with telling words around it is reported, look-alikes are not."""
    rows = [(i, f"mail to ann.{i}@mail.example.com or call +1 (928) 555-{1000 + i}, host 10{i}.20.30.40") for i in range(60)]
    rows += [(100 + i, f"version 4.{i}.300.{i}.1 order {1000000000000000 + i} ref 99999999999 sha a{i}12345678901234b") for i in range(60)]
    rows += [(200 + i, f"call us by phone: (928) 555-{1000 + i} today") for i in range(20)]
    rows += [(300, "IBAN DE89 3704 0044 0532 0130 00 for the account"), (301, "IBAN DE89 3704 0044 0532 0130 01 order ref"), (302, "SSN 123-45-6789"), (303, "write to ann [at] mail [dot] com")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(make_docs(rows)).collect()}
    assert all(("tel", 18, 32) in got[200 + i] for i in range(20))
    assert ("iban", 5, 32) in got[300] and not got[301]
    assert all(k in pii.BASE_KINDS for i in range(60) for k, *_ in got[100 + i])


def test_empty_tables(make_docs):
    empty = make_docs([(1, "a")]).filter("doc_id > 1")
    assert pii.personal_data(empty, rounds=1).count() == 0
    assert quality.metrics(empty).count() == 0
