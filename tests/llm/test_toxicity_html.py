import random
import zlib

import numpy as np
import pytest

from tablescope.llm import html_content as hc
from tablescope.llm import toxicity as tox

SLURS = ["gronkle", "vexbag", "snarfface"]


def corpus(n=900):
    """Documents of plain words; every sixth has slurs, some with endings that are seen once."""
    pick = random.Random(9)
    plain = ["".join(pick.choices(["re", "ta", "lin", "mo", "che", "dor", "is"], k=pick.randrange(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = pick.choices(plain, k=pick.randrange(5, 120))
        bad = i % 6 == 0
        for _ in range(pick.randrange(2, 4) if bad else 0):
            words[pick.randrange(len(words))] = pick.choice(SLURS) + "".join(pick.choices("aeiou", k=pick.randrange(3)))
        rows.append((i, " ".join(words), pick.choice(["en", "de"]), pick.choice(["s", None])))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs, odd_rows):
    rows, labels = corpus()
    frame = spark.createDataFrame([*labels, (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    odd = [(None if i is None else 10_000 + i, t) for i, t in odd_rows]
    got = tox.toxicity(make_docs([*rows, *odd]), frame).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(by_id[i].predicted, bad) for i, bad in labels if by_id[i].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(by_id[10_000 + i].predicted == 0 for i in (1, 2, 3))
    assert len({r.score for r in got if r.doc_id == 10_006}) == 1


def test_held_out_labels_change_nothing(spark, make_docs):
    rows, labels = corpus(300)
    docs = make_docs(rows)
    turned = [(i, 1 - b if zlib.crc32(str(i).encode()) % 5 == 0 else b) for i, b in labels]
    a, b = (
        {r.doc_id: r.score for r in tox.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, turned)
    )
    assert a == b


def test_words_seen_twice_count(spark, make_docs):
    """Every telling word, toxic or ordinary, is in two of the documents that give the counts."""
    pick = random.Random(4)

    def word():
        return "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=9))

    plain, ids = [word() for _ in range(60)], {f: [] for f in range(5)}
    for i in range(4000):
        ids[zlib.crc32(str(i).encode()) % 5].append(i)
    rows, labels = [], []
    for n in range(160):
        telling = word()
        for f in (1 + n % 3, 1 + (n + 1) % 3, 4, 0):
            i = ids[f].pop()
            rows.append((i, " ".join([*pick.choices(plain, k=6), telling])))
            labels.append((i, n % 2))
    got = tox.toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    bad = dict(labels)
    held = [r.predicted == bad[r.doc_id] for r in got if r.held_out]
    assert len(held) == 160 and sum(held) >= 150


def test_all_labelled_documents_are_learnt_from(spark, monkeypatch):
    """30,000 documents of each class: those of three folds give the counts, those of one the curve."""
    ids = spark.range(60_000)
    docs, labels = ids.selectExpr("id AS doc_id", "concat('word ', id % 7) AS text"), ids.selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    learnt, real, curve = [], tox.word_counts, tox.fit_logistic
    monkeypatch.setattr(tox, "word_counts", lambda known: learnt.append(known.count()) or real(known))
    monkeypatch.setattr(tox, "fit_logistic", lambda *points: learnt.append(points[1]) or curve(*points))
    tox.toxicity(docs, labels)
    folds = [zlib.crc32(str(i).encode()) % 5 for i in range(60_000)]
    assert learnt == [sum(f in (1, 2, 3) for f in folds), sum(f == 4 for f in folds)]


def test_labels_go_to_the_texts(spark, make_docs):
    """Few labels are sent and no text is shuffled; many meet the texts of the folds they learn from. Both are the same rows."""
    rows = [(i, f"text of {i}") for i in range(100)] + [(7, "again"), (None, "no id"), (3, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 100, 3)] + [(None, 1)], "doc_id long, toxic int")
    folds, texts = {i: zlib.crc32(str(i).encode()) % 5 for i in range(100)}, [(i, t) for i, t in rows if i in range(0, 100, 3)]
    by_size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (50, 0):
            parts = tox.learnt_from(make_docs(rows), labels, most)
            for part, own in zip(parts, ((1, 2, 3), (4,))):
                want = [(t or "", i % 2) for i, t in texts if folds[i] in own]
                assert sorted((r.text or "", r.toxic) for r in part.collect()) == sorted(want)
                plan = part._jdf.queryExecution().executedPlan().toString()
                assert ("BroadcastHashJoin" in plan, "hashpartitioning" in plan) == (most > 0, most == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", by_size)


def test_ngrams_of_odd_words_are_counted(spark):
    """Words of one letter, of letters beyond 16 bits and longer than the order; none at all."""
    words = [("a", 2, 0), ("ab", 0, 3), ("abcabcabc", 1, 1), ("\U00010400x", 5, 2), ("äbc", 0, 1)]
    want: dict[str, list[int]] = {}
    for word, t, o in words:
        line = f"^{word}$"
        for end in range(2, len(line) + 1):
            for start in range(max(0, end - 3), end):
                held = want.setdefault(line[start:end], [0, 0])
                held[0] += t
                held[1] += o
    frame = spark.createDataFrame(words, "word string, toxic long, ordinary long")
    got = tox.ngram_counts(frame, 3).to_pylist()
    assert len(got) == len(want) and {r["gram"]: [r["toxic"], r["ordinary"]] for r in got} == want
    assert tox.ngram_counts(frame.filter("toxic > 9"), 3).num_rows == 0


def test_sums_find_every_key():
    pick = np.random.default_rng(4)
    keys = np.concatenate([pick.integers(0, (1 << 64) - 1, 3000, np.uint64), np.arange(5, dtype=np.uint64), ~np.arange(5, dtype=np.uint64)])
    sums = tox.Sums(np.concatenate([keys, keys[:10]]), np.ones((len(keys) + 10, 2)))
    assert (sums.of(keys) == np.where(np.arange(len(keys)) < 10, 2, 1)[:, None]).all()
    assert not sums.of(keys[:3000] + np.uint64(1)).any()
    assert not tox.Sums(np.empty(0, np.uint64), np.empty((0, 2))).of(keys).any()


def test_curve_equals_newton_in_numpy(spark):
    pick = np.random.default_rng(2)
    x = pick.normal([-0.3, 1, 2], [0.2, 1, 3], (400, 3))
    y = (x @ [3, 1, 0.2] + pick.normal(0, 1, 400) > 0.5).astype(int)
    frame = spark.createDataFrame([(int(t), *map(float, r)) for t, r in zip(y, x)], "toxic int, mean double, window double, top double")
    mean, scale, w = tox.fit_logistic(frame, 400)
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0))
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / (x.std(0) + 1e-9)])
    gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + 1e-2 * w
    assert np.abs(gradient).max() < 1e-6


def test_filter_keeps_columns_and_rows(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs([*rows, (None, None)])
    kept = tox.without_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and sum(i in ids for i, b in labels if not b) >= 740  # of 750
    assert sum(i in ids for i, b in labels if b) <= 8  # of 150


def test_no_labels_and_no_rows(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity(docs, none).collect()} == {0.0}
    assert tox.toxicity(docs.filter("doc_id > 5"), none).count() == 0


def test_likelihoods_sum_to_at_most_one():
    """Over all letters, a context's likelihoods are a distribution but for what unseen letters hold."""
    counts = {"^ab": (3, 1), "^a": (3, 2), "ab": (3, 1), "b$": (3, 1), "ab$": (3, 1), "a": (3, 2), "b": (3, 1), "$": (3, 1), "ac": (0, 1), "^ac": (0, 1), "c": (0, 1)}
    model = tox.LetterModel(counts, order=3, shared=1)
    for c in (0, 1):
        for context in ("^a", "ab", "zz"):
            total = sum(model.likelihood(context + x, c) for x in "abc$^")
            assert 0 < total <= 1 + 1e-9


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    "<!-- x --><div class='ad'>Buy this now, it is cheap.</div><article><h1>{title}</h1>{body}</article><footer>&copy; me &middot; all rights.</footer></body></html>"
)


@pytest.fixture(scope="module")
def pages(spark):
    pick = random.Random(1)

    def text(n):
        return " ".join("".join(pick.choices("abcdefgh", k=5)) for _ in range(n)) + "."

    rows = [(i, f"http://h/{i}", PAGE.format(title=text(5), body="".join(f"<p>{text(pick.randrange(3, 60))}" for _ in range(4))), "x") for i in range(120)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_articles_come_out_whole(spark, pages):
    odd = [
        (1000, None, None), (1001, "u", ""), (1002, "u", "just text &amp; no markup"), (1003, "u", "<p"), (1004, "u", "<article><p>a&nbsp;b &lt;c&gt;\n d<br>e<p>f"),
        (1005, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (1006, "u", PAGE.format(title="T", body="<p>" + "word, and more. " * 20_000)),
        (1007, "u", "<script>" * 50), (1008, "u", "<!-- never ends <p>x</p>"), (1006, "u", "<article><p>same id</p></article>"),
    ]
    frame = pages.unionByName(spark.createDataFrame([(*r, "x") for r in odd], pages.schema))
    got = hc.extract(frame).collect()
    assert len(got) == 130
    for r in pages.collect():
        start = r.html.index("<h1>")
        want = r.html[start : r.html.index("</article>")].replace("<h1>", "").replace("</h1>", "").replace("<p>", "\n")
        assert next(g.text for g in got if g.page_id == r.page_id) == want
    by_id = {g.page_id: g.text for g in got}
    assert by_id[1000] == by_id[1001] == by_id[1003] == by_id[1007] == by_id[1008] == ""
    assert by_id[1004] == "a b <c> d e\nf"
    assert any(len(g.text) > 300_000 for g in got if g.page_id == 1006)
    assert hc.extract(frame.filter("page_id < 0")).count() == 0


def test_parts_that_are_no_content(pages):
    """Boilerplate the training pages don't have, inside and outside of the article, with and without its tag."""
    model = hc.train(pages)
    story = "<h1>The title of it</h1><p>A first long paragraph of a story, with some words in it. It goes on.</p>"
    more = "<p>And another &amp; longer paragraph follows here, with more text, of course.</p>"
    inside = "<div class='advert-box'>Buy our good stuff now, it is great.</div><aside><p>See also our other stories, of old.</p></aside>"
    around = (
        "<header><h1>Site</h1></header><div id=cookie-notice>We use cookies, as all do. Accept?</div>", "<form><p>Subscribe now, it is free.</p><input></form>"
        "<section id=comments><h2>Comments</h2><p>Great article, I liked it very much.</p></section><div class='sidebar'><p>Popular posts, of the week.</p></div>",
    )
    want = "The title of it\nA first long paragraph of a story, with some words in it. It goes on.\nAnd another & longer paragraph follows here, with more text, of course."
    for tag in ("article", "main", "div"):
        html = f"<html><body>{around[0]}<{tag}>{story}{inside}{more}</{tag}>{around[1]}</body></html>"
        assert model.main_text(html) == want, tag


def test_formulas_drawings_and_fallbacks_stay(pages):
    """Their text is part of the article's; scripts, styles and form controls are not."""
    model = hc.train(pages)
    body = (
        "<p>Of a long paragraph, <math><mi>a</mi><mo>+</mo><mn>2</mn></math> is the sum, as we all know it.</p>"
        "<p>A figure <svg><title>t</title><style/><path d='M0 0'/><g><text>low</text><text>high</text></g></svg> has two labels, of course.</p>"
        "<p>A film <object data=x>of a <b>cat</b></object> and <canvas>a chart</canvas> are here, to be seen.</p>"
        "<p>Pictures <noscript>without scripts</noscript> are shown, too.</p><p>No <script>x</script><button>Go</button> control, at all.</p>"
    )
    got = model.main_text(PAGE.format(title="The title of it", body=body)).split("\n")
    assert got == [
        "The title of it", "Of a long paragraph, a+2 is the sum, as we all know it.", "A figure low high has two labels, of course.",
        "A film of a cat and a chart are here, to be seen.", "Pictures without scripts are shown, too.", "No control, at all.",
    ]


def test_whole_pages_in_a_form_and_mixed_names(pages):
    """What holds the page or the body of its article is content, whatever it is called; its namesakes are not."""
    model = hc.train(pages)
    story = "".join(f"<p>A {w} long paragraph of a story, with some words in it. It goes on.</p>" for w in ("first", "second", "third"))
    want = "The title of it\n" + story.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")
    nav = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
    title = "<h1>The title of it</h1>"
    for html in (
        f"<form id=aspnetForm>{nav}{title}{story}<input name=q></form>",
        f"{nav}<div class='header-layout content'>{title}{story}</div>",
        f"{nav}<article>{title}<div class='entry-content post-tags story-header'>{story}</div></article><footer>All rights.</footer>",
        f"<div class='has-sidebar'>{nav}<article>{title}{story}</article><div class='sidebar'>Popular posts, of the week.</div></div>",
        f"<article>{title}{story}</article><div class='post-comments'><p>I liked it, very much.</p></div><form><p>Subscribe now, it is free.</p></form>",
        f"<article>{title}{story}</article><div class='content-comments'><article class=comment><p>{'I liked it, very much. ' * 40}</p></article></div>",
    ):
        assert model.main_text(f"<html><body>{html}</body></html>") == want, html


def test_inline_parts(pages):
    """Adverts and share bars in inline elements go, also around blocks; other inline elements stay."""
    model = hc.train(pages)
    body = (
        "<p>A long paragraph <span class='ad'>Buy now!</span> of a <span class='hl'>story</span>, with words in it.<span class='share-buttons'><a href=/x>Share</a></span></p>"
        "<span class='advert'><div>Our great offer, for you.</div></span><p>Another paragraph follows here, as <a class='text-link' href=/y>they</a> do.</p>"
    )
    got = model.main_text(PAGE.format(title="The title of it", body=body))
    assert got == "The title of it\nA long paragraph of a story, with words in it.\nAnother paragraph follows here, as they do."


def test_many_tags_without_their_other_half():
    import time

    before = time.perf_counter()
    for html in ("<div>" * 50_000 + "</section>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<button>" * 20_000, "<h1>" * 50_000):
        assert hc.parse(html + "<p>x")[1]
    assert time.perf_counter() - before < 20


def test_pages_without_labels_take_no_part_of_the_sample(spark, pages):
    others = [(10_000 + i, f"http://o/{i}", f"<div>page {i}</div>", "x") for i in range(2000)]
    alone, among = hc.train(pages, sample=60), hc.train(pages.unionByName(spark.createDataFrame(others, pages.schema)), sample=60)
    assert hc.np.allclose(alone.weights, among.weights) and hc.np.allclose(alone.edges, among.edges)


def test_marginals_are_exact(pages):
    """Messages against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = hc.train(pages)
    nodes, _ = hc.parse("<body><article><p>One, two.</p><div class=ad>x<p>y</p></div></article><footer>z</footer></body>")
    got = model.marginals(nodes)
    odds = hc.features(nodes) @ model.weights
    total, sums = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        weight = 1.0
        for i, (node, label) in enumerate(zip(nodes, labels)):
            weight *= 1 / (1 + math.exp(-odds[i] if label else odds[i]))
            if node.parent >= 0:
                weight *= model.edges[hc.marking(node)][labels[node.parent]][label]
        total += weight
        for i, label in enumerate(labels):
            sums[i] += weight * label
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(got, sums))
