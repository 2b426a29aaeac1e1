import pytest

SF_DIR = "/root/testdata/sf0.001"

#: Extra columns named like what the operators use inside.
EXTRA = "n string, size string, node string, doc string, h string, score string, `key` string, `a.b` string, found string"
EXTRAS = ("x",) * 9


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows, with extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *EXTRAS) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, odd and very long texts, repeated rows and a repeated id."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (None, None), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "naïve 日本語 🙂🙂 text here"),
        (6, "same text in two rows, word for word"), (6, "same text in two rows, word for word"), (7, long),
        (8, "x" * 100_000), (9, "1" * 50_000), (10, "a@" * 20_000), (None, "no id at all here, is there"),
        (11, "z" + " 1-" * 20_000),
    ]
