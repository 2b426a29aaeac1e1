import hashlib
import random
import struct

import pytest

from tablescope.llm import bpe, unigram
from tablescope.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Hello world, it's 2024!  Don't   stop.\n\n\tend ", "<|endoftext|>a<|endoftext|><|endoftext|> b", "naïve 日本語 🙂🙂",
    "՘՘ a՘b 1՘", " " * 300 + "x" + "\n" * 50, "aaaaaaaaaaaaaaaaaaaaaaaa" * 40, "  x\x85y\x1cz", "",
]


def random_texts(n):
    pick = random.Random(7)
    letters = "abcdefgthe  \n.'1é日🙂inǵ"
    return ["".join(pick.choices(letters, k=pick.randrange(80))) for _ in range(n)]


def test_encoding_is_the_librarys(spark, make_docs, odd_rows):
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [*odd_rows, *enumerate(TEXTS + random_texts(300), 100)]
    got = bpe.encode(make_docs(rows), vocabulary("byte_bpe_50k.json"), step=64, keep=("n", "lang")).collect()
    assert len(got) == len(rows) and {r["n"] for r in got} == {"x"}
    want = sorted(
        (str(i), struct.pack(f"<{len(e)}I", *e), tokenizer.decode(e, skip_special_tokens=False))
        for i, e in ((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    )
    assert sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_round_trip_and_digests(make_docs):
    rows = list(enumerate(random_texts(50)))
    got = bpe.token_digests(bpe.encode(make_docs(rows), vocabulary("byte_bpe_50k.json"))).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_clearing_the_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder, plain = (bpe.TrieEncoder(bpe.read_vocabulary(vocabulary("byte_bpe_50k.json"))) for _ in range(2))
    texts = random_texts(40)
    whole = plain.encode(texts)
    assert [encoder.encode([t])[0] for t in texts] == whole


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_are_the_librarys(make_docs, odd_rows, fallback):
    pieces = unigram.read_vocabulary(vocabulary("piece_bpe_32k.model"))
    tokenizer = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = [*odd_rows, *enumerate(TEXTS + random_texts(300) + ["▁x y ▁▁ z", "  two  spaces "], 100)]
    got = unigram.token_counts(make_docs(rows), vocabulary("piece_bpe_32k.model"), byte_fallback=fallback).collect()
    want = sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_ties_go_to_the_earlier_start():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("▁a", -2.0)]
    tokenizer = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=False))
    counter = unigram.PieceCounter(pieces, False)
    for word in ("▁abc", "▁aabcc", "▁xxabyy", "▁bcab"):
        assert counter.of_word(word) == len(tokenizer.encode(word).ids), word


def test_empty_tables(make_docs):
    empty = make_docs([(1, "a")]).filter("doc_id > 1")
    assert bpe.encode(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert unigram.token_counts(empty, vocabulary("piece_bpe_32k.model")).count() == 0
