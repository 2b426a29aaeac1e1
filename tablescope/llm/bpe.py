"""Byte-level BPE encoding and decoding of whole texts over a trie of their distinct words.

The last token of a prefix is found from the last tokens of shorter prefixes: it is the one suffix in the vocabulary
that stands beside the last token of what precedes it, where two tokens stand beside each other if merging their joint
bytes gives just these two. So one step down the trie extends an encoding by one byte, and words that share a prefix
share its steps. A task inserts the distinct words of a batch by sorting them, which lists a trie's words depth first,
and keeps the states of the current path only; going on to the next word drops the states below the shared prefix.
"""

from __future__ import annotations

import json
import math
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level scheme cuts text into words (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a task keeps encodings of; past that it starts afresh, which changes no result.
CACHE_WORDS = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def newer_letters() -> str:
    """Code points that the regex module calls letters or numbers and the older tables of the tokenizer don't know."""
    newer = regex.compile(r"[\p{L}\p{N}]")
    return "".join(
        c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and newer.match(c)
    )


def read_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file, as plain values that can be broadcast; read on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    model = spec["model"]
    ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    merges = {}
    for rank, (left, right) in enumerate(pairs):
        merges[model["vocab"][left], model["vocab"][right]] = (rank, model["vocab"][left + right])
    special = {}
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"unsupported added token {token['content']!r}")
        special[token["content"]] = token["id"]
    return {"ids": ids, "merges": merges, "special": special, "newer": newer_letters()}


class TrieEncoder:
    """Encodes batches of words; ``encoded`` maps a word to its ids, packed as 32-bit little-endian integers."""

    def __init__(self, vocabulary: dict):
        self.ids = vocabulary["ids"]
        self.merges = vocabulary["merges"]
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in vocabulary["special"].items()}
        self.longest = max(map(len, self.ids))
        self.special = vocabulary["special"]
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.word = regex.compile(WORD_PATTERN)
        # for cutting only, an unassigned character stands in for those the tokenizer's tables don't know
        self.stand_in = dict.fromkeys(map(ord, vocabulary["newer"]), "͸")
        self.newer = frozenset(vocabulary["newer"])
        self.made_by = {made: (rank, left, right) for (left, right), (rank, made) in self.merges.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.beside: dict[tuple[int, int], bool] = {}
        self.encoded: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> tuple[list[int], list[float]]:
        """The tokens that merging makes of the last (``side`` 1) or first byte of a token, up to the token itself,
        and the rank of the merge that ends each."""
        known = self.spines[side].get(token)
        if known is None:
            tokens, ranks = [token], [math.inf]
            while (made := self.made_by.get(tokens[-1])) is not None:
                tokens.append(made[1 + side])
                ranks.append(made[0])
            known = self.spines[side][token] = tokens[::-1], ranks[::-1]
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives these two, that is, never merges across their border.

        The tokens at the border grow on either side by merges of known rank; a merge across it comes first if its
        rank is lower than that of the next one on either side. At equal ranks the merge further left comes first.
        """
        key = (left, right)
        known = self.beside.get(key)
        if known is None:
            (before, ends), (after, starts) = self.spine(left, 1), self.spine(right, 0)
            i = j = 0
            while True:
                across = self.merges.get((before[i], after[j]))
                if across is not None and across[0] < ends[i] and across[0] <= starts[j]:
                    known = False
                    break
                if ends[i] <= starts[j]:
                    if ends[i] == math.inf:
                        known = True
                        break
                    i += 1
                else:
                    j += 1
            self.beside[key] = known
        return known

    def insert(self, words: set[str]) -> None:
        """Depth-first over the trie of ``words``."""
        if len(self.encoded) > CACHE_WORDS:
            self.encoded.clear()
        if len(self.beside) > CACHE_WORDS:
            self.beside.clear()
        ids, longest, may_follow = self.ids, self.longest, self.may_follow
        last: list[int] = [-1]  # last token of the path's prefix of each length
        path = b""
        for data, word in sorted((w.encode(), w) for w in words if w not in self.encoded):
            shared, upto = 0, min(len(path), len(data))
            while shared < upto and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    token = ids.get(data[start:end])
                    if token is not None and (start == 0 or may_follow(last[start], token)):
                        last.append(token)
                        break
            path = data
            tokens, end = array("I"), len(data)
            while end:
                tokens.append(last[end])
                end -= len(self.bytes_of[last[end]])
            tokens.reverse()
            self.encoded[word] = tokens.tobytes()

    def words_of(self, text: str) -> list[str]:
        if text.isascii() or self.newer.isdisjoint(text):
            return self.word.findall(text)
        return [text[m.start() : m.end()] for m in self.word.finditer(text.translate(self.stand_in))]

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t] for t in texts]
        cut = [[p if i % 2 else self.words_of(p) for i, p in enumerate(ps)] for ps in pieces]
        self.insert({w for ps in cut for p in ps[::2] for w in p})
        known, special = self.encoded, {s: array("I", [i]).tobytes() for s, i in self.special.items()}
        return [b"".join(special[p] if i % 2 else b"".join([known[w] for w in p]) for i, p in enumerate(ps)) for ps in cut]

    def decode(self, packed: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(packed).cast("I")]).decode("utf-8", "replace")


def encode(
    docs: DataFrame, vocabulary_path: str, text: str = "text", step: int = 2000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` and the columns ``keep`` for every row of ``docs``.

    ``ids`` are packed as little-endian unsigned 32-bit integers, ``decoded`` is the text decoded from them. Added
    tokens in a text become their own ids. Null is an empty text; an empty text has no tokens. Rows are handled ``step``
    at a time whatever their length, so memory is that of ``step`` texts and ``CACHE_WORDS`` encodings. Equal rows give
    equal rows; other columns are not read; an empty table gives an empty result.
    """
    spark, kept = docs.sparkSession, ("doc_id", *keep)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # size of the vocabulary, not of the data

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                packed = encoder.encode([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[1:],
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array(packed, pa.binary()),
                        pa.array([encoder.decode(p) for p in packed], pa.string()),
                    ],
                    names=[*kept, "n_tokens", "ids", "decoded"],
                )

    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(text, *kept).mapInArrow(encoded, f"{types}n_tokens long, ids binary, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
