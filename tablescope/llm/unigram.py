"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton lists the pieces of the vocabulary that end at each place of a word, the longest first. The
recursion carries the best score up to each place and the number of pieces that reach it, nothing else. Of equal scores
the piece that starts first wins, and a letter without a piece of its own may be an unknown one, ten below the least
score; both as the reference tokenizer does it. Words are independent of each other and each is counted once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the unknown piece scores below the least one (fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words a task keeps counts of.
CACHE_WORDS = 1_000_000

WORD = re.compile(f"{SPACE}[^{SPACE}]*")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file in order of their ids; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        self.single = frozenset(p for p in known if len(p) == 1)
        self.by_bytes = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.counts: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Pieces on the best path through a word; neighbouring unknown letters are one piece, or each of its bytes one."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if len(self.counts) > CACHE_WORDS:
            self.counts.clear()
        size, single = len(word), self.single
        none = float("-inf")
        best, pieces, unknown = [none] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        best[0] = 0.0
        matches = self.automaton.iter(word)
        last, (length, score) = next(matches, (size, (0, 0.0)))
        for end in range(1, size + 1):
            top, count, odd = none, 0, False
            while last == end - 1:
                start = end - length
                if best[start] + score > top:
                    top, count = best[start] + score, pieces[start] + 1
                last, (length, score) = next(matches, (size, (0, 0.0)))
            letter = word[end - 1]
            if letter not in single and best[end - 1] + self.unknown > top:
                top, odd = best[end - 1] + self.unknown, True
                if self.by_bytes:
                    count = pieces[end - 1] + len(letter.encode())
                else:
                    count = pieces[end - 1] + (not unknown[end - 1])
            best[end], pieces[end], unknown[end] = top, count, odd
        self.counts[word] = pieces[size]
        return pieces[size]

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if not marked.startswith(SPACE):
            marked = SPACE + marked
        return sum(map(self.of_word, WORD.findall(marked)))


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs``, other columns are not read.

    Null and empty texts have no tokens. A text is cut before each space, which counts to the word after it. Memory is
    that of a batch and of ``CACHE_WORDS`` counts. Equal rows give equal rows; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # size of the vocabulary

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value, byte_fallback)
        for batch in batches:
            counts = [counter.of_text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(counted, f"doc_id {key_type}, n_tokens long")
