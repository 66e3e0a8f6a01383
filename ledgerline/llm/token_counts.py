"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at each place of a word. Dynamic
programming carries the best score and the number of pieces on it; ties go to the piece that starts first (a later
candidate has to score strictly more). A character that no piece of one character covers can also be unknown, at the
least score less 10; unknown characters in a row are one piece. Words begin at spaces, as with a metaspace marker. Equal words are counted once in a worker. A word
begins with its spaces; texts go through whole if the vocabulary has pieces that span words, or none for a space.

With `by_bytes` (a model with byte pieces) unknown characters count as their UTF-8 bytes. The scores are those of the
vocabulary's file: of piece_bpe_32k.model, a byte-pair model, they are merge ranks that unigram rules are applied to, so
counts differ from that model's own.

Null and empty texts have 0 tokens. Repeated rows are counted each. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held

MARK = "▁"
PENALTY = 10.0
WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def has_bytes(path: str) -> bool:
    """Whether a sentencepiece model spells unknown characters in bytes."""
    model = _model(path)
    return any(model.is_byte(i) for i in range(model.get_piece_size()))


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model with their scores."""
    model = _model(path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter(dict):
    """Pieces of a marked word."""

    def __init__(self, vocabulary: list[tuple[str, float]], by_bytes: bool = False, limit: int = 1 << 19):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - PENALTY
        self.empty, self.limit, self.by_bytes = not vocabulary, limit, by_bytes
        self.whole = MARK not in self.single or any(MARK in p.lstrip(MARK) for p, _ in vocabulary)

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in () if self.empty else self.automaton.iter(word):
            ends[end].append(match)
        score, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            top, found = None, 0
            for length, value in sorted(ends[end], reverse=True):  # the earliest start first
                x = value + score[end + 1 - length]
                if top is None or x > top:
                    top, found = x, count[end + 1 - length] + 1
            unknown = False
            if word[end] not in self.single:
                x = self.unknown + score[end]
                if top is None or x > top:
                    more = len(word[end].encode("utf-8", "surrogatepass")) if self.by_bytes else not open_unknown[end]
                    top, found, unknown = x, count[end] + more, True
            score[end + 1], count[end + 1], open_unknown[end + 1] = top, found, unknown
        return score[n], count[n]

    def __missing__(self, word: str) -> int:
        n = self.best(word)[1]
        if len(word) <= 64:  # what is remembered is bounded in bytes too
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        return self[text] if self.whole else sum(map(self.__getitem__, WORD.findall(text)))


def counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"counts {path}", lambda: Counter(pieces_of(path), has_bytes(path)))
        for batch in batches:
            n = [counter.of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text"
    ).mapInArrow(count, "doc_id long, n_chars long, n_tokens long")
