"""Packing of documents into training sequences by non-negative least squares on the histogram of lengths.

A document is the ids of its text and an end id. It is cut into whole windows and a rest, so every piece has 1 to
`window` ids, and only the histogram of piece lengths (at most `window` numbers) reaches the driver. There, shallow
combinations of lengths that fill a window exactly are enumerated, their repeat counts are solved against the
histogram by non-negative least squares, rounded, and kept within the histogram; what remains is packed greedily,
largest first, with a look at exact fills by one or two more lengths. Both work on counts, so the plan has a bounded
number of slots whatever the number of documents. Each piece then finds its slot from its place among pieces of its
length.

Null text: the end id alone. Repeated rows: packed as often as they occur. Empty table: no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import dense_positions, held, materialize, unit_hash

WINDOW = 4096
END = 2
#: Lengths, by frequency, that combinations of three and of four draw from freely (the last one is given by the sum).
FREE3, FREE4 = 160, 40
#: Lengths, by frequency, that are taken several times, and those that one more length is drawn from beside them.
REPEATED, BESIDE = 120, 24
#: Chunks of text whose ids a worker remembers.
CACHE = 3 << 17


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as they are, the others as the letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: The rules of tokenizer files for which the short ways below hold.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Longer chunks are not remembered, so that what a worker remembers is bounded in bytes too.
SHORT = 64


class TokenBytes(dict):
    """Little-endian 32-bit ids of chunks without white space, for tokenizers of RULES; they never join ids across white
    space. Texts of any other tokenizer go to it whole.

    A chunk that ends in full stops or commas after a letter is cut there, as the tokenizer cuts it; capitals are
    lowered, as it lowers them; and a word of letters in normal form goes straight to the merges. The chunks seen last
    are remembered in two generations.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer

        self.path, self.limit, self.old = path, limit, {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        rules = json.loads(self.tokenizer.to_str())
        self.known = all(rules[k] == v for k, v in RULES.items()) and rules["model"]["type"] == "BPE"

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def work_out(self, chunk: str) -> bytes:
        base = chunk.rstrip(".,")
        if base != chunk and base and base[-1].isalpha():
            return self[base] + self[chunk[len(base) :]]
        low = chunk.lower()
        if unicodedata.is_normalized("NFC", chunk):
            if low != chunk and max(chunk) < "\u0130":
                return self[low]
            if low == chunk and chunk.isalpha():
                word = chunk.encode().decode("latin-1").translate(self.letters)
                return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return self.encode(chunk)

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.work_out(chunk)
        if len(chunk) > SHORT:
            return found
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        if not self.known or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def token_bytes(path: str) -> TokenBytes:
    return held(f"tokens {path}", lambda: TokenBytes(path))


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: documents cut at multiples of the window."""
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = tokens.of(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    rows.append(row)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + window)]))
                    total.append(n)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, long)), pa.array(start, long), pa.array(length, long), pa.array(crc, long), pa.array(total, long)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


Combination = tuple[tuple[int, int], ...]  # lengths and how often each, the longest first


def combinations(histogram: np.ndarray, window: int) -> list[Combination]:
    """Up to four lengths of the histogram that fill the window, or one of the most frequent as often as there are
    pieces of it, and one or two others."""
    there = np.flatnonzero(histogram[1:]) + 1
    present = set(there.tolist())
    common = there[np.argsort(-histogram[there], kind="stable")].tolist()
    out: set[Combination] = set()

    def add(*lengths: int, repeated: tuple[int, int] = (0, 0)) -> None:
        times = {a: lengths.count(a) for a in lengths}
        if repeated[1]:
            times[repeated[0]] = times.get(repeated[0], 0) + repeated[1]
        out.add(tuple(sorted(times.items(), reverse=True)))

    for a in present:
        if window % a == 0:
            add(repeated=(a, window // a))
        if 2 * a < window and window - a in present:
            add(window - a, a)
    for i, a in enumerate(common[:FREE3]):
        for b in common[i:FREE3]:
            if window - a - b in present:
                add(a, b, window - a - b)
    for i, a in enumerate(common[:FREE4]):
        for j, b in enumerate(common[i:FREE4], i):
            for c in common[j:FREE4]:
                if window - a - b - c in present:
                    add(a, b, c, window - a - b - c)
    for a in common[:REPEATED]:
        for times in range(2, min(window // a, int(histogram[a])) + 1):
            gap = window - times * a
            if gap in present:
                add(gap, repeated=(a, times))
            for b in common[:BESIDE]:
                if gap > b and gap - b in present:
                    add(b, gap - b, repeated=(a, times))
    return sorted(out, reverse=True)


def non_negative_counts(sets: list[Combination], histogram: np.ndarray, steps: int = 60) -> np.ndarray:
    """x >= 0 that brings the sum of x times each combination near the histogram, in least squares weighted by how many
    combinations use a length: projected gradient steps, scaled by row and column sums."""
    column = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    row, times = np.array([pair for s in sets for pair in s], np.int32).T.copy()
    per_row = np.maximum(np.bincount(row, times, len(histogram)), 1)
    per_column = np.bincount(column, times, len(sets))
    x = np.zeros(len(sets))
    for _ in range(steps):
        gap = (histogram - np.bincount(row, x[column] * times, len(histogram))) / per_row
        x = np.maximum(0, x + np.bincount(column, gap[row] * times, len(sets)) / per_column)
    return x


def greedy(rest: np.ndarray, window: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Combinations and repeats that use up the counts."""
    rest = rest.copy()
    top = window
    while True:
        while top and not rest[top]:
            top -= 1
        if not top:
            return
        left = rest[: window + 1].copy()
        left[top] -= 1
        taken, gap = [top], window - top
        while gap:
            if left[gap]:
                pick = [gap]
            else:
                half = np.arange(1, gap // 2 + 1)
                fits = (left[half] > 0) & (left[gap - half] > (half == gap - half))
                if fits.any():
                    b = int(half[fits][-1])
                    pick = [gap - b, b]
                else:
                    there = np.flatnonzero(left[1:gap])
                    if not len(there):
                        break
                    b = int(there[-1]) + 1
                    pick = [b] * min(int(left[b]), gap // b)
            for b in pick:
                left[b] -= 1
            taken += pick
            gap -= sum(pick)
        lengths, times = np.unique(taken, return_counts=True)
        repeats = int((rest[lengths] // times).min())
        rest[lengths] -= repeats * times
        yield tuple(taken), repeats


def plan(histogram: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, lo, hi, sequence, offset): pieces lo to hi - 1 of a length go to sequences from `sequence` on.

    The counts are solved and rounded again over what is left, until no combination fits; the rest is packed greedily.
    """
    rest = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    placed = 1
    while placed and (sets := combinations(rest, window)):
        x = non_negative_counts(sets, rest.astype(float))
        placed, carried = 0, 0.5
        for i in (order := np.argsort(-x, kind="stable"))[x[order] > 0]:
            # what rounding takes from one count goes on to the next
            carried += x[i]
            n = min(int(carried), *(int(rest[a]) // times for a, times in sets[i]))
            if n > 0:
                carried -= n
                for a, times in sets[i]:
                    rest[a] -= n * times
                chosen.append((tuple(a for a, times in sets[i] for _ in range(times)), n))
                placed += n
            carried = min(carried, 2.0)
    chosen += greedy(rest, window)
    used = np.zeros(window + 1, np.int64)
    slots, sequence = [], 0
    for lengths, n in chosen:
        offset = 0
        for a in lengths:
            slots.append((a, int(used[a]), int(used[a]) + n, sequence, offset))
            used[a] += n
            offset += a
        sequence += n
    return slots


def packed(docs: DataFrame, path: str, window: int = WINDOW, seed: int = 3) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    cut = materialize(pieces(docs, path, window), "packing-pieces")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `window` rows
        histogram[length] = n
    slots = docs.sparkSession.createDataFrame(plan(histogram, window), "length long, lo long, hi long, base long, offset long")
    placed = dense_positions(
        cut.withColumn("mix", unit_hash(F.lit(seed), "doc_id", "start")), ["length"], ["mix", "doc_id", "start", "ids_crc32"], F.col("mix"), "place"
    )
    # the slots are bounded by the plan (window lengths, a bounded set of combinations), so they are broadcast
    return placed.join(
        F.broadcast(slots), (placed["length"] == slots["length"]) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
    ).select(
        "doc_id", "start", placed["length"], "ids_crc32", "doc_tokens", (F.col("base") + F.col("place") - F.col("lo")).alias("sequence_id"), "offset"
    )
