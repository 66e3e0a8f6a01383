"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of itself and its character n-grams, hashed into buckets; a text is the average of
its words; a linear softmax reads the two classes off it. Vectors and softmax are trained together. Misspellings that
training never saw share n-gram vectors with words that it did. Scoring needs one number a bucket (its vector times
the difference of the class weights), so the model that is sent out is a small table.

Training takes at most `per_class` labelled documents of each class, chosen by a hash of doc_id and weighted to the
class sizes of all labelled rows; it uses their whole texts. Everything else covers all rows.

Texts without words (null, empty, blank) get the score of the softmax's bias alone. With labels of one class only or
none, the score is that class or 0. Null labels and labels without a document are left out; a doc_id that is labelled
more than once counts as toxic if any of its labels does; of several texts of a labelled doc_id the least is learned.
Repeated rows are scored each. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held

BUCKETS = 1 << 17
EDGE = ".,;:!?\"'()[]{}<>|*#-_/\\"


@dataclass
class Model:
    bias: float
    value: np.ndarray  # of each bucket


def subwords(token: str, low: int = 3, high: int = 5, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and its character n-grams, with marks at both ends."""
    word = (token.strip(EDGE) or token).lower()
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


def train(
    texts: list[str], labels: np.ndarray, weights: np.ndarray, dim: int = 4, steps: int = 50, rate: float = 0.05, least: int = 2, smooth: float = 60.0, penalty: float = 3.0, seed: int = 1
) -> Model:
    """Momentum descent on vectors, class weights and bias of the weighted cross-entropy, from a random start.

    Subwords of under `least` words of documents are left out. A vector's step is its gradient divided by the spread
    that its subword has over documents (plus that of `smooth` single uses), whatever their labels: a step is then as
    long as the gradient stands out from chance, so common subwords don't drown the rare ones nor the other way round.
    Steps shorten to nothing. The loss has a penalty on the lengths of vectors (`penalty` times the first gradients'
    mean size, applied by shrinking after each step), so vectors that the loss doesn't need end at zero.
    """
    if len(set(labels.tolist())) < 2:
        return Model(0.0 if not len(labels) else (30.0 if labels[0] else -30.0), np.zeros(BUCKETS, np.float32))
    # typed arrays: lists of numbers would take several times the memory
    index: dict[str, int] = {}
    doc, word, share, parts, bucket = array("i"), array("i"), array("d"), array("i"), array("i")
    for i, text in enumerate(texts):
        counts = Counter(text.split())
        total = sum(counts.values())
        for w, n in counts.items():
            if w not in index:
                index[w] = len(index)
                grams = subwords(w)
                parts.append(len(grams))
                bucket.extend(grams)
            doc.append(i)
            word.append(index[w])
            share.append(n / total)
    words_seen = len(index)
    del index
    doc, word, share, sizes = (np.array(x) for x in (doc, word, share, parts))
    bucket = np.array(bucket)
    met = np.bincount(bucket, np.repeat(np.bincount(word, minlength=words_seen), sizes), BUCKETS)
    keep = met[bucket] >= least
    held_parts = np.add.reduceat(keep, np.cumsum(sizes) - sizes)  # of each word
    bucket = bucket[keep]
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used))
    bucket = number[bucket]
    del keep, met
    weights = weights / weights.sum()
    goal = np.eye(2)[labels]

    def spread(of_words: np.ndarray) -> np.ndarray:
        """What the words have, summed up by subword."""
        return np.bincount(bucket, np.repeat(of_words, held_parts), len(used))

    def texts_from(vectors: np.ndarray) -> np.ndarray:
        out, sums = np.empty((len(texts), dim)), np.zeros(len(bucket) + 1)
        ends = np.cumsum(held_parts)
        for d in range(dim):
            np.cumsum(vectors[bucket, d], out=sums[1:])
            words = (sums[ends] - sums[ends - held_parts]) / sizes
            out[:, d] = np.bincount(doc, words[word] * share, len(texts))
        return out

    single = np.bincount(word, (share * weights[doc]) ** 2, words_seen) / sizes**2
    noise = spread(single)
    scale = 1 / np.sqrt(noise + smooth * noise.sum() / max(1, int(np.bincount(word, minlength=words_seen) @ held_parts)))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1, (len(used), dim)) * scale[:, None]
    size = np.sqrt((texts_from(vectors) ** 2).mean())
    scale /= size
    vectors *= 0.1 / size
    softmax, bias = rng.normal(0, dim**-0.5, (2, dim)), np.log(np.maximum(weights @ goal, 1e-9))
    moving = [np.zeros_like(p) for p in (vectors, softmax, bias)]
    first = 0.0
    level = [0.0, 0.0, 0.0]  # mean squares of the three gradients
    for step in range(steps):
        x = texts_from(vectors)
        logits = x @ softmax.T + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - goal) * weights[:, None]
        back = error @ softmax
        of_words = [np.bincount(word, back[doc, d] * share, words_seen) / sizes for d in range(dim)]
        gradients = (np.stack([spread(x) for x in of_words], axis=1) * scale[:, None], error.T @ x, error.sum(axis=0))
        for i, (value, gradient, m) in enumerate(zip((vectors, softmax, bias), gradients, moving, strict=True)):
            m += 0.2 * (gradient - m)
            level[i] += 0.05 * (float((gradient**2).mean()) - level[i])
            length = rate * (1 - step / steps) / math.sqrt(level[i] / (1 - 0.95 ** (step + 1)) + 1e-300)
            move = length * m / (1 - 0.8 ** (step + 1))
            value -= move if i else move * scale[:, None]
            if not i:
                first = first or penalty * math.sqrt((gradient**2).mean())
                norm = np.sqrt((vectors**2).sum(axis=1)) / scale
                vectors *= np.maximum(0, 1 - length * first / np.maximum(norm, 1e-12))[:, None]
    value = np.zeros(BUCKETS, np.float32)
    value[used] = vectors @ (softmax[1] - softmax[0])
    return Model(float(bias[1] - bias[0]), value)


class _WordValue(dict):
    def __init__(self, value: np.ndarray, limit: int = 1 << 19):
        self.value, self.limit = value, limit

    def __missing__(self, token: str) -> float:
        x = float(self.value[subwords(token)].mean())
        if len(token) <= 64:  # what is remembered is bounded in bytes too
            if len(self) >= self.limit:
                self.clear()
            self[token] = x
        return x


def text_score(text: str | None, bias: float, words: _WordValue) -> float:
    tokens = text.split() if text else []
    logit = bias + (sum(map(words.__getitem__, tokens)) / len(tokens) if tokens else 0.0)
    return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = 1500) -> Model:
    """A model from the labelled rows that are not held out."""
    given = (
        labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        some = given.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * per_class ids, so they are broadcast and the documents aren't shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted((r for r in rows if (r["text"] or "").split()), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.int64)
    found = Counter(y.tolist())
    weights = np.array([sizes[v] / found[v] for v in y.tolist()])
    return train([r["text"] for r in rows], y, weights)


def scored(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The kept columns of docs, and the score under the name."""
    bias, value = model.bias, model.value
    mark = f"toxicity {bias}:{zlib.crc32(value.tobytes())}"
    schema = docs.select(*keep).schema.add(name, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(mark, lambda: _WordValue(value))
        for batch in batches:
            found = [text_score(t, bias, words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*keep, name])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored(docs, fit(docs, labels), "doc_id").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score under the limit."""
    return scored(docs, fit(docs, labels), *docs.columns, name="__toxicity").filter(F.col("__toxicity") < limit).select(*docs.columns)
