"""Mixing sources to target weights with soft membership.

A classifier trained on a labelled table (multinomial naive Bayes over hashed words, softmax of the mean log likelihood
a word, with a scale and biases that are fitted across halves of the sample) predicts each document's domain posteriors. Rates
then minimise the squared distance between the domains' expected tokens, the sum of rate * tokens * posterior, and their
targets, subject to rate >= `least` (0 or more) and, so that a rare domain isn't repeated without end, rate <= `most`
(REPEATS); what targets then lack is told (`missing`). Every projected-gradient step moves a document by its own posteriors
times the domains' residuals, scaled by the inverse of the Gram matrix of the documents above the bound, so all that the driver sees and sends
is one small vector a step; a document's rate is the fold of these vectors over its posteriors, and no state is kept.

The classifier takes at most `per_class` labelled documents of a domain, chosen by a hash of doc_id. All else covers
all rows. Tokens are words between white space.

Of several texts of a labelled doc_id the least is learned. Null or blank text: no tokens, the domains' prior shares as posteriors. Null labels are left out. With no labels at
all there is one domain, 0. Repeated rows: each its own. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ledgerline.llm.common import held, materialize, unit_hash

BUCKETS = 1 << 16
#: How often a document may be repeated.
REPEATS = 16.0


@dataclass
class Classifier:
    domains: list[int]
    table: np.ndarray  # buckets x domains: log likelihoods
    scale: float
    bias: np.ndarray
    prior: np.ndarray


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class _Rows(dict):
    def __init__(self, limit: int = 1 << 18):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        b = _bucket(word)
        if len(word) <= 64:  # what is remembered is bounded in bytes too
            if len(self) >= self.limit:
                self.clear()
            self[word] = b
        return b


def mean_likelihoods(text: str | None, table: np.ndarray) -> tuple[int, np.ndarray]:
    words = text.split() if text else []
    if not words:
        return 0, np.zeros(table.shape[1])
    at = np.fromiter(map(held("mixing", _Rows).__getitem__, words), np.int64, len(words))
    return len(words), table[at].mean(axis=0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[int], sizes: dict[int, int], smooth: float = 0.5, steps: int = 60) -> Classifier:
    domains = sorted(sizes)
    prior = np.array([sizes[d] for d in domains], float)
    prior /= prior.sum()
    y = np.array([domains.index(v) for v in labels], np.int64)
    counts = np.full((2, BUCKETS, len(domains)), smooth)
    half = np.arange(len(texts)) % 2
    for text, d, h in zip(texts, y.tolist(), half.tolist(), strict=True):
        np.add.at(counts[h, :, d], [_bucket(w) for w in text.split()], 1)
    logs = lambda c: np.log(c / c.sum(axis=0, keepdims=True))
    # each half is judged by the other's counts, so that scale and biases aren't fitted on the counted texts
    tables = [logs(counts[1]), logs(counts[0])]
    x = np.array([mean_likelihoods(t, tables[h])[1] for t, h in zip(texts, half.tolist(), strict=True)]).reshape(-1, len(domains))
    weight = prior[y] / np.maximum(1, np.bincount(y, minlength=len(domains)))[y] if len(y) else np.empty(0)
    goal = np.eye(len(domains))[y]
    best, scale, bias = np.inf, 0.0, np.log(prior)
    for trial in np.geomspace(0.5, 512, 11) if len(y) else ():
        b = np.log(prior)
        for _ in range(steps):
            p = softmax(trial * x + b)
            b = b - ((p - goal) * weight[:, None]).sum(axis=0)
        loss = -float((weight * np.log(np.maximum((softmax(trial * x + b) * goal).sum(axis=1), 1e-12))).sum())
        if loss < best - 1e-9:
            best, scale, bias = loss, float(trial), b
    return Classifier(domains, logs(counts.sum(axis=0)), scale, bias, prior)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = 1000) -> Classifier:
    given = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}  # one row a domain
    chosen = None
    for y in sorted(sizes):
        some = given.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return train([], [], {0: 1})
    # at most per_class ids a domain, so they are broadcast and the documents aren't shuffled
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    found = sorted((r for r in found if (r["text"] or "").split()), key=lambda r: r["doc_id"])
    return train([r["text"] for r in found], [r["y"] for r in found], sizes)


def posteriors(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """The kept columns, a hash of the text, tokens, posterior (array, in the order of the model's domains)."""
    table, scale, bias, prior = model.table.astype(np.float32), model.scale, model.bias, model.prior
    schema = docs.select(*keep).schema.add("__mark", "long").add("__tokens", "long").add("__posterior", ArrayType(DoubleType()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, found = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n, x = mean_likelihoods(text, table)
                tokens.append(n)
                found.append(softmax(scale * x + bias) if n else prior)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(tokens, pa.int64()), pa.array(found, pa.list_(pa.float64()))], [*keep, "__mark", "__tokens", "__posterior"]
            )

    return docs.select(*keep, F.xxhash64("text").alias("__mark"), F.col("text").alias("__text")).mapInArrow(judge, schema)


def copies(rate: Column) -> Column:
    """The rate rounded up or down by a hash of doc_id and text, so that its mean is the rate."""
    return F.floor(rate + unit_hash(F.lit(31), "doc_id", "__mark")).cast("int")


def rate(steps: list[list[float]], least: float, most: float = float("inf")) -> Column:
    """A document's rate after the steps: each subtracts posterior . step, never below `least` nor above `most`."""
    out = F.lit(min(most, max(1.0, least)))
    if not steps:
        return out
    dot = lambda s: F.aggregate(F.zip_with("__posterior", s, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.array(*[F.array(*map(F.lit, s)) for s in steps]), out, lambda r, s: F.least(F.lit(most), F.greatest(F.lit(least), r - dot(s))))


def solve(judged: DataFrame, n: int, weights: list[float] | None, least: float, total: float | None, at_most: int = 60, near: float = 1e-4, most: float = float("inf")) -> tuple[list[list[float]], list[float]]:
    """The steps, and how many tokens each domain lacks of its target after them (less than nothing: has beyond it). The steps bring the expected tokens of the domains as near to their targets as they get. judged: tokens,
    posterior. Targets that no rates reach (posteriors too soft for them) leave about the least-squares remainder: after
    `at_most` steps up to 15 % more of it in the tests.

    weights: the domains' target shares. total: tokens to reach; by default the tokens there are, or, if rates under 1
    aren't allowed, the least number for which no domain has to shrink.
    """
    p = [F.col("__posterior")[i] for i in range(n)]
    t = F.col("__tokens")

    def sums(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of the domains, and the Gram matrix of the documents whose rates can still fall."""
        rated = judged.withColumn("__rate", rate(steps, least, most))
        free = ((F.col("__rate") > least) & (F.col("__rate") < most)) if steps else F.lit(True)
        first = rated.agg(
            *[F.sum(t * F.col("__rate") * p[i]) for i in range(n)], *[F.sum(F.when(free, t * p[i] * p[j])) for i in range(n) for j in range(n)]
        ).first()
        found = np.array([x or 0.0 for x in first])
        return found[:n], found[n:].reshape(n, n)

    now, gram = sums([])
    if now.sum() <= 0:
        return [], [0.0] * n
    share = np.array(weights if weights else [1 / n] * n) / sum(weights or [1.0])
    if total is None:
        total = float((now / np.maximum(share, 1e-9)).max()) if least >= 1 else float(now.sum())
    target = share * total
    # a plain step of this size always gains; scaled steps gain more where the bound lets them
    plain = 1 / max(1e-30, float(np.linalg.eigvalsh(gram)[-1]))
    steps: list[list[float]] = []
    error, size, boost = now - target, 1.0, 1.0
    while len(steps) < at_most and np.abs(error).max() > near * total:
        if size >= 1 / 64:
            move = size * np.linalg.pinv(gram + 1e-9 * np.trace(gram) * np.eye(n)) @ error
        else:
            move = plain * boost * error
        reached, freed = sums([*steps, move.tolist()])
        moved = reached - target
        gain = 1 - np.linalg.norm(moved) / np.linalg.norm(error)
        if gain > 1e-6:
            steps, error, gram = [*steps, move.tolist()], moved, freed
            size, boost = (min(1.0, 2 * size), 1.0) if size >= 1 / 64 else (size, 4 * boost)
        elif size >= 1 / 64:
            size, boost = size / 4, 1.0
        elif boost > 1:
            boost = 1.0
        else:
            break
    return steps, (-error).tolist()


def mixed_rates(docs: DataFrame, labels: DataFrame, weights: list[float] | None = None, least: float = 0.0, column: str = "quality", most: float = REPEATS) -> DataFrame:
    """doc_id, tokens, posteriors (one array), rate, copies, missing (an array: the tokens that each domain lacks of its
    target, the same in every row): a row a row of docs."""
    model = fit(docs, labels, column)
    judged = materialize(posteriors(docs, model, "doc_id"), "mixing-posteriors")
    steps, missing = solve(judged, len(model.domains), weights, least, None, most=most)
    rated = judged.withColumn("rate", rate(steps, least, most))
    return rated.select(
        "doc_id", F.col("__tokens").alias("tokens"), F.col("__posterior").alias("posteriors"), "rate", copies(F.col("rate")).alias("copies"),
        F.array(*[F.lit(float(x)) for x in missing]).alias("missing"),
    )


def mixed(docs: DataFrame, labels: DataFrame, weights: list[float] | None = None, least: float = 1.0, column: str = "quality", most: float = REPEATS) -> DataFrame:
    """The rows of docs as often as their rates say. With least = 1 every row stays and rare domains are repeated, each
    document `most` times at most."""
    model = fit(docs, labels, column)
    judged = materialize(posteriors(docs, model, *docs.columns), "mixing-judged")
    steps, _ = solve(judged, len(model.domains), weights, least, None, most=most)
    return (
        judged.withColumn("__copies", copies(rate(steps, least, most)))
        .filter("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*docs.columns)
    )
