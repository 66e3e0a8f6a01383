"""Hard negatives for labelled vectors by a pivot table.

A vector of length at most M gains a component that brings it to length M; divided by M it lies on the unit sphere, and
so does an anchor divided by its own length, with 0 as its further component. Their inner product then falls as their
Euclidean distance grows. M is the next power of two, so a few huge vectors don't make the bounds of the others useless.
The distances of all vectors to a few pivots, far-apart vectors of a bounded sample, are stored once. By the triangle
inequality an anchor's distance to a vector lies between the largest difference and the smallest sum of their distances
to a pivot, which brackets the score; only vectors whose bracket meets the wanted scores are checked exactly.

Vectors lie in blocks by length, nearest pivot and distance to it, of about `block` rows. A search has two rounds: the
anchor's own block gives a first kth best score, then the least and greatest stored distances of every block tell
which blocks an anchor has to visit at all; an anchor and a block meet in one task, in parts of bounded size, and hand on
k rows at most. Positives are searched among rows of the anchor's label, then the negatives of each positive among the
others, between the given shares of its score.

Of rows that have one vector and label only the k + 1 of least vec_id can be an answer (ties go to the smaller vec_id),
so further copies are left out before the table is made. Rows that repeat in vec_id, label and vector count once. A row
with a null vec_id, label or vector, or with a null or non-finite component, takes no part; vectors are compared with
those of equal length; an anchor's own vec_id is never an answer. Fewer rows than asked for: all of them. A component
beyond 1e150 counts as 1e150; a score that fits no long is the nearest one that does, and such scores tie. A
positive with a negative score has no negatives, since no score lies between the shares. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import discard, materialize
from ledgerline.llm.vector_search import EXACT, _matrix

#: Rows of the sample that pivots are chosen from, and the number of pivots.
SAMPLE, PIVOTS = 2048, 24
#: Distances on the unit sphere are surer than this.
STRAY = 1e-9
LEAST, MOST = -(1 << 63), (1 << 63) - 1

Pivots = dict[int, np.ndarray]


def on_sphere(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors with their further component, on the unit sphere; the exponents of their M."""
    norm = np.sqrt((v * v).sum(axis=1))
    shell = np.where(norm > 0, np.floor(np.log2(np.maximum(norm, 1e-300))) + 1, 0).astype(np.int32)
    y = v * np.exp2(-shell.astype(float))[:, None]
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))]), shell


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(points), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((points - p) ** 2).sum(axis=1))
    return out


def far_apart(points: np.ndarray, number: int) -> np.ndarray:
    """Each pivot is the point that is farthest from those chosen before it."""
    chosen, near = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < number and near.max() > 1e-12:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def fit_pivots(rows: DataFrame, sample: int = SAMPLE, number: int = PIVOTS) -> Pivots:
    """Pivots by number of components, from at most `sample` rows chosen by a hash."""
    found = rows.select("vec_id", "v").orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id", "v").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in found:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    return {d: far_apart(on_sphere(np.array(v, float))[0], number) for d, v in by_dim.items()}


def brackets(ends: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores: of anchors at the distances `ends` (a row each) from the pivots, with vectors whose own distances
    are between low and high (a row each), where scale is length times M (anchors x vectors)."""
    near, far = np.zeros(scale.shape), np.full(scale.shape, 2.0)
    for j in range(ends.shape[1]):
        e = ends[:, j, None]
        np.maximum(near, np.maximum(low[None, :, j] - e, e - high[None, :, j]), out=near)
        np.minimum(far, high[None, :, j] + e, out=far)
    near, far = np.maximum(0, near - STRAY), far + STRAY
    stray = scale * 1e-12
    return tuple(np.clip(x, float(LEAST), float(MOST)) for x in (scale * (1 - far * far / 2) - stray, scale * (1 - near * near / 2) + stray))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as longs."""
    if not len(a):
        return np.empty(0, np.int64)
    sums = np.einsum("ij,ij->i", a, b)
    size = np.abs(a).max(axis=1) * np.abs(b).max(axis=1) * a.shape[1]
    out = np.where(size < EXACT, sums, 0).astype(np.int64)
    for i in np.flatnonzero(size >= EXACT).tolist():
        out[i] = max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True))))
    return out


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows (rid, vec_id, label, v) with dim, shell, nearest pivot, ring of the distance to it, all distances."""
    names = ["rid", "vec_id", "label", "v", "dim", "shell", "near", "ring", "dist"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                y, shell = on_sphere(_matrix(part.column("v")))
                dist = distances(y, pivots.get(d, np.empty((0, d + 1))))
                near = dist.argmin(axis=1) if dist.shape[1] else np.zeros(len(y), int)
                ring = (dist[np.arange(len(y)), near] * 8).astype(np.int32) if dist.shape[1] else np.zeros(len(y), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * dist.shape[1], pa.int32()), pa.array(dist.ravel()))
                of = [pa.array(np.full(len(y), d, np.int32)), pa.array(shell), pa.array(near.astype(np.int32)), pa.array(ring), lists]
                yield pa.RecordBatch.from_arrays([*part.columns, *of], names)

    return rows.select("rid", "vec_id", "label", "v").mapInArrow(place, "rid long, vec_id long, label int, v array<double>, dim int, shell int, near int, ring int, dist array<double>")


KEY = ["dim", "shell", "near", "ring"]


class Table:
    """The pivot table in its blocks, and searches in it."""

    def __init__(self, rows: DataFrame, k: int, block: int = 4096, asked: int = 1024, pivots: Pivots | None = None):
        hashes = [F.xxhash64("v").alias("__h1"), F.xxhash64(F.lit(1), "v").alias("__h2")]
        same = Window.partitionBy("__h1", "__h2", "label").orderBy("vec_id")
        once = rows.select("vec_id", "label", "v", *hashes).dropDuplicates(["vec_id", "label", "__h1", "__h2"])
        once = once.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1)
        self.pivots = fit_pivots(rows) if pivots is None else pivots
        numbered = materialize(once.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v"), "pivots-rows")
        placed = materialize(pivot_table(numbered, self.pivots), "pivots-placed")
        self.chunks = materialize(placed.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks")), "pivots-chunks")
        self.k, self.asked = k, asked
        self.vectors = materialize(self.in_block(placed).select("block", "rid", "vec_id", "label", "dim", "shell", "dist", "v"), "pivots-table")
        ends = [f(F.get("dist", F.lit(j))) for f in (F.min, F.max) for j in range(max(map(len, self.pivots.values()), default=0))]
        half = len(ends) // 2
        summary = self.vectors.groupBy("block", "dim", "shell").agg(F.array(*ends[:half]).alias("least"), F.array(*ends[half:]).alias("most"))
        self.blocks = materialize(summary, "pivots-blocks")
        discard(numbered, placed)

    def in_block(self, placed: DataFrame) -> DataFrame:
        chunk = F.pmod(F.xxhash64("rid"), F.coalesce("chunks", F.lit(1)))
        return placed.join(self.chunks, KEY, "left").withColumn("block", F.concat_ws(":", *KEY, chunk))

    def search(self, anchors: DataFrame, wants: DataFrame, same: bool) -> DataFrame:
        """request, rank, rid, vec_id, score: of each request the k best rows whose scores are between low and high.

        anchors, written: anchor, part (the task that serves it), vec_id, label, v, dim, home (its block). wants, written:
        request, anchor, low, high, a few an anchor. same: whether rows of the anchor's label are searched or the others.
        """
        first = self._best(self._visit(anchors.select("anchor", F.col("home").alias("block")), anchors, wants, same))
        kth = materialize(first.groupBy("request").agg(F.max(F.when(F.col("rank") == self.k, F.col("score"))).alias("kth")), "pivots-kth")
        closer = materialize(wants.join(kth, "request", "left").withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).drop("kth"), "pivots-closer")
        pairs = materialize(self._near_blocks(anchors, closer), "pivots-pairs")
        out = materialize(self._best(self._visit(pairs, anchors, closer, same)), "pivots-found")
        discard(kth, closer, pairs)
        return out

    def _best(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id", "rid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def _near_blocks(self, anchors: DataFrame, wants: DataFrame, at_once: int = 4096) -> DataFrame:
        """anchor, block: where a bracket of the block's own distances meets what the anchor wants."""
        deals = max(1, -(-self.blocks.count() // at_once))
        span = wants.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        left = anchors.select("anchor", "part", "v", "dim").join(span, "anchor").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        parts = anchors.select(F.col("dim").alias("dim"), F.col("part").alias("part")).distinct()  # columns of their own beside the left side's
        right = self.blocks.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(deals)).cast("int")).join(parts, "dim")
        pivots = self.pivots

        def meet(q: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, list]] = []
            if q.num_rows and b.num_rows:
                v, dim = _matrix(q.column("v")), q.column("dim")[0].as_py()
                ends, length = _ends(v, pivots, dim)
                least, most = (_matrix(b.column(c))[:, : ends.shape[1]] for c in ("least", "most"))
                size = np.exp2(b.column("shell").to_numpy().astype(float))
                low, high = (q.column(c).to_numpy() for c in ("low", "high"))
                names, anchor = b.column("block").to_numpy(zero_copy_only=False), q.column("anchor").to_numpy()
                for at in range(0, len(v), 64):
                    here = slice(at, at + 64)
                    below, above = brackets(ends[here], least, most, length[here, None] * size[None, :])
                    row, column = np.nonzero((above >= low[here, None]) & (below <= high[here, None]))
                    out.append((anchor[at + row], names[column]))
            none = [np.empty(0, np.int64)]
            return pa.table({"anchor": np.concatenate(none + [x for x, _ in out]), "block": pa.array([n for _, x in out for n in x], pa.string())})

        return left.groupBy("dim", "part", "deal").cogroup(right.groupBy("dim", "part", "deal")).applyInArrow(meet, "anchor long, block string")

    def _visit(self, pairs: DataFrame, anchors: DataFrame, wants: DataFrame, same: bool) -> DataFrame:
        """request, rid, vec_id, score: the k best in each block that an anchor visits."""
        lists = wants.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("request", "low", "high"))).alias("wants"))
        left = pairs.join(anchors.join(lists, "anchor"), "anchor")
        needed = left.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct()
        right = self.vectors.join(needed, "block")
        pivots, k = self.pivots, self.k

        def search(q: pa.Table, b: pa.Table) -> pa.Table:
            none = np.empty(0, np.int64)
            out = [(none, none, none)]
            if q.num_rows and b.num_rows:
                dim, v, stored = b.column("dim")[0].as_py(), _matrix(b.column("v")), _matrix(b.column("dist"))
                size = float(2.0 ** b.column("shell")[0].as_py())
                ids, labels = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
                asked, own, label = _matrix(q.column("v")), q.column("vec_id").to_numpy(), q.column("label").to_numpy()
                ends, length = _ends(asked, pivots, dim)
                lists = q.column("wants").combine_chunks()
                of = np.repeat(np.arange(len(own)), np.diff(lists.offsets.to_numpy()))
                request, low, high = (lists.flatten().field(c).to_numpy() for c in ("request", "low", "high"))
                least, most = (f.reduceat(x, np.searchsorted(of, np.arange(len(own)))) for f, x in ((np.minimum, low), (np.maximum, high)))
                exact = np.abs(asked).max(initial=0) * np.abs(v).max(initial=0) * dim < EXACT
                for at in range(0, len(own), 32):
                    here = slice(at, at + 32)
                    below, above = brackets(ends[here], stored, stored, np.broadcast_to(length[here, None] * size, (len(own[here]), len(v))))
                    may = (ids[None, :] != own[here, None]) & ((labels[None, :] == label[here, None]) == same) & (above >= least[here, None]) & (below <= most[here, None])
                    row, column = np.nonzero(may)
                    if exact and 16 * len(row) > may.size:  # many survive: all scores at once
                        score = (asked[here] @ v.T)[row, column].astype(np.int64)
                    else:
                        score = np.concatenate([none] + [exact_scores(asked[at + row[i : i + 16384]], v[column[i : i + 16384]]) for i in range(0, len(row), 16384)])
                    edges = np.searchsorted(row, np.arange(len(own[here]) + 1))
                    for n in range(*np.searchsorted(of, [at, at + len(own[here])])):
                        mine = slice(edges[of[n] - at], edges[of[n] - at + 1])
                        fit = np.flatnonzero((score[mine] >= low[n]) & (score[mine] <= high[n]))
                        if len(fit) > k:
                            among = score[mine][fit]
                            fit = fit[among >= np.partition(among, -k)[-k]]
                        fit = fit[np.lexsort((ids[column[mine][fit]], ~score[mine][fit]))[:k]]  # ~ turns the order of longs round
                        out.append((np.full(len(fit), request[n]), column[mine][fit], score[mine][fit]))
            request, column, score = map(np.concatenate, zip(*out, strict=True))
            return pa.table({"request": request, "rid": b.column("rid").to_numpy()[column] if len(column) else none, "vec_id": b.column("vec_id").to_numpy()[column] if len(column) else none, "score": score})

        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "request long, rid long, vec_id long, score long")


def _ends(v: np.ndarray, pivots: Pivots, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' distances to the pivots, and lengths."""
    length = np.sqrt((v * v).sum(axis=1))
    unit = np.hstack([v / np.where(length > 0, length, 1)[:, None], np.zeros((len(v), 1))])
    return distances(unit, pivots.get(dim, np.empty((0, dim + 1)))), length


def mined(rows: DataFrame, anchors: DataFrame, k: int = 5, low_percent: int = 80, block: int = 4096, asked: int = 1024, pivots: Pivots | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors have vec_id, label and v (whole numbers as doubles); k positives an anchor, k negatives a positive,
    with scores from low_percent of the positive's up to it.
    """
    table = Table(rows, k, block, asked, pivots)
    one = anchors.select("vec_id", "label", "v", F.xxhash64("v").alias("__h")).dropDuplicates(["vec_id", "label", "__h"]).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v")
    placed = materialize(table.in_block(pivot_table(materialize(one, "pivots-anchors"), table.pivots)).select("rid", "vec_id", "label", "v", "dim", F.col("block").alias("home")), "pivots-asked")
    parts = max(1, -(-placed.count() // asked))
    placed = placed.withColumnRenamed("rid", "anchor").withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int"))
    positives = table.search(placed, placed.select(F.col("anchor").alias("request"), F.col("anchor").alias("anchor"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")), True)
    low = F.ceil(F.col("score").cast("decimal(20,0)") * low_percent / 100).cast("long")
    wanted = positives.select(F.col("request").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high"), low.alias("low"))
    wanted = materialize(wanted.filter("low <= high").withColumn("request", F.monotonically_increasing_id()), "pivots-wanted")
    negatives = table.search(placed, wanted.drop("positive_id"), False)
    who = wanted.join(placed.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("request", "anchor_id", "positive_id", F.col("high").alias("positive_score"))
    return negatives.join(who, "request").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame, one_in: int = 7, labels: int = 10) -> DataFrame:
    """Where one_in divides vec_id, the label is the next one."""
    return vectors.filter(F.col("label").isNotNull()).withColumn("label", F.when(F.col("vec_id") % one_in == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")).cast("int"))
