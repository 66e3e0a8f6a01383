"""Exact top-k search with vector-approximation files.

The approximation file is a table of its own, written once: a vector's cells, one byte a component between its least
and its greatest component. A query's scan reads the cells alone; cell corner and cell width bound its inner product
with each vector from both sides. A block of cells hands on the vectors whose upper bound reaches the block's kth lower
bound; over all blocks, the kth lower bound of a query decides which vectors survive. Exact vectors are then read by
number, in the order of the better bound: the k first ones of a query, and after these only those whose bound reaches
the kth exact score, so that the result is certain.

Of equal vectors only the k + 1 smallest ids, and of one id k rows, can be among a query's k best (ties go to the smaller
id), so further copies are left out before the scan and a large group of copies doesn't survive as a whole.

A vector that is null, empty, or holds a null or non-finite component takes no part, nor does a row without id. Only
vectors of equal length are compared. Candidates are all rows but those with the query's own id; repeated rows are
candidates each. Fewer than k candidates: all of them. A component beyond 1e150 counts as 1e150; a score that fits no
long is the nearest one that does, and such scores tie. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import materialize

LARGEST = 1e150
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
BOUNDS = "query_id long, probe long, rid long, vec_id long, low double, high double"


def quantised(df: DataFrame, scale: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double, of the vectors that take part; and the columns to keep."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def whole(x):
        y = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(scale) * x.cast("double")))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite).select(
        F.col("vec_id").cast("long"), F.transform("embedding", whole).alias("v"), *keep
    )


def cells_of(vectors: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (bytes), lowest corner and cell width of each vector."""
    low = vectors.min(axis=1)
    width = np.exp2(np.ceil(np.log2(np.maximum((vectors.max(axis=1) - low + 1) / (1 << bits), 1.0))))
    cells = np.clip(np.floor((vectors - low[:, None]) / width[:, None]), 0, (1 << bits) - 1)
    return cells.astype(np.uint8), low, width


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, from the cells alone."""
    corner = (queries @ cells.astype(np.float64).T) * width + queries.sum(axis=1, keepdims=True) * low
    # what rounding can do, and nothing where sums stay exact
    size = np.abs(queries).sum(axis=1, keepdims=True) * (np.abs(low) + (cells.max(axis=1, initial=0) + 2) * width)
    stray = np.where(size < EXACT, 0.0, size * (queries.shape[1] + 8) * 2.0**-51)
    below = np.minimum(queries, 0).sum(axis=1, keepdims=True) * (width - 1)
    above = np.maximum(queries, 0).sum(axis=1, keepdims=True) * (width - 1)
    return tuple(np.clip(x, -(2.0**63), 2.0**63) for x in (corner + below - stray, corner + above + stray))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def _cells(vectors: DataFrame, bits: int) -> DataFrame:
    """rid, vec_id, dim, low, width, cells."""

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                cells, low, width = cells_of(_matrix(part.column(2)), bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.full(len(cells), d, np.int32)), pa.array(low), pa.array(width), pa.array([c.tobytes() for c in cells], pa.binary())],
                    ["rid", "vec_id", "dim", "low", "width", "cells"],
                )

    return vectors.select("rid", "vec_id", "v").mapInArrow(approximate, "rid long, vec_id long, dim int, low double, width double, cells binary")


def _scan(queries: DataFrame, cells: DataFrame, k: int, vector_block: int, query_block: int) -> DataFrame:
    """BOUNDS of what a block of cells can't rule out for a query."""
    v_blocks, q_blocks = max(1, -(-cells.count() // vector_block)), max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    left = queries.select(F.size("v").alias("dim"), deal(q_blocks).alias("qb"), "vec_id", "rid", "v").withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    right = cells.withColumn("vb", deal(v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)] + [[np.empty(0)] for _ in range(2)]
        if q.num_rows and v.num_rows:
            queries = _matrix(q.column("v"))
            stored = np.frombuffer(b"".join(v.column("cells").to_pylist()), np.uint8).reshape(v.num_rows, -1)
            low, width, ids, rid, query_id, probe = (t.column(c).to_numpy() for t, c in ((v, "low"), (v, "width"), (v, "vec_id"), (v, "rid"), (q, "vec_id"), (q, "rid")))
            for at in range(0, len(queries), 64):
                below, above = bounds(queries[at : at + 64], stored, low, width)
                own = query_id[at : at + 64, None] == ids[None, :]
                below[own] = above[own] = -np.inf
                certain = np.partition(below, -k, axis=1)[:, -k, None] if len(ids) >= k else np.full((len(below), 1), -np.inf)
                row, column = np.nonzero((above >= certain) & ~own)
                for x, y in zip(out, (query_id[at + row], probe[at + row], rid[column], ids[column], below[row, column], above[row, column]), strict=True):
                    x.append(y)
        return pa.table(dict(zip(("query_id", "probe", "rid", "vec_id", "low", "high"), map(np.concatenate, out), strict=True)))

    return left.groupBy("dim", "qb", "vb").cogroup(right.groupBy("dim", "qb", "vb")).applyInArrow(search, BOUNDS)


def _scored(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, probe, rid, vec_id) with their exact scores."""
    longest = (1 << 63) - 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (s.values.to_numpy(zero_copy_only=False) for s in (a, b))
                if np.abs(x).max() * np.abs(y).max() * len(x) < EXACT:
                    scores.append(int(x @ y))
                else:
                    scores.append(max(-longest - 1, min(longest, sum(int(i) * int(j) for i, j in zip(x.tolist(), y.tolist(), strict=True)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.int64())], ["query_id", "probe", "rid", "vec_id", "score"])

    full = pairs.join(vectors.select("rid", F.col("v").alias("a")), "rid").join(queries.select(F.col("rid").alias("probe"), F.col("v").alias("b")), "probe")
    return full.select("query_id", "probe", "rid", "vec_id", "a", "b").mapInArrow(multiply, "query_id long, probe long, rid long, vec_id long, score long")


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """rid, vec_id, v: the rows that can be among a query's k best, numbered."""
    keys = [F.xxhash64("v").alias("__h1"), F.xxhash64(F.lit(1), "v").alias("__h2")]
    same = Window.partitionBy("__h1", "__h2")
    rows = vectors.select("vec_id", "v", *keys)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__h1", "__h2", "vec_id").orderBy(F.lit(0)))).filter(F.col("__n") <= k)
    rows = rows.withColumn("__d", F.dense_rank().over(same.orderBy("vec_id"))).filter(F.col("__d") <= k + 1)
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, cell_bits: int = 8, vector_block: int = 16384, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score over quantised() vectors and queries (both: vec_id, v). cell_bits: 8 at most."""
    rows = materialize(candidates(vectors, k), "topk-vectors")
    asked = materialize(queries.dropDuplicates(["vec_id", "v"]).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "topk-queries")
    cells = materialize(_cells(rows, cell_bits), "topk-cells")
    near = materialize(_scan(asked, cells, k, vector_block, query_block), "topk-bounds")

    def kth(df: DataFrame, column: str) -> DataFrame:
        """probe, at_least: the kth best of the column; null if there are fewer."""
        best = df.select("probe", column, F.row_number().over(Window.partitionBy("probe").orderBy(F.desc(column))).alias("__n")).filter(F.col("__n") <= k)
        return best.groupBy("probe").agg(F.max(F.when(F.col("__n") == k, F.col(column))).alias("at_least"))

    reached = F.coalesce(F.col("high") >= F.col("at_least"), F.lit(True))
    living = near.join(kth(near, "low"), "probe").filter(reached).drop("at_least")
    order = Window.partitionBy("probe").orderBy(F.desc("high"), "vec_id", "rid")
    living = materialize(living.withColumn("turn", F.row_number().over(order)), "topk-living")
    first = materialize(_scored(living.filter(F.col("turn") <= k), rows, asked), "topk-first")
    later = living.filter(F.col("turn") > k).join(kth(first, "score"), "probe").filter(reached)
    scores = first.unionByName(_scored(later, rows, asked))
    best = Window.partitionBy("query_id", "probe").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
