"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of m hashes, each of `rows` minhashes, are computed for a set; every pair of one hash from each
collection is a table key. So m * m tables cost 2 * m * rows minhashes, about a square root of what independent tables
would. A pair of similarity s misses all tables with probability 1 - (1 - (1 - s^rows)^m)^2.

1. Documents of one shingle set collapse to a node, the smallest doc_id of them.
2. In each bucket every node is paired with one centre, the node that meets most others over all tables: as many pairs
   as rows. Pairs are confirmed on the full shingle sets and give components.
3. Buckets in which several components remain are searched for the links that centres missed: small buckets by their
   pairs across components. The nodes of large ones are banded again with more minhashes a key, so that texts that only
   share a passage part: again small buckets are searched by pairs, and only what still falls together in large ones, in
   clusters cut into blocks that are compared as matrices inside a task, which hands out at most one link a row.
4. Components of all confirmed links.

doc_id is taken to identify a text. Null or blank text: empty set, linked with nothing. Null doc_id: linked with
nothing, component_id null, kept. Repeated rows share a node. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import shingles
from ledgerline.llm.common import materialize
from ledgerline.llm.components import components

#: Buckets of up to so many nodes are searched by pairs, larger ones by blocks of so many nodes.
PAIRS_UP_TO, BLOCK = 32, 512
#: Tables of the second banding; its minhashes a key are as many as miss a pair of the least similarity with this chance.
FINE_TABLES, FINE_MISS = 24, 1e-3
SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, u array<long>, v array<long>"


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(docs: DataFrame, side: int, rows: int, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (a 128-bit hash of the set), u, v (the two collections of `side` hashes)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(2 * side * rows, seed)
        for batch in batches:
            n, h1, h2, u, v = [], [], [], [], []
            for text in batch.column(1):
                values = shingles.shingle_set(text.as_py())
                raw = values.tobytes()
                n.append(len(values))
                h1.append(xxhash.xxh3_64_intdigest(raw))
                h2.append(xxhash.xxh3_64_intdigest(raw, seed=1))
                if len(values):
                    parts = shingles.min_hashes(values, by).reshape(2 * side, rows)
                    keys = np.array([xxhash.xxh3_64_intdigest(p.tobytes()) for p in parts], np.uint64).view(np.int64)
                    u.append(keys[:side])
                    v.append(keys[side:])
                else:
                    u.append(None)
                    v.append(None)
            signed64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), signed64(h1), signed64(h2), pa.array(u, pa.list_(pa.int64())), pa.array(v, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "h1", "h2", "u", "v"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(sign, SIGNED)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity. texts: node, text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, its_set = None, None
        for batch in batches:
            keep = []
            for a, b, left, right in zip(*(batch.column(i) for i in range(4)), strict=True):
                if (b := b.as_py()) != last:
                    last, its_set = b, shingles.shingle_set(right.as_py())
                keep.append(shingles.similar(shingles.shingle_set(left.as_py()), its_set, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def forest(sets: list[np.ndarray], group: np.ndarray, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Links between rows of different groups that join all rows reachable by links; at most one a row."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    renamed = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], renamed[code[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = int(shared.sum())
    for at in range(0, width, columns):
        lo, hi = np.searchsorted(code, (at, at + columns))
        grid = np.zeros((n, min(columns, width - at)), np.float32)
        grid[owner[lo:hi], code[lo:hi] - at] = 1
        both += grid @ grid.T
    common = both.astype(np.int64)
    linked = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (common > 0)
    root = {g: g for g in group.tolist()}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = top(int(group[i])), top(int(group[j]))
        if x != y:
            root[y] = x
            out.append((int(i), int(j)))
    return out


def _finer(nodes: DataFrame, texts: DataFrame, percent: int, seed: int = 12) -> DataFrame:
    """node, comp, key: FINE_TABLES keys a node."""
    rows = max(2, int(math.log(1 - FINE_MISS ** (1 / FINE_TABLES)) / math.log(percent / 100)))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(FINE_TABLES * rows, seed)
        for batch in batches:
            keys = [np.empty(0, np.uint64)]
            for text in batch.column(2):
                parts = shingles.min_hashes(shingles.shingle_set(text.as_py()), by).reshape(FINE_TABLES, rows)
                keys.append(np.array([xxhash.xxh3_64_intdigest(p.tobytes(), seed=t) for t, p in enumerate(parts)], np.uint64))
            row = pa.array(np.repeat(np.arange(batch.num_rows), FINE_TABLES))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(keys).view(np.int64))], ["node", "comp", "key"])

    return nodes.join(texts, "node").select("node", "comp", "text").mapInArrow(band, "node long, comp long, key long")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs a, b of different components in the buckets of rows (key, node, comp)."""
    x, y = (rows.select("key", F.col("node").alias(s), F.col("comp").alias(f"c{s}")) for s in "ab")
    return x.join(y, "key").filter("a < b AND ca <> cb").select("a", "b").distinct()


def _in_blocks(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links within clusters. nodes: node, comp, cluster."""
    sizes = nodes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    placed = nodes.join(sizes, "cluster").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cluster", F.least("p", "other").alias("i"), F.greatest("p", "other").alias("j"), "node", "comp"
    )

    def link(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        sets = [shingles.shingle_set(t.as_py()) for t in table.column("text")]
        found = forest(sets, np.unique(comp, return_inverse=True)[1], percent)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    return dealt.join(texts, "node").groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, side: int = 6, rows: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row a row of docs (doc_id, text)."""
    base = materialize(signed(docs, side, rows), "minhash-signed")
    named = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # written out, so that the join reads shuffles on both sides and a hot class can be split; so are `full` and `centres`
    classes = materialize(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "minhash-classes")
    members = materialize(
        base.join(classes, ["h1", "h2"], "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("node")).alias("node"),
            *[F.when((F.col("doc_id") == F.col("node")) & (F.col("n_shingles") > 0), F.col(c)).alias(c) for c in ("u", "v")],
        ),
        "minhash-members",
    )
    keys = (
        members.filter(F.col("u").isNotNull())
        .select("node", "v", F.posexplode("u").alias("i", "x"))
        .select("node", "i", "x", F.posexplode("v").alias("j", "y"))
        .select("node", F.xxhash64("i", "j", "x", "y").alias("key"))
    )
    full = materialize(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").drop("hi"), "minhash-full"
    )
    buckets = materialize(keys.join(full, "key"), "minhash-buckets")
    texts = materialize(
        docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text")).join(
            buckets.select("node").distinct(), "node", "left_semi"
        ),
        "minhash-texts",
    )
    met = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    best = F.max(F.struct("met", (-F.col("node")).alias("x")))["x"]
    centres = materialize(buckets.join(met, "node").groupBy("key").agg(best.alias("x")).select("key", (-F.col("x")).alias("centre")), "minhash-centres")
    stars = buckets.join(centres, "key").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = materialize(confirmed(stars, texts, percent), "minhash-links")
    labels = materialize(components(links), "minhash-labels")

    of = buckets.join(labels, "node", "left").select("key", "node", "n", "lo", F.coalesce("component", "node").alias("comp"))
    unresolved = of.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m")).filter("c0 <> c1 AND m > 2").select("key")
    rest = materialize(of.join(unresolved, "key"), "minhash-rest")
    few = rest.filter(F.col("n") <= PAIRS_UP_TO).join(centres, "key").filter("node <> centre")
    all_links = links.unionByName(confirmed(_across(few), texts, percent))
    many = rest.filter(F.col("n") > PAIRS_UP_TO)
    if not many.isEmpty():
        fine = materialize(_finer(many.select("node", "comp").distinct(), texts, percent), "minhash-fine")
        mixed = fine.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("node").alias("lo")).filter("c0 <> c1")
        met_again = materialize(fine.join(materialize(mixed.select("key", "n", "lo"), "minhash-mixed"), "key"), "minhash-again")
        all_links = all_links.unionByName(confirmed(_across(met_again.filter(F.col("n") <= PAIRS_UP_TO)), texts, percent))
        close = met_again.filter(F.col("n") > PAIRS_UP_TO)
        if not close.isEmpty():
            clusters = components(close.select(F.col("node").alias("a"), F.col("lo").alias("b")))
            nodes = close.select("node", "comp").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node")
            all_links = all_links.unionByName(_in_blocks(nodes, texts, percent))
    last = components(all_links)
    return (
        members.join(last, "node", "left")
        .withColumn("component_id", F.coalesce("component", "node"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
