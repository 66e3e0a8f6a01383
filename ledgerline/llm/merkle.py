"""Merkle manifest of a table: a tree of digests per lang, the subroots' own tree, and a proof for every row.

A leaf is the sha256 of a row's columns, each `-` if null, else its UTF-8 byte count, `:` and its value. Rows are put in
order by ranges of (lang, doc_id, leaf); `row_number` inside a range and the counts of the ranges before it are a leaf's
index, so no lang is sorted in one task. A tree is then built by levels: index divided by the fanout names the parent,
and the sorted digests of its children are hashed. `LEVELS` levels share a shuffle, as the nodes below one ancestor that
many levels up are one bounded array. On the way back each such array is joined with the siblings of its ancestor, so
a proof is put together from tables that shrink by fanout ** LEVELS each time, and only at the end is it as long as a
leaf's proof. Digests alone are shuffled, never texts.

Null lang: a tree of its own, the first one. Null doc_ids come first in their lang. Rows of equal doc_id and lang are
in the order of their leaves; rows equal in all five columns are leaves each, alike in all but their place. Null or empty
text, however long: as the rule says. Further columns take no part. A table of one lang has its subroot as the root, a
lang of one row its leaf as the subroot. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import discard, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that share a shuffle; an array has at most fanout ** LEVELS digests.
LEVELS = 6


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_of(columns: dict[str, Column]) -> Column:
    """The leaf of a row that has these values."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(F.concat(*[framed(columns[c]) for c in COLUMNS]))


def indexed(df: DataFrame, by: str, order: list[str], label: str) -> DataFrame:
    """df with `idx` (0-based place in its group `by`, null a group too, along `order`) and `n` (the group's size), written."""
    ranged = df.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id())
    placed = materialize(ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range", by).orderBy(*order))), f"{label}-ranges")
    before = Window.partitionBy(by).orderBy("__range")
    counts = placed.groupBy("__range", by).agg(F.count(F.lit(1)).alias("__rows"))  # as many as there are ranges and groups
    counts = counts.withColumn("__before", F.sum("__rows").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    counts = counts.withColumn("n", F.sum("__rows").over(Window.partitionBy(by))).withColumnRenamed(by, "__group").withColumnRenamed("__range", "__of")
    here = (placed["__range"] == counts["__of"]) & placed[by].eqNullSafe(counts["__group"])
    out = materialize(placed.join(counts, here).withColumn("idx", F.coalesce("__before", F.lit(0)) + F.col("__at") - 1).select(*df.columns, "idx", "n"), label)
    discard(placed)
    return out


def _hashed_up(first: Column, n: Column, fanout: int, levels: int) -> Column:
    """[first, the level above it, ...]: up to `levels` more, as long as the whole level of n nodes has several."""

    def above(found: Column, level: Column) -> Column:
        last = F.element_at(found, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / fanout).cast("int"))
        up = F.transform(runs, lambda run: digest(F.array_join(F.slice(last, run * fanout + 1, F.lit(fanout)), "")))
        return F.when(n > F.pow(F.lit(float(fanout)), level - 1), F.concat(found, F.array(up))).otherwise(found)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(first), above)


def _siblings(levels: Column, at: Column, fanout: int) -> Column:
    """What stands before and after the node, joined, on each level that was hashed above the node at place `at`."""

    def on(level: Column) -> Column:
        nodes = F.element_at(levels, level)
        place = F.floor(at / F.pow(F.lit(float(fanout)), level - 1)).cast("int")
        start = place - place % fanout
        return F.struct(
            F.array_join(F.slice(nodes, start + 1, place - start), "").alias("before"),
            F.array_join(F.slice(nodes, place + 2, start + fanout - place - 1), "").alias("after"),
        )

    none = F.array().cast("array<struct<before:string,after:string>>")
    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(1), F.size(levels) - 1), on)).otherwise(none)


def grown(nodes: DataFrame, by: str, fanout: int, label: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (by, idx, n, digest, and what is kept): (paths: by, kept, path; roots: by, root)."""
    wide = fanout**LEVELS
    passes: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    level, kept = nodes, keep
    while True:
        parts = level.groupBy(by, F.floor(F.col("idx") / wide).cast("long").alias("parent"), "n").agg(
            F.sort_array(F.collect_list(F.struct(*dict.fromkeys(("idx", "digest", *kept))))).alias("below")  # at most `wide` of them
        )
        passes.append(materialize(parts.withColumn("levels", _hashed_up(F.col("below.digest"), F.col("n"), fanout, LEVELS)), f"{label}-{len(passes)}"))
        top = F.element_at(F.element_at("levels", -1), 1)
        level, kept = passes[-1].select(by, F.col("parent").alias("idx"), F.ceil(F.col("n") / wide).cast("long").alias("n"), top.alias("digest")), ()
        if most <= wide:
            break
        most = -(-most // wide)
    roots = materialize(level.select(by, F.col("digest").alias("root")), f"{label}-roots")
    above = None
    for number, table in reversed(list(enumerate(passes))):
        extra = keep if not number else ()
        table = table.select(by, "parent", "below", "levels")
        if above is not None:
            up = above.select(F.col(by).alias("__by"), F.col("idx").alias("__idx"), F.col("path").alias("__up"))
            table = table.join(up, table[by].eqNullSafe(up["__by"]) & (table["parent"] == up["__idx"]))
        else:
            table = table.withColumn("__up", F.array().cast("array<struct<before:string,after:string>>"))
        # a node's path is worked out beside its array, which is then not copied for every node
        path = lambda x: F.concat(_siblings(F.col("levels"), (x["idx"] % wide).cast("int"), fanout), F.col("__up"))
        nodes_of = F.transform("below", lambda x: F.struct(x["idx"].alias("idx"), *[x[c].alias(c) for c in extra], path(x).alias("path")))  # noqa: B023
        above = table.select(by, F.inline(nodes_of))
        above = materialize(above, f"{label}-paths-{number}") if number else above
    return above, roots


def manifest(docs: DataFrame, fanout: int = 2, tampered_one_in: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: of every row its place in the manifest, and
    whether the row, tampered where `tampered_one_in` divides the crc32 of its doc_id, still folds up to the root."""
    own = {c: F.col(c) for c in COLUMNS}
    changed = own | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_one_in == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", "lang", leaf_of(own).alias("digest"), F.when(hit, leaf_of(changed)).alias("tampered"))
    leaves = materialize(leaves, "merkle-digests")  # ranges are drawn from them before they are dealt: texts are read once
    nodes = indexed(leaves, "lang", ["doc_id", "digest"], "merkle-leaves")
    discard(leaves)
    paths, subroots = grown(nodes, "lang", fanout, "merkle", ("doc_id", "digest", "tampered"))
    tops = indexed(subroots.select(F.lit(0).alias("all"), "lang", F.col("root").alias("digest")), "all", ["lang"], "merkle-subroots")
    ends, roots = grown(tops, "all", fanout, "merkle-top", ("lang", "digest"))
    ends = ends.join(roots, "all").select(F.col("lang").alias("__lang"), F.col("digest").alias("subroot"), "root", F.col("path").alias("__end"))
    ends = materialize(ends, "merkle-ends")
    rows = paths.join(ends, paths["lang"].eqNullSafe(ends["__lang"])).withColumn("__whole", F.concat("path", "__end"))
    proof = digest(F.array_join(F.transform("__whole", lambda x: F.concat(x["before"], x["after"])), ""))
    folded = F.aggregate("__whole", F.coalesce("tampered", "digest"), lambda node, x: digest(F.concat(x["before"], node, x["after"])))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
