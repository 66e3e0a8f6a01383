"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of `span` bytes that covers it also starts anywhere else. Sorting all suffixes of the corpus
in one place isn't possible, so shards are formed by content:

1. Each string of `span` bytes is assigned to its anchor, the least-hashed GRAM bytes inside it (the last of equal
   ones). The strings of an anchor start at consecutive places, so an anchor and its strings are one short context;
   equal strings have equal anchors. Anchors are numbers only; no text moves.
2. Anchors whose hash occurs once can't hold a repeated string. The rest are fetched from their texts.
3. Equal contexts count as one with its number of occurrences: from two on, all its strings repeat.
4. Where an anchor has several contexts, these go to the shard of the anchor: its suffix array, common prefixes and
   runs of at least `span` show which strings of different contexts are equal. An anchor with more bytes than a shard
   may hold is cut into parts; each part has its own suffix array and hands on the digest of each of its distinct
   strings. Digests are dealt out by value, and the sorted digests of the parts are merged by binary search, so an
   anchor costs its strings once, however many parts it has.
5. What goes from a text depends on the text alone, so copies are worked out once.

Texts are UTF-8 bytes; null counts as empty; under `span` bytes nothing goes. Repeated rows are occurrences each.
doc_id is not used to tell rows apart and may be null. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import suffix_array
from ledgerline.llm.common import discard, held, materialize, text_of

GRAM = 32
#: Starts worked on at a time, and bytes of contexts in a shard or a part of a hot anchor.
STRETCH, SHARD_BYTES = 1 << 18, 1 << 20
ANCHORS = "t1 long, t2 long, s int, n int, h long"
#: Digests of a hot anchor that are merged in one task.
DIGESTS = 1 << 17
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)
_KEY = ("t1", "t2")


def _keys(body: Column) -> list[Column]:
    """What a text is known by: 64 bits of one hash, 32 of another, and its length."""
    second = F.shiftleft(F.xxhash64(F.lit(1), body), 32).bitwiseOR(F.length(body).cast("long"))
    return [F.xxhash64(body).alias("t1"), second.alias("t2")]


def anchor_stretches(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all strings of `span` bytes: place of the anchor, first start, number of starts."""
    places, starts, counts = [], [], []
    reach = span - GRAM + 1
    for lo in range(0, len(data) - span + 1, STRETCH):
        n = min(STRETCH, len(data) - span + 1 - lo)
        x = _TABLE[data[lo : lo + n + span - 1]]
        power, width = 0x9E3779B97F4A7C15, 1
        while width < GRAM:
            x = x[:-width] * np.uint64(power) + x[width:]
            power, width = power * power % (1 << 64), 2 * width
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x & ~_PLACE) | (_PLACE - np.arange(len(x), dtype=np.uint64))
        width = 1
        while 2 * width <= reach:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        x = np.minimum(x[:n], x[reach - width : reach - width + n])
        place = (_PLACE - (x & _PLACE)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        places.append(place[first] + lo)
        starts.append(first + lo)
        counts.append(np.diff(np.append(first, n)))
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(places), join(starts), join(counts)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def anchors(texts: DataFrame, span: int) -> DataFrame:
    """t1, t2, s, n, h of texts (t1, t2, text as binary): the contexts of each text and their anchors' hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats", dict)  # nothing is remembered here, but what other operators left in the worker goes
        for batch in batches:
            rows, s, n, h = [], [], [], []
            for row, text in enumerate(batch.column(2)):
                view = memoryview(text.as_buffer())
                if len(view) < span:
                    continue
                place, start, count = anchor_stretches(np.frombuffer(view, np.uint8), span)
                rows.append(np.full(len(place), row))
                s.append(start)
                n.append(count)
                h += [xxhash.xxh3_64_intdigest(view[p : p + GRAM]) for p in place.tolist()]
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(s).astype(np.int32)), pa.array(np.concatenate(n).astype(np.int32)), _signed(h)],
                    ["t1", "t2", "s", "n", "h"],
                )

    return texts.mapInArrow(scan, ANCHORS)


def _contexts(candidates: DataFrame, span: int, with_bytes: bool) -> DataFrame:
    """A row an entry of `places`: its context's hash c, and its bytes if asked for."""
    schema = "t1 long, t2 long, s int, n int, h long, c long, copies long" + ", body binary" * with_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats", dict)
        for batch in batches:
            places = batch.column(3)
            sizes = np.diff(places.offsets.to_numpy())
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            flat = places.flatten()
            s, n = flat.field("s"), flat.field("n")
            text = batch.column(2)
            views = [memoryview(x.as_buffer()) for x in text]
            bodies = [views[r][a : a + b + span - 1] for r, a, b in zip(row.to_pylist(), s.to_pylist(), n.to_pylist(), strict=True)]
            columns = [batch.column(0).take(row), batch.column(1).take(row), s, n, flat.field("h"), _signed([xxhash.xxh3_64_intdigest(x) for x in bodies]), flat.field("copies")]
            names = ["t1", "t2", "s", "n", "h", "c", "copies"]
            if with_bytes:
                columns.append(pa.array([bytes(x) for x in bodies], pa.binary()))
                names.append("body")
            yield pa.RecordBatch.from_arrays(columns, names)

    return candidates.select("t1", "t2", "text", "places").mapInArrow(cut, schema)


def _shard_repeats(bodies: DataFrame, span: int) -> DataFrame:
    """h, c, n, lo, hi: the starts lo to hi of a context whose strings another context (or place in it) has too.

    bodies: h, c, n, body; one row a distinct context.
    """
    # written out, so that the join reads shuffles on both sides and a hot anchor can be split
    sizes = materialize(bodies.groupBy("h").agg(F.sum(F.length("body")).alias("bytes")), "repeat-sizes")
    total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    shards = max(1, -(-(total or 0) // SHARD_BYTES))
    split = F.col("bytes") > SHARD_BYTES
    parts = F.ceil(F.col("bytes") / SHARD_BYTES).cast("int")
    dealt = bodies.join(sizes, "h").select(
        "h", "c", "n", "body", split.alias("hot"), F.when(split, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))).alias("shard"),
        F.when(split, F.pmod(F.xxhash64("c", "n"), parts).cast("int")).otherwise(0).alias("part"),
    )

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        """The repeats of one shard or part; of a part also the digest d1, d2 of each distinct string."""
        held("repeats", dict)
        n = table.column("n").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(table.column("body").to_pylist()), np.uint8)
        begins = np.cumsum(n + span - 1) - (n + span - 1)
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + n, -1)
        hits, single = suffix_array.repeated(data, np.cumsum(edge[:-1], dtype=np.int8) > 0, span)
        steps = np.flatnonzero(np.diff(np.concatenate([[0], hits.astype(np.int8), [0]])))
        first, last = steps[::2], steps[1::2] - 1
        digests: list[pa.Array] = [pa.nulls(len(first), pa.int64())] * 2
        if key[0].as_py():
            view = memoryview(data)
            first, last = np.concatenate([first, single]), np.concatenate([last, single])
            digests = [pa.concat_arrays([nulls, _signed([xxhash.xxh3_64_intdigest(view[p : p + span], seed=i) for p in single.tolist()])]) for i, nulls in enumerate(digests)]
        of = np.searchsorted(begins, first, "right") - 1
        at, small = pa.array(of), lambda x: pa.array((x - begins[of]).astype(np.int32))
        part = pa.array(np.full(len(of), key[2].as_py(), np.int32))
        return pa.table({c: table.column(c).take(at) for c in ("h", "c", "n")} | {"lo": small(first), "hi": small(last), "part": part, "d1": digests[0], "d2": digests[1]})

    found = dealt.groupBy("hot", "shard", "part").applyInArrow(sort, "h long, c long, n int, lo int, hi int, part int, d1 long, d2 long")
    own = ["h", "c", "n", "lo", "hi"]
    if (most or 0) <= SHARD_BYTES:
        return found.select(*own)
    found = materialize(found, "repeat-parts")
    strings = found.filter("d1 IS NOT NULL")
    counts = materialize(strings.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / DIGESTS).alias("buckets")), "repeat-digests")
    placed = strings.join(counts, "h").withColumn("bucket", F.pmod("d1", "buckets"))

    def merge(table: pa.Table) -> pa.Table:
        keys = np.empty(table.num_rows, "V16")
        keys.view(">u8").reshape(-1, 2)[:, 0], keys.view(">u8").reshape(-1, 2)[:, 1] = (table.column(c).to_numpy().view(np.uint64) for c in ("d1", "d2"))
        keys, part = keys.view("S16"), table.column("part").to_numpy()
        order = np.lexsort((keys, part))
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        met = suffix_array.in_several(np.split(keys[order], cuts))
        return table.select(own).take(pa.array(order[np.concatenate(met)]))

    return found.filter("d1 IS NULL").select(*own).unionByName(placed.select(*own, "part", "d1", "d2", "bucket").groupBy("h", "bucket").applyInArrow(merge, "h long, c long, n int, lo int, hi int"))


def removals(docs: DataFrame, span: int = 200) -> DataFrame:
    """t1, t2 (the key of a text), n_removed, n_spans, kept (binary), kept_sha256.

    Only texts that lose something have a row, and each distinct text has one.
    """
    body = text_of().cast("binary")
    texts = docs.select(*_keys(body), body.alias("text"))
    found = materialize(anchors(texts, span), "repeat-anchors")
    # written out, so that the joins below read shuffles on both sides and a hot anchor can be split
    often = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h"), "repeat-often")
    places = (
        found.join(often, "h")
        .groupBy(*_KEY, "s")  # not by h too: the join's partitioning would do for that, and a hot anchor stay in one task
        .agg(F.first("n").alias("n"), F.first("h").alias("h"), F.count(F.lit(1)).alias("copies"))
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("s", "n", "h", "copies")).alias("places"))
    )
    single = texts.filter(F.length("text") >= span).dropDuplicates(list(_KEY))
    candidates = materialize(single.join(places, list(_KEY)), "repeat-candidates")
    discard(found, often)
    contexts = _contexts(candidates, span, with_bytes=False)
    counted = materialize(
        contexts.groupBy("h", "c", "n").agg(F.sum("copies").alias("k"), F.min(F.struct("t1", "t2", "s")).alias("at")), "repeat-contexts"
    )
    several = materialize(counted.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h"), "repeat-several")
    wanted = counted.join(several, "h").groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(
        F.collect_list(F.struct(F.col("at.s").alias("s"), "n", "h", F.lit(1).cast("long").alias("copies"))).alias("places")
    )
    bodies = materialize(
        _contexts(candidates.drop("places").join(wanted, list(_KEY)), span, with_bytes=True).select("h", "c", "n", "body"), "repeat-bodies"
    )
    whole = counted.filter("k > 1").select("h", "c", "n", F.lit(0).alias("lo"), (F.col("n") - 1).cast("int").alias("hi"))
    known = whole.unionByName(_shard_repeats(bodies, span))
    spans = (
        contexts.join(known, ["h", "c", "n"])
        .groupBy(*_KEY)
        .agg(F.collect_set(F.struct((F.col("s") + F.col("lo")).alias("a"), (F.col("s") + F.col("hi") + span).alias("b"))).alias("spans"))
    )

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("repeats", dict)
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, parts in zip(batch.column(2), batch.column(3), strict=True):
                data = np.frombuffer(memoryview(text.as_buffer()), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                flat = parts.values
                np.add.at(edge, flat.field("a").to_numpy(), 1)
                np.add.at(edge, flat.field("b").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                ["t1", "t2", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return candidates.drop("places").join(spans, list(_KEY)).select("t1", "t2", "text", "spans").mapInArrow(
        strike, "t1 long, t2 long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )


def repeat_report(docs: DataFrame, span: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row a row of docs."""
    body = text_of().cast("binary")
    gone = removals(docs, span).drop("kept")
    rows = docs.select("doc_id", *_keys(body), F.length(body).cast("long").alias("nb"), F.sha2(body, 256).alias("own"))
    return rows.join(gone, list(_KEY), "left").select(
        "doc_id", F.col("nb").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """docs with the repeated strings gone from text (broken characters at the cuts too); rows left without a word go."""
    body = text_of().cast("binary")
    gone = removals(docs, span).select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("kept").alias("__kept"))
    whole = F.expr("try_validate_utf8(string(__kept))")
    clean = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(
        F.coalesce(whole, F.regexp_replace(F.expr("make_valid_utf8(string(__kept))"), "\ufffd", ""))
    )
    out = docs.select("*", *[k.alias(f"__{name}") for k, name in zip(_keys(body), _KEY, strict=True)]).join(gone, ["__t1", "__t2"], "left")
    emptied = F.col("__kept").isNotNull() & ~clean.rlike(r"\S")
    return out.filter(~emptied).withColumn("text", clean).select(*docs.columns)
