"""SimHash, exact top-k and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import sharding, simhash, vector_search
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.fixtures import awkward, empty


def edited(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text or ""))
    out = []
    for i, r in enumerate(rows):
        text, following = r.text or "", rows[(i + 1) % len(rows)].text or ""
        k = len(text) // 4
        out.append((r.doc_id, text, text[: len(text) - k] + following[:k], following))
    return out


def prints(spark, texts):
    """Fingerprints by hand: the same term hashes, votes counted one bit at a time."""
    texts = sorted(set(texts))
    terms = simhash.terms_of(spark.createDataFrame([(t,) for t in texts], "t string"), "t", ["t"]).collect()
    votes = defaultdict(lambda: [0] * 64)
    for r in terms:
        if r.term is not None:
            for b in range(64):
                votes[r.t][b] += 1 if r.term >> b & 1 else -1
    return {t: sum(1 << b for b in range(64) if votes[t][b] > 0) for t in texts}


def test_report_equals_brute_force(spark):
    docs = awkward(spark).filter("n_chars < 100000")
    want = edited(docs.collect())
    of = prints(spark, [x for _, t, e, f in want for x in (t, e, f)])
    like = lambda a, b: 1 - bin(of[a] ^ of[b]).count("1") / 64
    expected = sorted((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{of[t]:016x}", f"{of[e]:016x}", like(t, e), like(t, f)) for i, t, e, f in want)
    assert sorted(tuple(r)[:7] for r in simhash.simhash_report(docs).collect()) == expected


def test_terms_are_padded_runs_of_five_words(spark):
    n = lambda t: simhash.terms_of(spark.createDataFrame([(t,)], "t string"), "t", []).filter("term IS NOT NULL").count()
    assert [n(t) for t in ("", "a", "a b c d e", "a b c d e f")] == [0, 5, 9, 10]


def test_one_row_and_empty_table(spark):
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    row = simhash.simhash_report(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert simhash.simhash_report(empty(spark)).collect() == []


def test_near_fingerprints_equals_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:10]:
        for _ in range(30):
            v = b
            for bit in r.sample(range(64), r.randint(1, 5)):
                v ^= 1 << bit
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed * 2], "fingerprint_bits long")
    for chunk in (256, 3):
        got = {x.fingerprint_bits: x.near_distinct for x in simhash.near_fingerprints(df, chunk=chunk).collect()}
        want = {}
        for v, s in zip(values, signed):
            n = sum(1 for w in values if w != v and bin(v ^ w).count("1") <= 3)
            if n:
                want[s] = n
        assert got == want


def brute_top(rows, k=5):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(b) == len(a))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 2048), (7, 3)])
def test_top_k_equals_brute_force(spark, blocks):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8).astype(np.float32)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [float("nan")] * 8), (203, [None] * 8), (250, [float("inf")] * 8), (None, [1.0] * 8), (300, [1.0, 2.0]), (301, [1.0, 2.5]), (350, [0.0] * 8), rows[7], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    vectors = vector_search.quantised(df)
    got = vector_search.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), vector_block=blocks[0], query_block=blocks[1])
    assert {tuple(x) for x in got.collect()} == brute_top(rows)


def test_cell_bounds_hold():
    r = np.random.default_rng(1)
    q, v = r.integers(-300, 300, (20, 16)).astype(float), r.integers(-300, 300, (50, 16)).astype(float)
    v[3] *= 1e6
    v[4, 2] = 3e17
    for bits in (1, 4, 8):
        low, high = vector_search.bounds(q, *vector_search.cells_of(v, bits))
        true = np.clip(q @ v.T, -(2.0**63), 2.0**63)
        assert (low <= true + 1e-9 * np.abs(true)).all() and (true - 1e-9 * np.abs(true) <= high).all()


def test_huge_components_and_large_groups_of_copies(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 1, 6)]) for i in range(60)]
    rows += [(100 + i, [0.5] * 6) for i in range(200)] + [(50, [0.5] * 6)] * 9 + [(900, [1e17] + [0.0] * 5), (901, [-1e300] * 6), (950, [2.0**40] * 6)]
    vectors = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vector_search.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), vector_block=16, query_block=2)
    most = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    whole = [(i, [math.floor(256 * max(-1e150, min(1e150, x))) if abs(x) < 1e150 else int(math.copysign(1e150, x)) for x in v]) for i, v in rows]
    want = Counter()
    for q, a in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        scores = sorted((-most(sum(x * y for x, y in zip(a, b))), i) for i, b in whole if i != q)[:5]
        want.update((q, n, i, -s) for n, (s, i) in enumerate(scores, 1))
    assert Counter(tuple(x) for x in got.collect()) == want


def test_top_k_of_nothing(spark):
    v = vector_search.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert vector_search.exact_top_k(v, v).collect() == []


def check_shards(rows, got, shards=8):
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == Counter((g.doc_id, g.size, g.text_crc32) for g in got)
    homes = defaultdict(set)
    for s in range(shards):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    of = {g.doc_id: g.shard for g in got}
    for r in rows:
        if r.text is not None:
            homes[r.text].add(of[r.doc_id])
    return [sum(g.size for g in got if g.shard == s) for s in range(shards)], homes


def test_shards_of_the_sample_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, got = docs.collect(), sharding.shard_rows(docs).collect()
    sizes, homes = check_shards(rows, got)
    assert max(sizes) - min(sizes) <= 2 * max(len(r.text.encode()) for r in rows)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_with_awkward_rows(spark):
    docs = awkward(spark)
    sizes, _ = check_shards(docs.collect(), sharding.shard_rows(docs).collect())
    assert sharding.shard_rows(empty(spark)).collect() == []
    hot = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i:06d}", f"s{i % 2}") for i in range(3000)], "doc_id long, text string, source string")
    got = sharding.shard_rows(hot).collect()
    sizes, _ = check_shards(hot.collect(), got)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    mix = {s: sum(g.doc_id % 2 for g in got if g.shard == s) / sum(g.shard == s for g in got) for s in range(8)}
    assert all(0.4 < m < 0.6 for m in mix.values())


def test_null_and_repeated_ids_keep_every_row(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", None), (None, None, "x"), (4, "", "y"), (4, "", "y"), (5, "q " * 50, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for got in (simhash.simhash_report(docs), sharding.shard_rows(docs)):
        assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows)
    assert sorted(r.slot for r in sharding.shard_rows(docs, 1).collect()) == list(range(6))
