"""MinHash groups and repeated strings against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import minhash, repeats, suffix_array
from tests.conftest import SF
from tests.llm.fixtures import awkward, empty


def shingle_sets(rows):
    out = []
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), row.text or ""))
        n = min(5, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


def groups(rows, percent):
    sets = shingle_sets(rows)
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 62)
    for i, row in enumerate(rows):
        least[top(i)] = min(least[top(i)], row.doc_id)
    return sorted((r.doc_id, len(s), least[top(i)], r.doc_id == least[top(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("percent", [85, 80])
@pytest.mark.parametrize("limit", [32, 2])
def test_groups_equal_brute_force(spark, percent, limit, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_UP_TO", limit)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = awkward(spark)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, percent).collect())
    assert got == groups(docs.collect(), percent)


def test_groups_on_the_sample_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == groups(docs.collect(), 85)


def test_chain_of_copies_without_a_common_centre(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"v{k}" if k < 4 * i else w for k, w in enumerate(words)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0}


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b\tc d e f")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert minhash.near_duplicates(empty(spark)).collect() == []


def struck(rows, span):
    data = [(r.text or "").encode() for r in rows]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for row, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((row.doc_id, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [2 << 20, 1500])
def test_repeats_equal_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "DIGESTS", 40)
    docs = awkward(spark)
    assert sorted(tuple(r) for r in repeats.repeat_report(docs).collect()) == struck(docs.collect(), 200)


def test_repeats_on_the_sample_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in repeats.repeat_report(docs).collect()) == struck(docs.collect(), 200)


def test_repeats_of_an_empty_table(spark):
    assert repeats.repeat_report(empty(spark)).collect() == []
    assert repeats.without_repeats(empty(spark)).collect() == []


def test_without_repeats_keeps_what_is_single(spark):
    passage = " ".join(f"w{i * i}" for i in range(60))
    docs = spark.createDataFrame([(1, "one " + passage + "-é"), (2, passage + " two"), (3, "three"), (4, None), (5, passage * 2)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert got == {1: "one -é", 2: " two", 3: "three", 4: None}


def test_a_hot_anchor_in_many_parts(spark, monkeypatch):
    """Texts that share the anchors of one passage of under 200 bytes, and some whole strings around it."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "DIGESTS", 300)
    r = np.random.default_rng(3)
    noise = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    common = noise(190)
    ends = [noise(30) for _ in range(12)]
    texts = [noise(int(r.integers(0, 40))) + common + (ends[int(r.integers(0, 12))] if i % 3 else noise(30)) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(x) for x in repeats.repeat_report(docs).collect()) == struck(docs.collect(), 200)


def test_merged_parts_tell_what_several_have():
    r = np.random.default_rng(0)
    parts = [np.unique(r.integers(0, 60, n)) for n in (0, 5, 40, 1, 20, 0)]
    seen = Counter(x for p in parts for x in p.tolist())
    for part, met in zip(parts, suffix_array.in_several(parts), strict=True):
        assert met.tolist() == [seen[x] > 1 for x in part.tolist()]


@pytest.mark.parametrize("text", [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaa", b"banana bandana banana", bytes(range(256)) * 2, b"\0\0\0\0ab\0\0\0\0\0\0", b"mississippi" * 9])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    sa = suffix_array.suffix_array(data)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert sa.tolist() == want
    lcp = suffix_array.common_prefixes(data, sa)
    for k in range(1, len(text)):
        a, b = text[want[k - 1] :], text[want[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n
