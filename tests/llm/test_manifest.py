"""The Merkle manifest against a tree that is built by hand."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import merkle
from tests.conftest import SF
from tests.llm.fixtures import awkward, empty


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, r.n_chars if r.n_chars is None else r.n_chars + more, r.text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """Root, and of each node what stands before and after it on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place - place % fanout
            paths[i].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + fanout])))
        nodes, at = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [x // fanout for x in at]
    return nodes[0], paths


def by_hand(rows, fanout=2):
    langs = defaultdict(list)
    for r in rows:
        langs[r.lang].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in langs[x]], fanout) for x in order}
    root, ends = tree([trees[x][0] for x in order], fanout)
    out = Counter()
    for x, end in zip(order, ends, strict=True):
        for r, path in zip(langs[x], trees[x][1], strict=True):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for before, after in path + end:
                node = h(before, node, after)
            out[(r.doc_id, leaf(r), trees[x][0], root, h(*[a + b for a, b in path + end]), node, node == root)] += 1
    return out


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_equals_a_tree_by_hand(spark, fanout):
    docs = awkward(spark).selectExpr("CASE WHEN doc_id % 11 = 5 THEN NULL ELSE doc_id END doc_id", "text", "source", "element_at(array('en', 'de', NULL, 'ß', 'z'), cast(doc_id % 5 + 1 AS int)) lang", "CASE WHEN doc_id % 9 <> 4 THEN cast(n_chars AS bigint) END n_chars", "key", "n", "score idx", "kept path")
    want = by_hand(docs.collect(), fanout)
    got = merkle.manifest(docs, fanout)
    assert Counter(map(tuple, got.collect())) == want
    assert any(not k[-1] for k in want) and any(k[-1] for k in want)


def test_manifest_of_the_sample_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == by_hand(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 128, 129])
def test_a_single_lang_and_uneven_levels(spark, n):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs).collect()
    assert Counter(map(tuple, got)) == by_hand(docs.collect())
    assert all(r.subroot == r.root for r in got)


def test_largest_count_and_no_rows(spark):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(i, None, None, None, top) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == by_hand(docs.collect())
    assert merkle.manifest(empty(spark)).collect() == []
