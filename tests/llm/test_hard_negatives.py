"""Hard negatives against all scores by hand."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import hard_negatives, vector_search


def by_hand(rows, anchors, k=5):
    """rows, anchors: (vec_id, label, whole components), none twice."""
    out = Counter()
    most = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for a, label, v in anchors:
        scores = sorted((-most(sum(x * y for x, y in zip(v, w, strict=True))), i, of == label) for i, of, w in rows if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scores if x[2]][:k]:
            fit = [x for x in scores if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out.update((a, i, n, j, -s, -t) for n, (t, j, _) in enumerate(fit, 1))
    return out


def check(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    whole = list({(i, y, tuple(map(int, v))) for i, y, v in rows})
    got = hard_negatives.mined(df, df.filter(f"vec_id % {every} = 0"), **options)
    want = by_hand(whole, [x for x in whole if x[0] % every == 0])
    assert Counter(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("options", [{}, {"block": 40, "asked": 3}, {"block": 40, "pivots": {}}])
def test_mined_equals_all_scores(spark, options):
    r = np.random.default_rng(2)
    centers = r.normal(0, 60, (4, 8))
    rows = []
    for i in range(600):
        c = int(r.integers(4))
        rows.append((i, int(r.integers(4)) if i % 5 == 0 else c, [float(x) for x in np.floor(centers[c] + r.normal(0, 25, 8))]))
    rows += rows[:20]
    assert len(check(spark, rows, 20, **options)) > 300


def test_copies_huge_components_zeros_and_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in r.integers(-9, 9, 4)]) for i in range(150)]
    rows += [(1000 + i, i % 2, [5.0, 5.0, 5.0, 5.0]) for i in range(400)]
    rows += [(2000, 0, [1e17, 0.0, 3.0, 0.0]), (2001, 1, [1e17, 0.0, 2.0, 0.0]), (2002, 0, [1e17, 1.0, 0.0, 0.0]), (2050, 1, [2.0**40] * 4), (2051, 0, [2.0**40] * 4)]
    rows += [(3000 + i, i % 2, [0.0] * 4) for i in range(12)] + [(4000 + i, i % 2, [float(i), 1.0]) for i in range(30)]
    rows += [(5000, 0, [7.0] * 4), (5000, 0, [6.0] * 4), (5000, 1, [7.0] * 4), (6000, 7, [1.0] * 4)]
    check(spark, rows, 50, block=64, asked=2)


def test_brackets_hold():
    r = np.random.default_rng(1)
    v, q = np.floor(r.normal(0, 100, (300, 16)) * r.choice([1, 1e3], (300, 1))), np.floor(r.normal(0, 50, (30, 16)))
    q[0] = v[0]
    y, shell = hard_negatives.on_sphere(v)
    assert np.allclose((y * y).sum(axis=1), 1)
    pivots = hard_negatives.far_apart(y, 12)
    ends, length = hard_negatives._ends(q, {16: pivots}, 16)
    dist = hard_negatives.distances(y, pivots)
    low, high = hard_negatives.brackets(ends, dist, dist, length[:, None] * np.exp2(shell.astype(float))[None, :])
    assert (low <= q @ v.T).all() and (q @ v.T <= high).all()


def test_rows_that_take_no_part_and_nothing(spark):
    rows = [(0, 1, [0.1, 0.2]), (1, 1, [0.1, 0.2]), (2, 2, [0.1, 0.19]), (3, None, [0.1, 0.2]), (4, 2, None), (5, 2, [0.1, None]), (6, 2, [0.1, float("nan")]), (8, 2, [float("inf"), 0.1]), (None, 2, [0.1, 0.2]), (9, 2, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, v string, block int")
    vectors = vector_search.quantised(df, keep=("label",))
    assert {r.vec_id for r in vectors.filter("label IS NOT NULL").collect()} == {0, 1, 2}
    got = hard_negatives.mined(vectors.filter("label IS NOT NULL"), vectors.filter("vec_id = 0"))
    a, b = [math.floor(256 * x) for x in (0.1, 0.2)], [math.floor(256 * x) for x in (0.1, 0.19)]
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, a[0] * a[0] + a[1] * a[1], a[0] * b[0] + a[1] * b[1])]
    assert hard_negatives.mined(vectors.filter("false"), vectors.filter("false")).collect() == []
    moved = hard_negatives.relabelled(spark.createDataFrame([(7, 9), (14, 3), (8, 9), (21, None)], "vec_id long, label int"))
    assert {tuple(r) for r in moved.collect()} == {(7, 0), (14, 4), (8, 9)}
