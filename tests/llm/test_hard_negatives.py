"""Dual-tree search against scoring all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import hard_negatives as hn


def plain(rows, every=100, positives=5, negatives=10, band=(30, 90)):
    part = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or not all(c is not None and math.isfinite(c) and abs(c) < 2**17 for c in vector):
            continue
        part.append((vec_id, int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label, [math.floor(256 * c) for c in vector]))
    out = []
    for k, (a, label, q) in enumerate(part):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r, strict=False)), i, other == label) for j, (i, other, r) in enumerate(part) if j != k]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and band[0] * -s <= 100 * -x[0] <= band[1] * -s)[:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)]
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit("clash") for c in ("q", "place", "x", "score", "id", "anchor", "rank", "query")}).repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, clusters, spread, dimension=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dimension)] for _ in range(clusters)]
    return [(k, [c + r.gauss(0, spread) for c in r.choice(centres)], r.randrange(4)) for k in range(n)]


def test_equals_all_pairs_with_odd_rows(spark):
    rows = vectors(1, 500, 6, 0.3) + vectors(2, 60, 3, 0.2)
    rows += [(700, None, 1), (701, [1.0] * 8, None), (None, [1.0] * 8, 1), (702, [1.0, None] * 4, 1), (703, [math.nan] * 8, 2), (704, [math.inf] + [0.0] * 7, 2), (800, [1.0, 2.0], 3), (802, [], 3), (900, [0.0] * 8, 1), (1000, [1e300] * 8, 1), (1100, [131071.0] * 8, 0), (1200, [0.5] * 12, 0), (1300, [0.5] * 8, -3)]
    rows += [(k, [0.25] * 8, k % 3) for k in range(2000, 2060)]
    want = plain(rows)
    assert len(want) > 300 and result(spark, rows) == want
    assert result(spark, rows, anchor_every=7, positives=2, negatives=3) == plain(rows, 7, 2, 3)


def test_blocks_of_anchors_and_small_trees(spark, monkeypatch):
    for name, size in (("ANCHOR_BLOCK", 5), ("TREE_ROWS", 40), ("CHUNK", 8), ("LEAF", 4), ("ANCHOR_LEAF", 2)):
        monkeypatch.setattr(hn, name, size)
    rows = vectors(3, 300, 5, 0.2)
    assert result(spark, rows, anchor_every=20) == plain(rows, 20)


def test_no_rows_and_no_anchors(spark):
    assert result(spark, []) == [] == result(spark, [(1, [1.0], 1), (2, [1.0], 2)])


def search(x, anchors, k=5):
    labels = np.zeros(len(x), np.int64)
    tree = hn.Tree(x[:anchors], labels[:anchors], hn.ANCHOR_LEAF)
    s = hn.Search(tree, np.arange(anchors)[tree.order], np.full((anchors, 1), hn._NONE + 1), np.full((anchors, 1), -hn._NONE), k, True)
    s.add(x, labels, np.arange(len(x)), np.arange(len(x)))
    return s, tree


def test_intervals_prune_groups_of_clustered_rows(monkeypatch):
    monkeypatch.setattr(hn, "CHUNK", 256)
    random_ = np.random.default_rng(4)
    centres = random_.normal(size=(32, 16)) * 256
    x = np.rint(np.repeat(centres, 128, axis=0) + random_.normal(size=(4096, 16)) * 5)
    random_.shuffle(x)
    s, tree = search(x, 1024)
    assert s.scored < 0.4 * 1024 * len(x)
    own = x[:1024] @ x.T
    own[np.arange(1024), np.arange(1024)] = hn._NONE
    assert (s.scores[:, 0] == -np.sort(-own[tree.order], axis=1)[:, :5]).all()


def test_intervals_hold_all_products():
    random_ = np.random.default_rng(6)
    x = np.rint(random_.normal(size=(300, 6)) * random_.choice([1, 50, 3000], (300, 1)))
    a, b = hn.Tree(x[:90], np.zeros(90, int), 4), hn.Tree(x[90:], np.zeros(210, int), 7)
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(a.start)), np.arange(len(b.start)), indexing="ij"))
    lower, upper = hn.intervals(a, b, i, j)
    for n, m, lo, hi in zip(i, j, lower, upper, strict=True):
        s = a.x[a.start[n] : a.end[n]] @ b.x[b.start[m] : b.end[m]].T
        assert lo <= s.min() and s.max() <= hi


@pytest.mark.parametrize("size", [3, 2**25 - 1])
def test_products_are_exact(size):
    x = np.full((2, 4096), float(size))
    assert hn.inner_products(x, x)[0, 0] == 4096 * size * size
