"""Hard negatives by cover trees against plain scoring of all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlab.llm import hard_negatives as H


def plain(rows, is_anchor, k=5):
    """``rows``: (id, label, integer list); every anchor against every other row."""
    out = []
    for i, (anchor, label, q) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        score = lambda v: sum(a * b for a, b in zip(q, v))  # noqa: E731, B023
        others = [(-score(v), r, lab) for j, (r, lab, v) in enumerate(rows) if j != i]
        for minus_p, positive, _ in sorted(o for o in others if o[2] == label)[:k]:
            p = -minus_p
            fits = sorted((s, r) for s, r, lab in others if lab != label and 80 * p <= -100 * s <= 100 * p)
            out += [(anchor, positive, n + 1, r, p, -s) for n, (s, r) in enumerate(fits[:k])]
    return sorted(out)


def clustered(n, dims, seed, spread=6, clusters=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dims)) * 100
    return np.floor(middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, dims)) * spread)


@pytest.mark.parametrize("kind", ["clusters", "spread out", "equal", "one row", "zeros", "short norms"])
def test_tree_finds_what_a_scan_finds(kind):
    rng = np.random.default_rng(5)
    vectors = {
        "clusters": clustered(1500, 12, 1), "spread out": np.floor(rng.normal(size=(700, 24)) * 50), "equal": np.full((300, 4), 7.0),
        "one row": np.ones((1, 3)), "zeros": np.zeros((90, 2)), "short norms": clustered(900, 6, 2) * rng.integers(0, 4, size=(900, 1)),
    }[kind]
    n, dims = vectors.shape
    rows, labels = np.arange(n), rng.integers(0, 3, size=n)
    tree = H.CoverTree.from_row(H.CoverTree.build(rows, rows * 2, labels, vectors).to_row(), dims)
    verified = 0
    for q in range(0, n, max(1, n // 25)):
        for same in (True, False):
            top = float(np.abs(vectors @ vectors[q]).max())
            windows = [(-math.inf, math.inf), (0, top * 0.5), (top * 0.6, top * 0.8), (top + 1, top + 2)]
            wish = H.Wish(vectors[q], q, int(labels[q]), same, windows, 5)
            tree.search(wish)
            verified += wish.verified
            scores = vectors @ vectors[q]
            for (low, high), hits in zip(windows, wish.found, strict=True):
                fits = [(-int(s), 2 * i) for i, s in enumerate(scores) if i != q and (labels[i] == labels[q]) == same and low <= s <= high]
                assert hits == sorted(fits)[:5]
    # every point lies within the radius of every node above it
    for node in range(len(tree.radius)):
        points = tree.vectors[tree.start[node] : tree.stop[node]]
        assert (np.linalg.norm(points - tree.centre[node], axis=1) <= tree.radius[node] + 1e-9).all()
    if kind == "clusters":
        assert len(tree.radius) > 9 and verified < n * 25 * 2 * 0.7  # nodes outside all windows were skipped


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x", 1.5) for i, lab, v in rows], "vec_id bigint, label int, embedding array<double>, row string, slot double").repartition(3)


def mined(spark, rows, is_anchor):
    return sorted(tuple(r) for r in H.mine(H.integer_rows(frame(spark, rows), F.col("label")), is_anchor).collect())


def floored(rows):
    usable = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])]
    return [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in usable]


def test_awkward_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(3)), (clustered(1, 5, int(i) % 7, 9)[0] / 256).tolist()) for i in range(160)]
    rows += [
        (200, None, [1.0] * 5), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0, 1.0]), (203, 1, [math.nan] * 5), (204, 1, [math.inf] * 5), (None, 1, [1.0] * 5),
        (210, 1, [0.5, 0.25]), (210, 1, [0.5, 0.25]), (210, 2, [0.5, 0.25]), (300, 1, [0.5, 0.25]), (310, 7, [9.0] * 5), (320, 2, [0.0] * 5), (330, 2, []),
    ]
    got = mined(spark, rows, F.col("id") % 10 == 0)
    assert got == plain(floored(rows), lambda i: i % 10 == 0) and len(got) > 100
    assert mined(spark, [], F.col("id") % 10 == 0) == []


def test_many_trees_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("TREES", 2), ("ANCHORS_AT_ONCE", 7)):
        monkeypatch.setattr(H, name, value)
    vectors = clustered(400, 6, 8, 20)
    rows = [(i, 1 if i % 3 else i % 5, (v / 256).tolist()) for i, v in enumerate(vectors)]  # a label with two thirds of the rows
    assert mined(spark, rows, F.col("id") % 9 == 0) == plain(floored(rows), lambda i: i % 9 == 0)


def test_large_components(spark):
    rows = [(i, i % 2, [70000.0 + i, float(3 * i), 1.0]) for i in range(30)] + [(100 + i, i % 2, [2.0**22 + i, -1.0, 0.0]) for i in range(9)]
    assert mined(spark, rows, F.col("id") % 10 == 0) == plain(floored(rows), lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="Overflow|overflow|too large|int64"):  # a score beyond a long
        mined(spark, [(0, 1, [1e12]), (1, 1, [1e12]), (2, 2, [1e12])], F.col("id") == 0)
