"""Queries that read a block's lists together, against plain scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from commentlab.llm import topk


def best_of(rows, ids, vectors, weights, own, k=5):
    whole = [[int(x) for x in v] for v in vectors.tolist()]
    scores = [(-sum(int(w) * x for w, x in zip(weights, v)), int(i)) for r, i, v in zip(rows, ids, whole, strict=True) if r != own]
    return sorted(scores)[:k]


@pytest.mark.parametrize("kind", ["ties", "clear", "mixed", "few"])
def test_many_queries_read_the_lists_of_a_block_together(kind, monkeypatch):
    rng = np.random.default_rng(3)
    m, dims = (3 if kind == "few" else 400), 12
    x = np.floor(rng.normal(size=(m, dims)) * 30)
    if kind == "ties":
        x = np.clip(x, -1, 1)
    if kind == "clear":
        x = np.floor(x * rng.exponential(size=(m, 1)) ** 3)
    if kind == "mixed":  # some queries' scores do not fit doubles; no query of the others has a weight in the last list
        x[:, -1] = 0
        x[::7, -1] = 2.0**60
        x[5::50] *= 2.0**30
    rows, ids = np.arange(m) + 1000, rng.integers(0, m, size=m)
    block = topk.SortedLists.sort(rows, ids, x)
    weights = np.concatenate([x, np.floor(rng.normal(size=(700, dims)) * 9)])
    weights[m:, -1] = 0
    weights[-1] = 0
    if kind == "mixed":
        weights[:m, -1] = 0
    tables = []
    known = topk.SortedLists.known
    monkeypatch.setattr(topk.SortedLists, "known", lambda *a: tables.append(1) or known(*a))
    queries = [topk.Query(w, 1000 + i, 5) for i, w in enumerate(weights)]
    block.search_all(queries)
    for i, q in enumerate(queries):
        assert q.found == best_of(rows, ids, x, weights[i], 1000 + i), i
    # the tables are made once for a block and a depth, not for every query
    assert 0 < len(tables) <= 2 * 2 * len(topk.DEPTHS)
    if kind != "few":
        lines = [q.line for q in queries]
        assert all(line > -math.inf for line in lines)
        later = [topk.Query(w, 1000 + i, 5) for i, w in enumerate(weights)]
        for q, line in zip(later, lines, strict=True):
            q.line = line + 1  # a block before held better ones
        block.search_all(later)
        assert all(q.found == [b for b in best_of(rows, ids, x, w, q.row) if -b[0] >= q.line] for q, w in zip(later, weights, strict=True))


def test_vectors_of_different_lengths():
    column = pa.chunked_array([pa.array([[9.0], [1.0, 2.0]], pa.list_(pa.float64())).slice(1), pa.array([[], [3.0, 4.0, 5.0]], pa.list_(pa.float64()))])
    assert topk._vectors(column, 4).tolist() == [[1, 2, 0, 0], [0, 0, 0, 0], [3, 4, 5, 0]]
    assert topk._vectors(column.slice(0, 0), 2).shape == (0, 2)
