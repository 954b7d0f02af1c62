"""Padding, empty documents, sparse vectors and their places, on small frames against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from commentlab.operators import features as Fe
from commentlab.operators import sequence as S
from commentlab.operators import vocab as V

N, WIDTH = 6, 3
TEXTS = [(1, "a b c a"), (2, ""), (3, None), (4, "a b c a b c a b zz"), (5, "b b b b b b"), (6, "a b c a c"), (7, "q")]
WORDS = {"<unk>": 0, "<pad>": 1, "a": 2, "b": 3, "c": 4}
RNG = np.random.default_rng(4)
VECTORS = {i: np.zeros(4) if i < 2 else RNG.normal(size=4) for i in range(5)}
VECTORS[1] = np.array([0.3, -0.2, 0.1, 0.05])  # padding need not be zero


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string").repartition(3)
    vocab = spark.createDataFrame(list(WORDS.items()), "token string, id bigint")
    matrix = spark.createDataFrame([(i, v.tolist()) for i, v in VECTORS.items()], "id bigint, vec array<double>")
    return docs, F.expr("filter(split(text, ' '), x -> x <> '')"), vocab, matrix


def ids_of(text):
    return [WORDS.get(t, 0) for t in (text or "").split()][:N]


def padded_ids(text):
    ids = ids_of(text)
    return ids + [1] * (N - len(ids))


def test_sequences_keep_every_document(parts):
    docs, tokens, vocab, _ = parts
    first = V.first_tokens(docs, "id", tokens, N)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("slice(")  # the cut lies below the explode
    seqs = S.to_sequence(V.encode_tokens(first, vocab))
    for side, want in (("right", lambda t: padded_ids(t)), ("left", lambda t: [1] * (N - len(ids_of(t))) + ids_of(t))):
        got = {r["id"]: r["padded"] for r in S.padded(seqs, N, 1, side).collect()}
        assert got == {i: want(t) for i, t in TEXTS}
    places = {r["id"]: r["positions"] for r in S.with_positions(S.padded(seqs, N), 1).collect()}
    assert places[2] == places[3] == [0] * N and places[1] == [1, 2, 3, 4, 0, 0]


def test_mean_over_the_fixed_length(parts):
    docs, tokens, vocab, matrix = parts
    bag = V.encode_tokens(V.padded_bag(docs, "id", tokens, N), vocab)
    got = {r["id"]: r for r in Fe.doc_vector_mean(S.sequence_vectors(bag, matrix), count_col="n").collect()}
    assert set(got) == {i for i, _ in TEXTS} and all(r["n_tokens"] == N for r in got.values())
    for i, t in TEXTS:
        assert np.allclose(got[i]["vec"], np.mean([VECTORS[x] for x in padded_ids(t)], axis=0))


def test_attention_over_the_fixed_length(parts, spark):
    docs, tokens, vocab, matrix = parts
    layer, out = RNG.normal(size=(3, 4)), RNG.normal(size=3)
    scored = Fe.score_attention(matrix, layer.tolist(), out.tolist(), b1=0.1, b2=-0.2)
    bag = V.encode_tokens(V.padded_bag(docs, "id", tokens, N), vocab)
    got = {r["id"]: r["vec"] for r in Fe.doc_vector_attention(bag, scored, count_col="n").collect()}
    for i, t in TEXTS:
        x = np.array([VECTORS[k] for k in padded_ids(t)])
        s = np.maximum(x @ layer.T + 0.1, 0) @ out - 0.2
        w = np.exp(s - s.max())
        assert np.allclose(got[i], w @ x / w.sum())


@pytest.mark.parametrize("bias", [[0.4, -0.3], [-5.0, 0.0]])
def test_windows_over_the_fixed_length(parts, bias):
    docs, tokens, vocab, matrix = parts
    kernels = np.random.default_rng(9).normal(size=(2, WIDTH, 4))
    proj = Fe.project_kernels(matrix, kernels.tolist())
    names = tuple(f"_p{o}" for o in range(WIDTH))
    first = V.encode_tokens(V.first_tokens(docs, "id", tokens, N, pad=WIDTH), vocab)
    rows = S.sequence_vectors(first, proj.select("id", "vec", *names), extra=names)
    got = {r["id"]: r["vec"] for r in Fe.doc_vector_conv_max(rows, WIDTH, bias=bias).collect()}
    for i, t in TEXTS:
        x = np.array([VECTORS[k] for k in padded_ids(t)])
        windows = [[max(0.0, float((k * x[a : a + WIDTH]).sum()) + b) for k, b in zip(kernels, bias)] for a in range(N - WIDTH + 1)]
        assert np.allclose(got[i], np.max(windows, axis=0))


def test_last_vector_by_one_look_up(parts):
    docs, tokens, vocab, matrix = parts
    got = {r["id"]: r["vec"] for r in Fe.doc_vector_last(V.encode_tokens(V.first_tokens(docs, "id", tokens, 99), vocab), matrix).collect()}
    assert got == {i: VECTORS[[WORDS.get(x, 0) for x in t.split()][-1]].tolist() for i, t in TEXTS if t}


def test_sparse_vectors(spark):
    rows = [(1, 3, 2.0), (1, 0, 1.0), (1, 3, 5.0), (2, None, None), (3, 4, 0.0), (4, 2, -1.5), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "id int, token_id bigint, w double")
    dense = lambda d: {r["id"]: list(r["v"]) for r in d.select("id", vector_to_array("vector").alias("v")).collect()}
    ones = S.sparse_vectors(df, 5)
    assert dense(ones) == {1: [1, 0, 0, 1, 0], 2: [0] * 5, 3: [0, 0, 0, 0, 1], 4: [0, 0, 1, 0, 0], None: [0, 1, 0, 0, 0]}
    assert {type(r["vector"]).__name__ for r in ones.collect()} == {"SparseVector"}
    assert dense(S.sparse_vectors(df, 5, value_col="w")) == {1: [1, 0, 0, 5, 0], 2: [0] * 5, 3: [0] * 5, 4: [0, 0, -1.5, 0, 0], None: [0, 1, 0, 0, 0]}
    with pytest.raises(Exception, match="outside"):
        S.sparse_vectors(df, 4).collect()


def test_softmax_long_with_null_group_and_large_scores(spark):
    rows = [("a", 900.0), ("a", 901.0), ("a", 901.0), ("b", -900.0), (None, 1.0), (None, 2.0)]
    got = S.softmax_long(spark.createDataFrame(rows, "g string, s double"), "g", "s").collect()
    z = {"a": math.exp(-1) + 2, "b": 1.0, None: math.exp(-1) + 1}
    top = {"a": 901.0, "b": -900.0, None: 2.0}
    assert len(got) == 6
    for r in got:
        assert math.isclose(r["p"], math.exp(r["s"] - top[r["g"]]) / z[r["g"]])
