"""Work by blocks of documents against the row-by-row forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlab.operators import blocks as B
from commentlab.operators import features as Fe
from commentlab.operators import sequence as S
from commentlab.operators import vocab as V

TEXTS = [(1, "a b c a"), (2, ""), (3, None), (4, "a b c a b zz"), (4, "a b c a b zz"), (5, "q"), (None, "b c b"), (6, "b a")]


def tokens():
    return F.expr("filter(split(text, ' '), x -> x <> '')")


RNG = np.random.default_rng(11)
# id 3 comes twice, with vectors of its own; id 0 is the unknown token, id 1 padding
MATRIX = [(i, RNG.normal(size=4).tolist()) for i in (0, 1, 2, 3, 3, 4)]


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string").repartition(3)
    vocab = spark.createDataFrame([("<unk>", 0), ("<pad>", 1), ("a", 2), ("b", 3), ("c", 4)], "token string, id bigint")
    return docs, vocab, spark.createDataFrame(MATRIX, "id bigint, vec array<double>")


def by_id(df, *cols):
    return {r["id"]: [np.round(r[c], 9).tolist() for c in cols] for r in df.collect()}


def in_blocks(docs, vocab, lists=None, counts=None):
    blocks = B.document_blocks(docs, tokens() if lists is None else lists, 3, counts)
    return blocks, V.encode_tokens(B.block_tokens(blocks), vocab)


def test_block_means_and_softmax_are_those_of_the_rows(parts, monkeypatch):
    monkeypatch.setattr(B, "STEP", 3)
    docs, vocab, matrix = parts
    rows = V.encode_tokens(V.explode_tokens(docs, "id", tokens()), vocab)
    blocks, encoded = in_blocks(docs, vocab)
    want = by_id(Fe.doc_vector_mean(S.sequence_vectors(rows, matrix)), "n_tokens", "vec")
    assert by_id(Fe.doc_vector_mean(S.sequence_vectors(encoded, matrix), documents=blocks), "n_tokens", "vec") == want
    assert set(want) == {1, 4, 5, 6, None}
    scored = Fe.score_attention(matrix, RNG.normal(size=(3, 4)).tolist(), [30.0, -2.0, 5.0])
    want = by_id(Fe.doc_vector_attention(rows, scored), "vec")
    assert by_id(Fe.doc_vector_attention(encoded, scored, documents=blocks), "vec") == want


def test_block_means_over_the_fixed_length(parts):
    docs, vocab, matrix = parts
    rows = V.encode_tokens(V.padded_bag(docs, "id", tokens(), 5), vocab)
    entries = V.padded_entries(tokens(), 5)
    blocks, encoded = in_blocks(docs, vocab, entries["token"], entries["n"])
    want = by_id(Fe.doc_vector_mean(S.sequence_vectors(rows, matrix), count_col="n"), "n_tokens", "vec")
    assert by_id(Fe.doc_vector_mean(S.sequence_vectors(encoded, matrix), documents=blocks), "n_tokens", "vec") == want


@pytest.mark.parametrize("bias", [None, [0.4, -0.3]])
def test_block_windows_are_those_of_the_rows(parts, bias):
    docs, vocab, matrix = parts
    one = matrix.groupBy("id").agg(F.first("vec").alias("vec")).persist()  # ties of a position would come in any order
    proj = Fe.project_kernels(one, RNG.normal(size=(2, 3, 4)).tolist())
    names = ("_p0", "_p1", "_p2")
    rows = S.sequence_vectors(V.encode_tokens(V.first_tokens(docs, "id", tokens(), 5, pad=1), vocab), proj, extra=names)
    blocks, encoded = in_blocks(docs, vocab, V.cut_tokens(tokens(), 5, 1))
    got = Fe.doc_vector_conv_max(S.sequence_vectors(encoded, proj, extra=names), 3, bias=bias, documents=blocks)
    assert by_id(got, "vec") == by_id(Fe.doc_vector_conv_max(rows, 3, bias=bias), "vec")


def test_rows_of_places(parts):
    docs, vocab, matrix = parts
    rows = S.sequence_vectors(V.encode_tokens(V.explode_tokens(docs, "id", tokens()), vocab), matrix)
    blocks, encoded = in_blocks(docs, vocab)
    found = S.sequence_vectors(encoded, matrix.withColumn("s", F.element_at("vec", 1)), extra=("s",))
    got = B.place_rows(blocks, found, ["token_id", "s"])
    key = lambda r: str(tuple(r))
    want = rows.select("id", "pos", "token_id", F.element_at("vec", 1).alias("s"))
    assert got.columns == want.columns
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_blocks_are_dealt_as_texts_and_refuse_what_would_join_tokens(parts, spark):
    docs, vocab, matrix = parts
    blocks, encoded = in_blocks(docs, vocab)
    plan = Fe.doc_vector_mean(S.sequence_vectors(encoded, matrix), documents=blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in plan
    odd = spark.createDataFrame([(1, ["a\nb"])], "id int, t array<string>")
    blocks, encoded = in_blocks(odd, vocab, F.col("t"))
    with pytest.raises(Exception, match="line break"):
        Fe.doc_vector_mean(S.sequence_vectors(encoded, matrix), documents=blocks).collect()
