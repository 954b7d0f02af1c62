"""Queries: document vectors, given-weight scorers and the feature table.

The token vectors are the word vectors of the supplied embeddings (D6); the weights are fixed embedding
rows (``fixtures.head / kernels / attention``). Vectors are reported by their sum and L2 norm (and per
kernel for F4), rounded to 6 places, and by the sum of entry times place, which a permutation of the entries would change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions import math as X
from commentlab.operators import features as Fe
from commentlab.operators import sequence as S
from commentlab.plans import fixtures as fx
from commentlab.plans.q_vocab import SEQ_LEN, Corpus, vsql
from commentlab.plans.registry import r6, register
from commentlab.session import scratch_path

_K = fx.KERNEL_WIDTH
_DOC_MEAN = (
    "el AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM seq_vectors), "
    "dm AS (SELECT id, d, avg(x) AS m FROM el GROUP BY id, d), "
)
_SUM_NORM = "round(sum(m), 6) AS vec_sum, round(sqrt(sum(m * m)), 6) AS vec_norm, round(sum(m * d), 6) AS vec_places"


def _summary(df: DataFrame) -> list:
    return [r6(X.array_sum("vec")).alias("vec_sum"), r6(X.l2_norm("vec")).alias("vec_norm"), r6(X.place_sum("vec")).alias("vec_places")]


def _head(spark: SparkSession, sf: str) -> list[tuple[str, list[float], float]]:
    return [(r["label"], list(r["w"]), float(r["bias"])) for r in Fe.collect_weights(fx.head(spark, sf))]


def _kernels(spark: SparkSession, sf: str) -> list[list[list[float]]]:
    rows = Fe.collect_weights(fx.kernels(spark, sf))
    by = {(r["kernel"], r["offset"]): list(r["w"]) for r in rows}
    n_k = max(k for k, _ in by) + 1
    return [[by[(k, o)] for o in range(_K)] for k in range(n_k)]


def _attention(spark: SparkSession, sf: str) -> tuple[list[list[float]], list[float]]:
    rows = Fe.collect_weights(fx.attention(spark, sf))
    layer1 = [list(r["w"]) for r in sorted((r for r in rows if r["unit"] >= 0), key=lambda r: r["unit"])]
    out = next(list(r["w"]) for r in rows if r["unit"] == -1)
    return layer1, out


def mean_vectors(c: Corpus, **which) -> DataFrame:
    """F1 over the vectors (D6) of every document's tokens; ``which`` as in ``Corpus.blocks``."""
    blocks, encoded = c.blocks(**which)
    return Fe.doc_vector_mean(S.sequence_vectors(encoded, c.matrix), documents=blocks)


@register(
    "doc_vector_mean",
    vsql(
        "WITH " + _DOC_MEAN + "n AS (SELECT id, count(*) AS n_tokens FROM seq_vectors GROUP BY id) "
        f"SELECT dm.id, CAST(any_value(n.n_tokens) AS BIGINT) AS n_tokens, {_SUM_NORM} FROM dm JOIN n ON dm.id = n.id GROUP BY dm.id",
        "seq_vectors",
    ),
)
def doc_vector_mean(spark: SparkSession, sf: str) -> DataFrame:
    """mean of the token vectors of each document (all tokens, unknown ones as zeros)."""
    dv = mean_vectors(Corpus(spark, sf))
    return dv.select("id", "n_tokens", *_summary(dv))


@register(
    "doc_vector_last",
    vsql(
        "WITH l AS (SELECT id, arg_max(vec, pos) AS vec FROM seq_vectors GROUP BY id) "
        "SELECT id, round(list_sum(vec), 6) AS vec_sum, round(sqrt(list_sum(list_transform(vec, lambda v: v * v))), 6) AS vec_norm, "
        "round(list_sum(list_transform(vec, lambda v, i: v * i)), 6) AS vec_places FROM l",
        "seq_vectors",
    ),
)
def doc_vector_last(spark: SparkSession, sf: str) -> DataFrame:
    """vector of the last position."""
    c = Corpus(spark, sf)
    dv = Fe.doc_vector_last(c.encoded(), c.matrix)
    return dv.select("id", *_summary(dv))


_ATT_SQL = (
    "WITH a1 AS (SELECT vec_id - {lo} AS unit, CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id BETWEEN {lo} AND {hi}), "
    "a2 AS (SELECT CAST(embedding[1:{h}] AS DOUBLE[]) AS w FROM embeddings WHERE vec_id = {out}), "
    "hid AS (SELECT s.id, s.pos, a1.unit, greatest(list_dot_product(s.vec, a1.w), 0) AS h FROM seq_vectors s CROSS JOIN a1), "
    "sc AS (SELECT hid.id, hid.pos, sum(hid.h * a2.w[hid.unit + 1]) AS s FROM hid CROSS JOIN a2 GROUP BY hid.id, hid.pos), "
    "wt AS (SELECT id, pos, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM sc), "
    "z AS (SELECT id, sum(e) AS z FROM wt GROUP BY id), "
    "el AS (SELECT sv.id, unnest(sv.vec) AS x, generate_subscripts(sv.vec, 1) AS d, wt.e FROM seq_vectors sv JOIN wt ON sv.id = wt.id AND sv.pos = wt.pos), "
    "dm AS (SELECT el.id, el.d, sum(el.x * el.e) / any_value(z.z) AS m FROM el JOIN z ON el.id = z.id GROUP BY el.id, el.d) "
    "SELECT id, " + _SUM_NORM + " FROM dm GROUP BY id"
).format(lo=fx.ATTN_ROWS[0], hi=fx.ATTN_ROWS[-1], h=fx.ATTN_HIDDEN, out=fx.ATTN_OUT_ROW)


@register("doc_vector_attention", vsql(_ATT_SQL, "seq_vectors"))
def doc_vector_attention(spark: SparkSession, sf: str) -> DataFrame:
    """attention pooling (Linear 64->24, ReLU, Linear 24->1, softmax over positions)."""
    layer1, out = _attention(spark, sf)
    c = Corpus(spark, sf)
    scored_matrix = Fe.score_attention(c.matrix, layer1, out).select("id", "vec", "score")
    blocks, encoded = c.blocks()
    dv = Fe.doc_vector_attention(encoded, scored_matrix, documents=blocks)
    return dv.select("id", *_summary(dv))


_CONV_SQL = (
    f"WITH k AS (SELECT CAST(vec_id // {_K} AS INTEGER) AS kernel, vec_id % {_K} AS o, CAST(embedding AS DOUBLE[]) AS w FROM embeddings "
    f"WHERE vec_id < {fx.N_KERNELS * _K}), "
    "pr AS (SELECT s.id, s.pos - k.o AS start, k.kernel, list_dot_product(s.vec, k.w) AS p FROM seq_vectors s CROSS JOIN k), "
    "win AS (SELECT id, start, kernel, sum(p) AS c, count(*) AS cnt FROM pr GROUP BY id, start, kernel) "
    f"SELECT id, kernel, round(max(greatest(c, 0)), 6) AS value FROM win WHERE cnt = {_K} GROUP BY id, kernel"
)


@register("doc_vector_conv_max", vsql(_CONV_SQL, "seq_vectors"))
def doc_vector_conv_max(spark: SparkSession, sf: str) -> DataFrame:
    """trigram filters, ReLU, max over positions; one value per (document, kernel)."""
    c = Corpus(spark, sf)
    proj = Fe.project_kernels(c.matrix, _kernels(spark, sf))
    parts = tuple(f"_p{o}" for o in range(_K))
    blocks, encoded = c.blocks()
    tok = S.sequence_vectors(encoded, proj.select("id", "vec", *parts), extra=parts)
    dv = Fe.doc_vector_conv_max(tok, _K, documents=blocks)
    return dv.select("id", F.posexplode("vec").alias("kernel", "value")).select("id", "kernel", r6("value").alias("value"))


# ---- F1 / F3 / F4 over the fixed length, padding and empty documents included


@register(
    "doc_vector_mean_padded",
    vsql(f"WITH {_DOC_MEAN.replace('seq_vectors', 'padded_vectors').rstrip(', ')} SELECT id, {_SUM_NORM} FROM dm GROUP BY id", "padded_vectors"),
)
def doc_vector_mean_padded(spark: SparkSession, sf: str) -> DataFrame:
    """F1 as the reference pools: the mean over all 200 positions of every document, padding included."""
    dv = mean_vectors(Corpus(spark, sf), max_len=SEQ_LEN, bag=True)
    return dv.select("id", *_summary(dv))


@register("doc_vector_attention_padded", vsql(_ATT_SQL.replace("seq_vectors", "padded_vectors"), "padded_vectors"))
def doc_vector_attention_padded(spark: SparkSession, sf: str) -> DataFrame:
    """F3 as the reference pools: the softmax runs over all 200 positions of every document."""
    layer1, out = _attention(spark, sf)
    c = Corpus(spark, sf)
    scored_matrix = Fe.score_attention(c.matrix, layer1, out).select("id", "vec", "score")
    blocks, encoded = c.blocks(SEQ_LEN, bag=True)
    dv = Fe.doc_vector_attention(encoded, scored_matrix, documents=blocks)
    return dv.select("id", *_summary(dv))


CONV_BIAS = [round(0.05 * (k - 3), 2) for k in range(fx.N_KERNELS)]  # biases of both signs
_CONV_PADDED_SQL = (
    _CONV_SQL.replace("seq_vectors", "padded_vectors").replace("max(greatest(c, 0))", "max(greatest(c + 0.05 * (kernel - 3), 0))")
)


@register("doc_vector_conv_padded", vsql(_CONV_PADDED_SQL, "padded_vectors"))
def doc_vector_conv_padded(spark: SparkSession, sf: str) -> DataFrame:
    """F4 as the reference pools: trigram filters with biases over all 200 positions, windows of padding included."""
    c = Corpus(spark, sf)
    proj = Fe.project_kernels(c.matrix, _kernels(spark, sf))
    parts = tuple(f"_p{o}" for o in range(_K))
    blocks, encoded = c.blocks(SEQ_LEN, pad=_K)
    tok = S.sequence_vectors(encoded, proj.select("id", "vec", *parts), extra=parts)
    dv = Fe.doc_vector_conv_max(tok, _K, bias=CONV_BIAS, documents=blocks)
    return dv.select("id", F.posexplode("vec").alias("kernel", "value")).select("id", "kernel", r6("value").alias("value"))


_HEAD_SQL = (
    "WITH " + _DOC_MEAN + "hd AS (SELECT CASE vec_id " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in fx.HEAD_ROWS.items()) + " END AS label, "
    f"CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id IN ({', '.join(str(v) for v in fx.HEAD_ROWS.values())})) "
    "SELECT dm.id, hd.label, round(sum(dm.m * hd.w[dm.d]), 6) AS logit FROM dm CROSS JOIN hd GROUP BY dm.id, hd.label"
)


@register("linear_scores", vsql(_HEAD_SQL, "seq_vectors"))
def linear_scores(spark: SparkSession, sf: str) -> DataFrame:
    """one logit per label from the mean document vector."""
    dv = mean_vectors(Corpus(spark, sf))
    return Fe.linear_scores(dv, _head(spark, sf)).select("id", "label", r6("logit").alias("logit"))


@register(
    "feature_table",
    vsql(
        "WITH " + _DOC_MEAN + "f AS (SELECT id, round(sum(m), 6) AS vec_sum, round(sum(m * d), 6) AS vec_places FROM dm GROUP BY id) "
        "SELECT f.id, f.vec_sum, f.vec_places, c.toxic, c.quality FROM f JOIN scored_comments c ON f.id = c.id",
        "seq_vectors",
        "scored_comments",
    ),
)
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """F8: (id, features, labels) for the scored comments, written as Parquet and read back."""
    labels = fx.scored_comments(spark, sf).select("id", *fx.LABELS)
    dv = mean_vectors(Corpus(spark, sf), ids=fx.scored_ids(spark, sf))
    table = dv.join(labels, "id").select("id", F.col("vec").alias("features"), *fx.LABELS)
    path = scratch_path(spark, "feature_table")
    table.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return back.select("id", r6(X.array_sum("features")).alias("vec_sum"), r6(X.place_sum("features")).alias("vec_places"), *fx.LABELS)
