"""Document features from token vectors and given weights.

Token vectors ``(id, pos, vec)`` are pooled with Spark ML's ``Summarizer`` (a JVM aggregate with a
map-side partial step), so each document collapses to one row before the shuffle. Work that depends on
the token only (attention score, kernel projections) is done once per vocabulary row; trigram windows
use ``lead`` over each document's positions. Over a whole corpus the poolings take the documents in blocks
(``operators.blocks``) and the looked-up rows of each block's different tokens: the same sums, without a vector row per token.

Weights (linear head, kernels, attention layers) are model parameters: they are read with a row bound
checked and inlined as literal arrays, the same way a fitted Spark ML model carries its coefficients.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlab.functions.math import dot, dot_literal, relu
from commentlab.operators import blocks as B
from commentlab.operators.vocab import lookup_join
from commentlab.session import cut_lineage

MAX_WEIGHT_ROWS = 4096


def collect_weights(df: DataFrame, max_rows: int = MAX_WEIGHT_ROWS) -> list:
    """Read a weight table after checking that it is a bounded parameter table, not data."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"weight table has more than {max_rows} rows; it is data, not parameters")
    return rows


def _vec(col: str = "vec") -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


def doc_vector_mean(seq_vectors: DataFrame, count_col: str | None = None, id_col: str = "id", documents: DataFrame | None = None) -> DataFrame:
    """mean of the token vectors per document, over the rows ``(id, vec)`` or, with ``count_col``, over rows that stand for
    that many places each.

    Over real tokens only, a document without tokens has no mean and no row. Over a fixed length, padding
    included, ``vocab.padded_bag`` gives one row for all the padding of a document, so padding is never spread out.

    With ``documents`` (``blocks.document_blocks``) the rows are ``(block, token, vec)``: the different tokens of each block."""
    if documents is not None:
        return B.mean_vectors(documents, seq_vectors, id_col).select(id_col, F.col("n").alias("n_tokens"), "vec")
    if count_col is None:
        agg = seq_vectors.groupBy(id_col).agg(Summarizer.mean(_vec()).alias("_m"), F.count(F.lit(1)).alias("n_tokens"))
    else:
        weight = F.col(count_col).cast("double")
        agg = seq_vectors.groupBy(id_col).agg(Summarizer.mean(_vec(), weight).alias("_m"), F.sum(count_col).alias("n_tokens"))
    return agg.select(id_col, "n_tokens", vector_to_array("_m").alias("vec"))


def doc_vector_last(encoded: DataFrame, matrix: DataFrame, token_id_col: str = "token_id", id_col: str = "id") -> DataFrame:
    """vector of the last (real) position: the last token id of each document first, then one look-up per document."""
    last = encoded.groupBy(id_col).agg(F.max_by(token_id_col, "pos").alias(token_id_col)).where(F.col(token_id_col).isNotNull())
    lookup = matrix.select(F.col("id").alias(token_id_col), F.col("vec").cast("array<double>").alias("vec"))
    return lookup_join(last, lookup, token_id_col, "inner").select(id_col, "vec")


def _weight_lit(rows: list[list[float]]) -> Column:
    """A weight matrix as one constant array-of-arrays (folded to a single literal by Catalyst)."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def _dot_each(vec: Column, rows: Column) -> Column:
    """[row . vec for row in rows] — one lambda over the rows, not one expression per row."""
    v = vec.cast("array<double>")
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(w, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x))


def score_attention(matrix: DataFrame, layer1: list[list[float]], out: list[float], b1: float = 0.0, b2: float = 0.0) -> DataFrame:
    """F3 step 1: attention score of every vocabulary row, out . relu(layer1 @ vec + b1) + b2.

    The score depends on the token only, so it is computed once per vocabulary entry and reaches the
    tokens with the vector lookup — vocabulary-sized work instead of corpus-sized work."""
    hidden = F.transform(_dot_each(F.col("vec"), _weight_lit(layer1)), lambda h: relu(h + F.lit(b1)))
    return matrix.withColumn("_h", hidden).withColumn("score", dot(F.col("_h"), F.array(*[F.lit(float(x)) for x in out])) + F.lit(b2)).drop("_h")


def doc_vector_attention(
    encoded: DataFrame,
    scored_matrix: DataFrame,
    token_id_col: str = "token_id",
    id_col: str = "id",
    count_col: str | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """F3 step 2: softmax of the scores over a document's positions, weighted sum of the vectors. With ``count_col`` a row
    stands for that many positions, so that one row (``vocab.padded_bag``) carries the whole softmax mass of the padding.

    softmax-weighted mean = Summarizer.mean(vec, weight = n * exp(score - c)), with n the token's count in
    the document and c the document's own largest score, so that no weight underflows. Tokens are counted per
    document first, and the scored matrix is written once and read by both look-ups.

    With ``documents`` (``blocks.document_blocks``) the rows are ``(block, token, token_id)``, the different tokens of each
    block: score and vector are looked up once for each, and a block's task weighs its documents' tokens."""
    lookup = scored_matrix.select(F.col("id").alias(token_id_col), F.col("vec").cast("array<double>").alias("vec"), "score")
    if documents is not None:
        named = documents.where(F.col(id_col).isNotNull())  # as the join with each document's largest score below
        return B.softmax_vectors(named, lookup_join(encoded, lookup, token_id_col, "inner"), id_col)
    lookup = cut_lineage(lookup, "scored-matrix")
    places = F.lit(1) if count_col is None else F.col(count_col)
    counts = encoded.groupBy(id_col, token_id_col).agg(F.sum(places).alias("_n"))
    scored = cut_lineage(lookup_join(counts, lookup.drop("vec"), token_id_col, "inner"), "scored-tokens")
    top = scored.groupBy(id_col).agg(F.max("score").alias("_c"))
    rows = lookup_join(scored.join(top, id_col), lookup.drop("score"), token_id_col, "inner")
    weighted = rows.withColumn("_w", F.col("_n") * F.exp(F.col("score") - F.col("_c")))
    agg = weighted.groupBy(id_col).agg(Summarizer.mean(_vec(), F.col("_w")).alias("_m"))
    return agg.select(id_col, vector_to_array("_m").alias("vec"))


def project_kernels(matrix: DataFrame, kernels: list[list[list[float]]]) -> DataFrame:
    """F4 step 1: for every vocabulary row and kernel offset o, the K dot products kernel[k][o] . vec
    (``_p0``, ``_p1``, ...). Computed once per vocabulary entry, like the attention score."""
    width = len(kernels[0])
    out = matrix
    for o in range(width):
        out = out.withColumn(f"_p{o}", _dot_each(F.col("vec"), _weight_lit([k[o] for k in kernels])))
    return out


def doc_vector_conv_max(
    token_proj: DataFrame, width: int, id_col: str = "id", bias: list[float] | None = None, documents: DataFrame | None = None
) -> DataFrame:
    """F4 step 2: window value(start) = sum_o proj_o(start + o) + bias, ReLU, max over the windows, per kernel.
    Documents shorter than ``width`` give no row. Input ``(id, pos, _p0 .. _p{width-1})``.

    Over a fixed length, padding included, every window is one of tokens, one that straddles the end, or one of padding only,
    and these are all alike: ``vocab.first_tokens(pad=width)`` puts at most ``width`` padding tokens behind the text,
    which make one of each kind, and no document is too short.

    ``lead`` over the positions of each document brings the next tokens' projections onto the window's
    first row; the max over windows is ``Summarizer.max``. Tokens are clustered by document already
    (narrow explode + broadcast lookups), so the window sorts within partitions and the aggregate
    combines map-side: no token shuffle, and no per-document array is built.

    With ``documents`` (``blocks.document_blocks``) the rows are ``(block, token, _p0 .. )``, the different tokens of each
    block, and the windows run over the documents' own lists of tokens."""
    parts = [f"_p{o}" for o in range(width)]
    if documents is not None:
        return B.window_maxima(documents, token_proj, parts, bias, id_col)
    w = Window.partitionBy(id_col).orderBy("pos")
    rows = token_proj.select(id_col, "pos", *[F.lead(parts[o], o).over(w).alias(f"_n{o}") if o else F.col(parts[0]).alias("_n0") for o in range(width)])
    rows = rows.where(F.col(f"_n{width - 1}").isNotNull())  # a full window starts here
    acc = F.col("_n0")
    for o in range(1, width):
        acc = F.zip_with(acc, F.col(f"_n{o}"), lambda a, b: a + b)
    if bias is not None:
        acc = F.zip_with(acc, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)
    value = F.transform(acc, lambda x: relu(x))
    pooled = rows.select(id_col, array_to_vector(value).alias("_v")).groupBy(id_col).agg(Summarizer.max(F.col("_v")).alias("_m"))
    return pooled.select(id_col, vector_to_array("_m").alias("vec"))


def linear_scores(doc_vectors: DataFrame, head: list[tuple[str, list[float], float]], id_col: str = "id") -> DataFrame:
    """one logit per label: w . vec + bias, long form (id, label, logit). No join: the head is a
    bounded parameter list turned into one array of (label, logit) per document, then exploded."""
    per_label = F.array(*[F.struct(F.lit(lab).alias("label"), (dot_literal(F.col("vec"), w) + F.lit(float(b))).alias("logit")) for lab, w, b in head])
    return doc_vectors.select(id_col, F.inline(per_label))
