"""Encoded sequences and per-token vectors.

The token table ``(id, pos, token_id)`` comes from a narrow ``posexplode`` of the document rows followed by
a broadcast lookup, so all tokens of a document sit in the partition that read the document. A group-by
on the document id therefore combines each document completely on the map side, and the shuffle carries
one row per document, not one per token.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from commentlab.functions.math import pad_left, pad_right, position_ids
from commentlab.operators.vocab import lookup_join
from commentlab.session import cut_lineage, scratch_path


def to_sequence(encoded: DataFrame, id_col: str = "id", pos_col: str = "pos", value_col: str = "token_id", seq_col: str = "seq") -> DataFrame:
    """Gather a document's values back into an array ordered by position; a document whose one row has no position
    (``vocab.first_tokens``) has an empty array."""
    item = F.when(F.col(pos_col).isNotNull(), F.struct(F.col(pos_col), F.col(value_col)))
    gathered = encoded.groupBy(id_col).agg(F.sort_array(F.collect_list(item)).alias("_pv"))
    return gathered.select(id_col, F.transform("_pv", lambda s: s[value_col]).alias(seq_col))


def padded(seqs: DataFrame, n: int, pad: int = 1, side: str = "right", seq_col: str = "seq", out_col: str = "padded") -> DataFrame:
    """Truncate to ``n`` and pad with ``pad`` on the right (default) or the left."""
    f = pad_right if side == "right" else pad_left
    return seqs.withColumn(out_col, f(seq_col, n, pad))


def with_positions(seqs: DataFrame, pad: int = 1, seq_col: str = "padded", out_col: str = "positions") -> DataFrame:
    """R4."""
    return seqs.withColumn(out_col, position_ids(seq_col, pad))


def one_hot_bag(encoded: DataFrame, id_col: str = "id", token_id_col: str = "token_id") -> DataFrame:
    """Sparse binary bag of one-hots per document, long form (id, token_id, value=1)."""
    return encoded.select(id_col, token_id_col).distinct().withColumn("value", F.lit(1))


def sparse_vectors(entries: DataFrame, size: int, id_col: str = "id", index_col: str = "token_id", value_col: str | None = None, out_col: str = "vector") -> DataFrame:
    """R5 / B4 in ML form: one sparse vector of ``size`` entries per id from rows (id, index[, value]); rows of the same index
    count once (their largest value; 1 without ``value_col``), zeros and null indices are left out, and an id without entries has an
    empty vector. Indices are grouped by id in Spark, so that no list of the vocabulary exists anywhere; the vectors
    are written as the columns that an ML vector consists of and read back as vectors.

    An index outside 0..size-1 is an error."""
    index = F.col(index_col).cast("int")
    value = F.lit(1.0) if value_col is None else F.col(value_col).cast("double")
    wrong = F.raise_error(F.concat_ws(" ", F.lit(f"index outside 0..{size - 1}:"), F.col(index_col).cast("string")))
    checked = F.when(F.col(index_col).isNull() | ((F.col(index_col) >= 0) & (F.col(index_col) < size)), index).otherwise(wrong.cast("int"))
    per_entry = entries.groupBy(F.col(id_col), checked.alias("_i")).agg(F.max(value).alias("_v"))
    pair = F.when(F.col("_i").isNotNull() & (F.col("_v") != 0), F.struct("_i", "_v"))
    rows = per_entry.groupBy(id_col).agg(F.sort_array(F.collect_list(pair)).alias("_p"))
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"),  # fixed value: 0 marks a sparse vector
        F.lit(size).alias("size"),
        F.transform("_p", lambda p: p["_i"]).alias("indices"),
        F.transform("_p", lambda p: p["_v"]).alias("values"),
    )
    path = scratch_path(entries.sparkSession, "sparse-vectors")
    rows.select(F.col(id_col), parts.alias(out_col)).write.parquet(path)
    schema = StructType([entries.schema[id_col], StructField(out_col, VectorUDT())])
    return entries.sparkSession.read.schema(schema).parquet(path)


def sequence_vectors(encoded: DataFrame, matrix: DataFrame, token_id_col: str = "token_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Each token id replaced by its row of the embedding matrix ``(id, vec, *extra)``; a null id has no vector and goes."""
    m = matrix.select(F.col("id").alias(token_id_col), F.col("vec").cast("array<double>").alias("vec"), *extra)
    return lookup_join(encoded, m, token_id_col, "inner")


def softmax_long(df: DataFrame, group_col: str, score_col: str, out_col: str = "p") -> DataFrame:
    """M4 long form: exp(s - max) / sum(exp(s - max)) within each group (no window over a large group).

    The input is counted once by (group, score), combined map-side; maximum and sum come from these counts, and the input
    is joined once, with one row per group."""
    counted = cut_lineage(df.groupBy(F.col(group_col).alias("_g"), F.col(score_col).alias("_s")).agg(F.count(F.lit(1)).alias("_n")), "score-counts")
    top = counted.groupBy(F.col("_g").alias("_t")).agg(F.max("_s").alias("_m"))
    around = counted.join(top, F.col("_g").eqNullSafe(F.col("_t")))
    stats = around.groupBy("_g").agg(F.max("_m").alias("_m"), F.sum(F.col("_n") * F.exp(F.col("_s") - F.col("_m"))).alias("_z"))
    out = df.join(stats, F.col(group_col).eqNullSafe(F.col("_g")))
    return out.withColumn(out_col, F.exp(F.col(score_col) - F.col("_m")) / F.col("_z")).drop("_g", "_m", "_z")
