"""Tokens, vocabularies, dictionaries and word vectors.

Tables, not dictionaries: a vocabulary is a DataFrame ``(token, id, freq)``; lookups are joins. A lookup
table is broadcast by its size in bytes, which the planner knows because lookups are written tables; a larger
one is joined by a shuffle on the token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.functions.math import zeros
from commentlab.operators.order import global_rank
from commentlab.session import cut_lineage

UNK, PAD = "<unk>", "<pad>"
RESERVED = ("[PADDING]", "[UNK]", "[END]")  # fixed values



def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to a written lookup table on ``key``: one plan and one schema for every size.

    Spark broadcasts the lookup when the bytes of its files are below ``spark.sql.autoBroadcastJoinThreshold``;
    otherwise both sides are shuffled on the key, and AQE splits the partitions of hot keys."""
    return rows.join(lookup, key, how)


def explode_tokens(df: DataFrame, id_col: str, tokens: Column, pos_col: str = "pos", token_col: str = "token") -> DataFrame:
    """One row per token with its 0-based position; only id, position and token are kept."""
    return df.select(F.col(id_col), F.posexplode(tokens).alias(pos_col, token_col))


def first_tokens(df: DataFrame, id_col: str, tokens: Column, max_len: int, pad: int = 0, pos_col: str = "pos", token_col: str = "token") -> DataFrame:
    """The first ``max_len`` tokens of every row, cut inside the row, before they are rows of their own. A text without
    tokens (or a null one) is a row with a null position and token. Behind the tokens come up to ``pad`` padding tokens, as
    far as ``max_len`` leaves room."""
    return df.select(F.col(id_col), F.posexplode_outer(cut_tokens(tokens, max_len, pad)).alias(pos_col, token_col))


def cut_tokens(tokens: Column, max_len: int, pad: int = 0) -> Column:
    """The tokens of ``first_tokens``, as the list of one row."""
    cut = F.slice(F.coalesce(tokens, F.array().cast("array<string>")), 1, max_len)
    if pad:
        cut = F.concat(cut, F.array_repeat(F.lit(PAD), F.least(F.lit(pad), F.lit(max_len) - F.size(cut))))
    return cut


def padded_bag(df: DataFrame, id_col: str, tokens: Column, max_len: int, token_col: str = "token", count_col: str = "n") -> DataFrame:
    """The first ``max_len`` tokens of every row, once each with count 1, and one row for all its padding: the padding
    token with the number of places that are left. So the counts of every row, empty ones too, add up to ``max_len``."""
    entries = padded_entries(tokens, max_len, token_col, count_col)
    return df.select(F.col(id_col), F.inline(entries))


def padded_entries(tokens: Column, max_len: int, token_col: str = "token", count_col: str = "n") -> Column:
    """The tokens and counts of ``padded_bag``, as the list of one row."""
    cut = cut_tokens(tokens, max_len)
    entry = lambda token, n: F.struct(token.alias(token_col), n.cast("bigint").alias(count_col))
    left = F.lit(max_len) - F.size(cut)
    padding = F.when(left > 0, F.array(entry(F.lit(PAD), left))).otherwise(F.array().cast(f"array<struct<{token_col}:string,{count_col}:bigint>>"))
    return F.concat(F.transform(cut, lambda t: entry(t, F.lit(1))), padding)


def token_frequencies(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """Total count of each token (partial counts are combined map-side before the shuffle)."""
    return tokens.groupBy(token_col).agg(F.count(F.lit(1)).alias("freq"))


def token_difference(tokens: DataFrame, left: Column, right: Column, token_col: str = "token") -> DataFrame:
    """The different tokens of the rows ``left`` that no row ``right`` has. One pass: every token is one row with two flags
    before it is shuffled, where a difference of two frames would shuffle and sort the tokens of both one by one."""
    sides = tokens.groupBy(token_col).agg(F.max(F.coalesce(left, F.lit(False))).alias("_l"), F.max(F.coalesce(right, F.lit(False))).alias("_r"))
    return sides.where(F.col("_l") & ~F.col("_r")).select(token_col)


def build_vocab(tokens: DataFrame, min_freq: int = 10, specials: Sequence[str] = (UNK, PAD), token_col: str = "token") -> DataFrame:
    """E7 + W5: tokens with total count >= ``min_freq``; ids 0.. for ``specials``, then frequency
    descending, ties by token. Result ``(token, id, freq, rank)``, materialised in the shared folder."""
    return vocab_from_counts(token_frequencies(tokens, token_col), min_freq, specials, token_col)


def split_frequencies(tokens: DataFrame, splits: DataFrame, fit_on: Sequence[str] = ("train",), id_col: str = "id", token_col: str = "token") -> DataFrame:
    """Token counts over the documents whose row ``(id, split)`` names one of the splits in ``fit_on``. The documents
    are picked before their tokens are counted."""
    chosen = splits.where(F.col("split").isin(*fit_on)).select(id_col)
    return token_frequencies(tokens.join(chosen, id_col, "left_semi"), token_col)


def vocab_from_counts(counts: DataFrame, min_freq: int = 10, specials: Sequence[str] = (UNK, PAD), token_col: str = "token") -> DataFrame:
    """``build_vocab`` from an existing (token, freq) table, so one token count serves several uses."""
    spark = counts.sparkSession
    freq = counts.where(F.col("freq") >= min_freq)
    if specials:
        freq = freq.where(~F.col(token_col).isin(*specials))
    ranked = global_rank(freq, [F.col("freq").desc(), F.col(token_col)], rank_col="rank")
    base = len(specials) - 1
    words = ranked.select(token_col, (F.col("rank") + F.lit(base)).cast("bigint").alias("id"), "freq", "rank")
    reserved = spark.createDataFrame(
        [(t, i, 0, None) for i, t in enumerate(specials)], f"{token_col} string, id bigint, freq bigint, rank bigint"
    )
    return cut_lineage(reserved.unionByName(words))


def dictionary_ids(tokens: DataFrame, start_id: int = 1, reserved: Sequence[str] = RESERVED, token_col: str = "token") -> DataFrame:
    """Dense ids from ``start_id``; reserved tokens first, then every distinct token by frequency
    descending, ties by token. A token is added once (reserved ids win)."""
    spark = tokens.sparkSession
    freq = token_frequencies(tokens, token_col)
    if reserved:
        freq = freq.where(~F.col(token_col).isin(*reserved))
    ranked = global_rank(freq, [F.col("freq").desc(), F.col(token_col)], rank_col="rank")
    words = ranked.select(token_col, (F.col("rank") + F.lit(start_id + len(reserved) - 1)).cast("bigint").alias("id"))
    fixed = spark.createDataFrame([(t, start_id + i) for i, t in enumerate(reserved)], f"{token_col} string, id bigint")
    return fixed.unionByName(words)


def encode_tokens(tokens: DataFrame, vocab: DataFrame, unk_id: int = 0, token_col: str = "token", id_col: str = "token_id") -> DataFrame:
    """Token -> id with ``unk_id`` for misses; the null token of a text without tokens stays null. The token rows keep their partitioning when the
    vocabulary is broadcast, so a later group-by on the document id needs no new shuffle."""
    out = lookup_join(tokens, vocab.select(F.col(token_col), F.col("id").alias(id_col)), token_col, "left")
    known = F.coalesce(F.col(id_col), F.lit(unk_id)).cast("bigint")
    return out.withColumn(id_col, F.when(F.col(token_col).isNotNull(), known))


def vectors_in_vocab(vectors: DataFrame, vocab: DataFrame, token_col: str = "token") -> DataFrame:
    """D3: keep the word vectors whose token is in the vocabulary (left-semi join)."""
    return lookup_join(vectors, vocab.select(token_col), token_col, "left_semi")


def oov_tokens(vocab: DataFrame, vectors: DataFrame, token_col: str = "token") -> DataFrame:
    """Vocabulary tokens without a vector (left-anti join)."""
    return vocab.join(vectors.select(token_col), token_col, "left_anti")


def embedding_matrix(
    vocab: DataFrame, vectors: DataFrame, dim: int, default: str = "zeros", seed: int = 0, token_col: str = "token"
) -> DataFrame:
    """``(id, token, found, vec)`` — every vocabulary id with its vector; a miss gets zeros or a
    seeded uniform(-0.5, 0.5) vector (the seed and the id fix it, so a rerun gives the same numbers)."""
    joined = vocab.select("id", token_col).join(vectors.select(token_col, F.col("vec").cast("array<double>").alias("vec")), token_col, "left")
    if default == "zeros":
        fill = zeros(dim)
    elif default == "uniform":
        fill = F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)) - F.lit(0.5),
        )
    else:
        raise ValueError("default must be 'zeros' or 'uniform'")
    return joined.select("id", token_col, F.col("vec").isNotNull().alias("found"), F.coalesce(F.col("vec"), fill).alias("vec"))


def vocab_coverage(matrix: DataFrame) -> DataFrame:
    """Vocabulary size, vector dimension, tokens looked for and tokens found."""
    return matrix.agg(
        F.count(F.lit(1)).alias("vocab_size"),
        F.max(F.size("vec")).cast("bigint").alias("dim"),
        F.count(F.lit(1)).alias("looked_for"),
        F.sum(F.col("found").cast("bigint")).alias("found"),
    )


def max_seq_len(seqs: DataFrame, seq_col: str) -> DataFrame:
    """The longest sequence."""
    return seqs.agg(F.max(F.size(seq_col)).cast("bigint").alias("max_seq_len"))
