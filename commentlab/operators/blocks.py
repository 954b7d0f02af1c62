"""Documents in blocks, for work that needs the looked-up row of every token.

A look-up per token would send a vector per token to the documents, or the tokens to the vectors and a part of every
document back from each. Here a block is some thousand documents by a hash of their id, kept as one row per document with
its tokens. The different tokens of a block are looked up once (a join on the token, as for single tokens), and a
co-group brings the block's documents and its looked-up rows into one task, where numpy adds up along the documents. So
tokens are shuffled as texts are, and vectors once per block and different token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from commentlab.session import cut_lineage

BLOCK_TOKENS = 4_000_000  # tokens of a block, about
STEP = 1 << 16  # tokens whose vectors are held at once
BETWEEN = "\n"  # no token holds it; a list of strings takes four times its bytes in a shuffle


def block_count(n_tokens: int) -> int:
    return 1 + n_tokens // BLOCK_TOKENS


def document_blocks(docs: DataFrame, tokens: Column, n_blocks: int, counts: Column | None = None, id_col: str = "id") -> DataFrame:
    """``(block, id, tokens[, counts])``, written once, so that the two sides of a co-group see the same blocks. Rows of the
    same id, or with a null id, share a block. Rows are shuffled as they come, as texts, and split into tokens behind it."""
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int")
    dealt = docs.withColumn("block", block).repartition("block")
    rows = dealt.select("block", id_col, tokens.alias("tokens"), *([] if counts is None else [counts.alias("counts")]))
    return cut_lineage(rows, "document-blocks")


def block_tokens(blocks: DataFrame) -> DataFrame:
    """``(block, token)``: the different tokens of every block."""
    return blocks.select("block", F.explode("tokens").alias("token")).distinct()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A numeric column, or a list column of one length as a matrix."""
    array = column.combine_chunks()
    if not (pa.types.is_list(array.type) or pa.types.is_large_list(array.type)):
        return array.to_numpy(zero_copy_only=False)
    flat = array.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.unique(pc.list_value_length(array)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths}")
    return flat.reshape(len(array), -1)


class Places:
    """The places of a block's documents that have a looked-up row: ``doc`` (place in ``ids``, ascending), ``pos``,
    ``count`` and ``row`` (of the looked-up rows). Documents of the same id are one, ordered by position."""

    def __init__(self, docs: pa.Table, looked_up: pa.Table, id_col: str):
        ids = docs[id_col].combine_chunks().dictionary_encode(null_encoding="encode")
        code, self.ids = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), ids.dictionary
        tokens = pc.split_pattern(docs["tokens"].combine_chunks(), BETWEEN)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(code, lengths)
        pos = np.arange(len(doc), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        count = docs["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if "counts" in docs.column_names else None
        known = looked_up["token"].combine_chunks().dictionary_encode()
        at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = np.flatnonzero(at >= 0) if (at < 0).any() else slice(None)
        if len(self.ids) < len(code):
            order = np.lexsort((pos, doc))
            keep = order[at[order] >= 0]
        self.doc, self.pos, at = doc[keep], pos[keep], at[keep]
        self.count = None if count is None else count[keep]
        of = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self._rows, self._many = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(known.dictionary))
        self._first, self._at = np.cumsum(self._many) - self._many, at
        self.row = self.matched()

    def matched(self) -> np.ndarray:
        """The looked-up row of every place; a token that has several makes as many places of each of its own."""
        many = self._many[self._at]
        if len(many) and many.max() > 1:
            at, start = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
            nth = np.arange(len(at)) - np.repeat(start, many)
            self.doc, self.pos, self._at = self.doc[at], self.pos[at], self._at[at]
            self.count = None if self.count is None else self.count[at]
            self.repeated = at
            return self._rows[self._first[self._at] + nth]
        self.repeated = None
        return self._rows[self._first[self._at]]

    def weights(self) -> np.ndarray:
        return np.ones(len(self.doc)) if self.count is None else self.count.astype(np.float64)

    def steps(self, overlap: int = 0) -> Iterator[slice]:
        for a in range(0, max(len(self.doc) - overlap, 0), STEP):
            yield slice(a, min(a + STEP, len(self.doc) - overlap))


def _starts(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])


def weighted_sums(places: Places, vectors: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """Per document the sum of its places' vectors, each times its weight."""
    sums = np.zeros((len(places.ids), vectors.shape[1]))
    for s in places.steps():
        part, doc = vectors[places.row[s]], places.doc[s]
        if weight is not None:
            part = part * weight[s, None]
        starts = _starts(doc)
        sums[doc[starts]] += np.add.reduceat(part, starts, axis=0)
    return sums


def _list_column(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _per_block(blocks: DataFrame, looked_up: DataFrame, fn: Callable[[Places, pa.Table], pa.Table], fields: Sequence[StructField], id_col: str) -> DataFrame:
    schema = StructType([StructField(id_col, blocks.schema[id_col].dataType), *fields])
    result = to_arrow_schema(schema)

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if docs.num_rows == 0 or rows.num_rows == 0:
            return result.empty_table()
        return fn(Places(docs, rows, id_col), rows).cast(result)

    held = F.exists("tokens", lambda t: t.contains(BETWEEN))
    joined = F.when(held, F.raise_error(F.lit("a token holds a line break"))).when(F.size("tokens") > 0, F.array_join("tokens", BETWEEN))
    docs = blocks.select(F.col("block").alias("of_block"), joined.alias("tokens"), *[c for c in blocks.columns if c not in ("block", "tokens")])
    return docs.groupBy("of_block").cogroup(looked_up.groupBy("block")).applyInArrow(run, schema)


def _vectors_of(places: Places, chosen: np.ndarray, id_col: str, vectors: np.ndarray, **more: np.ndarray) -> pa.Table:
    columns = {id_col: places.ids.take(pa.array(chosen))} | {k: pa.array(v[chosen]) for k, v in more.items()}
    return pa.table(columns | {"vec": _list_column(vectors[chosen])})


_VEC = StructField("vec", ArrayType(DoubleType()))


def mean_vectors(blocks: DataFrame, looked_up: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, n, vec)``: the mean of ``vec`` over the places of each document (``n`` of them, by the counts if there are any)."""

    def fn(places: Places, rows: pa.Table) -> pa.Table:
        n = np.bincount(places.doc, weights=places.weights(), minlength=len(places.ids))
        sums = weighted_sums(places, _numbers(rows["vec"]), None if places.count is None else places.weights())
        chosen = np.flatnonzero(n)
        return _vectors_of(places, chosen, id_col, sums / np.where(n == 0, 1, n)[:, None], n=n.astype(np.int64))

    return _per_block(blocks, looked_up.select("block", "token", "vec"), fn, [StructField("n", LongType()), _VEC], id_col)


def softmax_vectors(blocks: DataFrame, looked_up: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, vec)``: the mean of ``vec`` over the places of each document, weighted by the softmax of ``score`` over them."""

    def fn(places: Places, rows: pa.Table) -> pa.Table:
        score = _numbers(rows["score"])[places.row]
        places.row = places.matched()  # scores and vectors are looked up apart: each score meets every vector of its token
        if places.repeated is not None:
            score = score[places.repeated]
        starts = _starts(places.doc) if len(places.doc) else np.zeros(0, np.int64)
        top = np.zeros(len(places.ids))
        top[places.doc[starts]] = np.maximum.reduceat(score, starts) if len(starts) else 0
        weight = places.weights() * np.exp(score - top[places.doc])
        total = np.bincount(places.doc, weights=weight, minlength=len(places.ids))
        sums = weighted_sums(places, _numbers(rows["vec"]), weight)
        chosen = np.unique(places.doc)
        return _vectors_of(places, chosen, id_col, sums / np.where(total == 0, 1, total)[:, None])

    return _per_block(blocks, looked_up.select("block", "token", "vec", "score"), fn, [_VEC], id_col)


def window_maxima(blocks: DataFrame, looked_up: DataFrame, parts: Sequence[str], bias: Sequence[float] | None = None, id_col: str = "id") -> DataFrame:
    """``(id, vec)``: per document and entry the largest max(0, parts[0] + parts[1] of the next place + ... + bias) over its
    places that have so many behind them; a document with fewer has no row."""
    width = len(parts)

    def fn(places: Places, rows: pa.Table) -> pa.Table:
        proj = [_numbers(rows[p]) for p in parts]
        best = np.full((len(places.ids), proj[0].shape[1]), -1.0)
        for s in places.steps(width - 1):
            row = [places.row[s.start + o : s.stop + o] for o in range(width)]
            doc = places.doc[s]
            full = np.flatnonzero(doc == places.doc[s.start + width - 1 : s.stop + width - 1])
            if len(full) == 0:
                continue
            value = proj[0][row[0][full]]
            for o in range(1, width):
                value = value + proj[o][row[o][full]]
            if bias is not None:
                value = value + np.asarray(bias, dtype=np.float64)
            value, doc = np.maximum(value, 0.0), doc[full]
            starts = _starts(doc)
            at = doc[starts]
            best[at] = np.maximum(best[at], np.maximum.reduceat(value, starts, axis=0))
        return _vectors_of(places, np.flatnonzero(best[:, 0] >= 0), id_col, best)

    return _per_block(blocks, looked_up.select("block", "token", *parts), fn, [_VEC], id_col)


def place_rows(blocks: DataFrame, looked_up: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(id, pos, *columns)``: one row per place of each document, with plain columns of its looked-up row."""
    fields = [StructField("pos", IntegerType()), *[looked_up.schema[c] for c in columns]]

    def fn(places: Places, rows: pa.Table) -> pa.Table:
        at = pa.array(places.row)
        found = {c: rows[c].combine_chunks().take(at) for c in columns}
        return pa.table({id_col: places.ids.take(pa.array(places.doc)), "pos": pa.array(places.pos.astype(np.int32))} | found)

    return _per_block(blocks, looked_up.select("block", "token", *columns), fn, fields, id_col)
