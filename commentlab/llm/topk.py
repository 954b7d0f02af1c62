"""Exact top-k inner products by no-random-access aggregation (Fagin, Lotem and Naor, 2001).

Candidates are cut into blocks; a block is nothing but one list per dimension, of its (value, candidate) entries in order of
the values. There is no table of whole rows. A query reads list d from its upper end where its weight is positive, else
from its lower end, so that the contributions of a list fall; lists of weight 0 are not read.

All lists are read in steps, to the same depth. What a candidate has shown so far is a sum; for each list in which it
has not been met, the contribution read last bounds it from above and the far end of the list from below. The k-th best lower
bound, or the k-th best score found in blocks before, is the line. A candidate whose upper bound stays below the line
is an outsider. Reading stops when all are outsiders; otherwise it goes on until the candidates left have been met in every
list, and so resolves their scores.

Queries read a block's lists in step. What the entries met so far say of each candidate and list, at best and at worst, is
a table of the block and the depth, the same for all queries; so the bounds of many queries are one product of
their weights with that table. A query leaves when its reading stops. Candidates that are outsiders to all queries of such a
group are not looked at any more once they are half of the rest.

A task holds a few blocks and a group of queries of bounded size; a query takes its line from one block to the next.

Scores are sums of whole numbers and exact: floats while all sums stay below 2^53; beyond, scores are summed up as Python
integers. Bounds, in single precision where scores are floats, get a margin for their rounding. A score that does not fit a long is an error. Ties go to the smaller id.
Cases: vectors that are null or hold null or non-finite components, and null ids, take no part; a shorter vector counts
as filled up with zeros; rows that repeat an id are rows of their own (a query leaves out only itself); with fewer than k other
rows all are returned; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from commentlab.llm.common import write_table

K = 5
SCALE = 256
BLOCK = 4096  # candidates of a block
BLOCKS = 8  # blocks that one task holds, about
QUERIES_AT_ONCE = 16_384  # queries that one task holds
READ_AT_ONCE, TOGETHER = 2048, 256  # queries that read a block at the same time; those whose bounds are one product
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)  # of the lists, to which they are read before bounds are held against the line
EXACT = 1 << 53


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)`` with v the components floor(scale * x), x as double, as whole numbers in doubles."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long in Spark; from 2^53 on doubles are whole numbers themselves
    scaled = F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double"))
    small = lambda y: F.abs(y) < float(EXACT)
    whole = F.transform(scaled, lambda y: F.when(small(y), F.floor(F.when(small(y), y)).cast("double")).otherwise(y))
    return rows.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("v"))


class Query:
    """A query with the best (score, id) it has found; ``line`` is what another candidate must reach."""

    def __init__(self, weights: np.ndarray, row: int, k: int):
        self.weights, self.row, self.k = weights, row, k
        self.found: list[tuple[int, int]] = []  # (-score, id)
        self.line = -math.inf
        self.entries_read = self.entries_looked_at = 0

    def take(self, scores: list[int], ids: list[int]) -> None:
        new = ((-s, i) for s, i in zip(scores, ids, strict=True) if s >= self.line)
        self.found = heapq.nsmallest(self.k, chain(self.found, new))
        if len(self.found) == self.k:
            self.line = -self.found[-1][0]


class SortedLists:
    """The lists of a block: ``values[d]`` rises, ``entries[d]`` names the candidate of each value."""

    PARTS = {"rows": "<i8", "ids": "<i8", "values": "<f8", "entries": "<i4"}

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, entries: np.ndarray):
        self.rows, self.ids, self.values, self.entries = rows, ids, values, entries
        self.biggest = max(abs(float(values[:, 0].min())), abs(float(values[:, -1].max())))

    @classmethod
    def sort(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> SortedLists:
        entries = np.argsort(vectors, axis=0, kind="stable").T
        return cls(rows, ids, np.take_along_axis(vectors.T, entries, axis=1), entries)

    def to_row(self) -> dict:
        return {name: np.ascontiguousarray(getattr(self, name), dtype=kind).tobytes() for name, kind in self.PARTS.items()}

    @classmethod
    def from_row(cls, row: dict) -> SortedLists:
        parts = {name: np.frombuffer(row[name], dtype=kind) for name, kind in cls.PARTS.items()}
        n = len(parts["ids"])
        return cls(parts["rows"], parts["ids"], parts["values"].reshape(-1, n), parts["entries"].reshape(-1, n))

    def known(self, lists: np.ndarray, depth: int, at_best: bool, kind: type) -> np.ndarray:
        """What entries met to ``depth`` say of each candidate's value in ``lists`` read from the upper end and, below, from the
        lower: the value if met, else the one read last (``at_best``) or the one at the list's far end."""
        m = len(self.ids)
        out = np.empty((2, len(lists), m), dtype=kind)
        met, unmet = (slice(m - depth, m), slice(0, depth)), (m - depth, depth - 1) if at_best else (0, m - 1)
        for half, those, other in zip(out, met, unmet, strict=True):
            half[:] = self.values[lists, other][:, None]
            np.put_along_axis(half, self.entries[lists, those], self.values[lists, those], axis=1)
        return out.reshape(-1, m)

    def search(self, query: Query) -> None:
        """Take what the block's candidates add to ``query``."""
        self.search_all([query])

    def search_all(self, queries: list[Query]) -> None:
        """Take what the block's candidates add to each of ``queries``."""
        if not queries:
            return
        weights = np.array([q.weights for q in queries])
        largest = np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1]))
        with np.errstate(over="ignore", invalid="ignore"):
            reach = np.abs(weights) @ largest  # no score and no bound is further from 0
            exact = reach < EXACT
            for these, kind in ((exact, np.float32), (~exact, np.float64)):
                if these.any():
                    lists = np.flatnonzero((weights[these] != 0).any(axis=0) & (largest > 0))
                    self._search([queries[i] for i in np.flatnonzero(these)], weights[these][:, lists], reach[these], lists, kind)

    def _search(self, queries: list[Query], weights: np.ndarray, reach: np.ndarray, lists: np.ndarray, kind: type) -> None:
        m = len(self.ids)
        margin = (len(lists) + 4) * float(np.finfo(kind).eps) * reach  # a product's rounding, twice
        parts = [slice(at, at + TOGETHER) for at in range(0, len(queries), TOGETHER)]
        readers = [Reading(self, queries[p], weights[p], margin[p], kind) for p in parts]
        depth = 0
        for share in DEPTHS:
            last = math.ceil(m * share)
            if last == depth or not readers:
                continue
            for r in readers:
                r.count(self.entries[lists], depth, last)
            depth = last
            if depth < m:
                best = self.known(lists, depth, True, kind)
                worst = self.known(lists, depth, False, kind) if any(r.first.any() for r in readers) else None
                readers = [r for r in readers if r.bound(best, worst)]
        if readers:
            whole = self.known(lists, m, True, np.float64)[: len(lists)]
            for r in readers:
                r.finish(whole)

    def resolve_large(self, query: Query, left: np.ndarray) -> list[int]:
        """Scores of the candidates ``left`` as Python integers, from their entries in a second reading of the lists."""
        number = {c: i for i, c in enumerate(left.tolist())}
        sums = [0] * len(left)
        for d in np.flatnonzero(query.weights).tolist():
            weight, who = int(query.weights[d]), self.entries[d]
            mine = np.flatnonzero(np.isin(who, left))
            query.entries_read += len(who)
            query.entries_looked_at += len(mine)
            for c, v in zip(who[mine].tolist(), self.values[d][mine].tolist(), strict=True):
                sums[number[c]] += weight * int(v)
        return sums


class Reading:
    """Queries that read the lists of a block in step. ``left`` are the candidates that may qualify for any, and some outsiders."""

    def __init__(self, block: SortedLists, queries: list[Query], weights: np.ndarray, margin: np.ndarray, kind: type):
        self.block, self.queries, self.weights, self.margin, self.kind = block, queries, weights, margin, kind
        self.line = np.array([q.line for q in queries], dtype=np.float64)
        self.first = np.isneginf(self.line)  # no block before has given a line: it comes from lower bounds
        self.left = np.arange(len(block.ids))
        place = {row: i for i, row in enumerate(block.rows.tolist())}
        self.own = np.array([place.get(q.row, -1) for q in queries])  # a query is not its own candidate

    def count(self, entries: np.ndarray, first: int, last: int) -> None:
        """Note the entries from depth ``first`` to ``last``."""
        m, n_left = len(self.block.ids), len(self.left)
        up, down = self.weights > 0, self.weights < 0
        read = looked_at = (up.sum(axis=1) + down.sum(axis=1)) * (last - first)
        if n_left < m:
            mine = np.zeros(m, dtype=bool)
            mine[self.left] = True
            looked_at = up @ mine[entries[:, m - last : m - first]].sum(axis=1) + down @ mine[entries[:, first:last]].sum(axis=1)
        for q, n, k in zip(self.queries, read.tolist(), looked_at.tolist(), strict=True):
            q.entries_read += n
            q.entries_looked_at += k

    def _of_left(self, weights: np.ndarray, table: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Weighted sums for the candidates left; -inf for a query itself."""
        sums = weights @ (table if len(self.left) == table.shape[1] else table[:, self.left])
        at = np.minimum(np.searchsorted(self.left, own), len(self.left) - 1)
        held = np.flatnonzero(self.left[at] == own)
        sums[held, at[held]] = -math.inf
        return sums

    def bound(self, best: np.ndarray, worst: np.ndarray | None) -> bool:
        """Hold bounds against the lines; False if all queries are done with the block."""
        weights = np.concatenate([np.maximum(self.weights, 0), np.minimum(self.weights, 0)], axis=1).astype(self.kind)
        k, n = self.queries[0].k, len(self.left)
        first = np.flatnonzero(self.first)
        if len(first) and n >= k:
            lower = self._of_left(weights[first], worst, self.own[first])
            self.line[first] = np.maximum(self.line[first], np.partition(lower, n - k, axis=1)[:, n - k] - self.margin[first])
        upper = self._of_left(weights, best, self.own)
        stay = ~(upper < (self.line - self.margin).astype(self.kind)[:, None]) & ~np.isneginf(upper)
        self._keep(stay.any(axis=1))
        may = np.flatnonzero(stay.any(axis=0))
        if 2 * len(may) <= n:
            self.left = self.left[may]
        return len(self.queries) > 0

    def _keep(self, these: np.ndarray) -> None:
        self.queries = [q for q, kept in zip(self.queries, these.tolist(), strict=True) if kept]
        arrays = self.weights, self.margin, self.line, self.first, self.own
        self.weights, self.margin, self.line, self.first, self.own = (x[these] for x in arrays)

    def finish(self, whole: np.ndarray) -> None:
        """Resolve the scores of the candidates left."""
        scores, exact = self._of_left(self.weights, whole, self.own), self.kind is np.float32
        spare = np.zeros(len(self.queries)) if exact else self.margin
        for query, own, line, more in zip(self.queries, scores, self.line.tolist(), spare.tolist(), strict=True):
            hits = np.flatnonzero(~(own < line - more) & ~np.isneginf(own))
            if len(hits) > query.k:
                kth = np.partition(own[hits], len(hits) - query.k)[-query.k]
                hits = hits[~(own[hits] < kth - 2 * more)]
            if len(hits):
                left = self.left[hits]
                found = own[hits].astype(np.int64).tolist() if exact else self.block.resolve_large(query, left)
                query.take(found, self.block.ids[left].tolist())


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    sizes = pc.list_value_length(column).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = pc.list_flatten(column).to_numpy()
    return out


_LISTS = "slot int, " + ", ".join(f"{name} binary" for name in SortedLists.PARTS)


def _cut_blocks(dims: int, slots: int, block: int):
    schema = pa.schema([("slot", pa.int32()), *[(name, pa.binary()) for name in SortedLists.PARTS]])

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        made = SortedLists.sort(table.column("row").to_numpy(), table.column("id").to_numpy(), _vectors(table.column("v"), dims))
        return pa.RecordBatch.from_pylist([{"slot": TaskContext.get().partitionId() % slots} | made.to_row()], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == block:
                    yield lists(held)
                    held, n = [], 0
        if n:
            yield lists(held)

    return run


_FOUND = pa.schema([(name, pa.int64()) for name in ("row", "query_id", "vec_id", "score")])


def _search(dims: int, k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        lists = [SortedLists.from_row(b) for b in blocks.to_pylist()] if queries.num_rows else []
        for at in range(0, queries.num_rows if lists else 0, READ_AT_ONCE):
            some = queries.slice(at, READ_AT_ONCE)
            ids, weights = some.column("id").to_pylist(), _vectors(some.column("v"), dims)
            asking = [Query(w, row, k) for w, row in zip(weights, some.column("row").to_pylist(), strict=True)]
            for block in lists:
                block.search_all(asking)
            out += [(q.row, i, found, -minus) for q, i in zip(asking, ids, strict=True) for minus, found in q.found]
        columns = zip(*out, strict=True) if out else [[]] * len(_FOUND)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every row of ``(id, v)`` that ``is_query`` holds for."""
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint").alias("id"), "v")
    vectors = write_table(numbered, "integer-vectors")
    n, asked, dims = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims, groups, slots = max(1, dims), max(1, -(-asked // queries_at_once)), max(1, -(-n // (block * BLOCKS)))

    dealt = vectors.repartition(max(1, -(-n // block)), F.xxhash64("row"))
    blocks = write_table(dealt.mapInArrow(_cut_blocks(dims, slots, block), _LISTS), "sorted-lists")
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = vectors.where(is_query).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    queries = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = blocks.groupBy("slot", "group").cogroup(queries.groupBy("slot", "group"))
    found = write_table(found.applyInArrow(_search(dims, k), "row bigint, query_id bigint, vec_id bigint, score bigint"), "winners-by-slot")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
