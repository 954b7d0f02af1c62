"""Hard-negative mining by cover trees over norm-augmented candidates.

Every candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm of its block, so that all candidates
lie on one sphere. A tree over them has levels of falling covering radius: the children of a node are a net of its points,
so that every point lies within the level's radius of its child's centre, and the child keeps the radius that its own
points really have. Points with (next to) none beside them are a leaf of their node. Levels start at half the sphere's
radius, since wider nodes bound nothing. With an anchor q (its extra component is 0), the inner products of a node's
points lie between <q, c> - |q| r and <q, c> + |q| r.

A search asks a tree for the best rows whose scores lie in one or more windows. It descends best first, by the upper
bound; a node is skipped when every window lies outside its bounds or is already filled with better rows; the points
of a leaf are scored exactly. Rows are dealt to blocks of bounded size, with equal labels beside each other, and every
block is one tree. A task holds a few trees and a group of anchors of bounded size, and takes what an anchor has found
in one tree to the next; the k best rows a window of all tasks remain.

1. Positives: rows of the anchor's label, in a window without ends.
2. Negatives: rows of other labels, in one window a positive, from ``low`` of its score up to its score.

Scores are exact: floats while all products stay below 2^53, Python integers beyond; a score that does not fit a long
is an error. Bounds in floats get a margin that covers their rounding.

Cases: rows with a null id or label, and null vectors or vectors with null or non-finite components, take no part; a shorter
vector counts as filled up with zeros; rows that repeat an id are rows of their own (an anchor skips only itself), and
a repeated anchor is mined each time; ties go to the smaller id; a negative positive score leaves an empty
window; with fewer than k rows all are returned; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from commentlab.llm.common import write_table

SCALE = 256
POSITIVES = NEGATIVES = 5
LOW = (80, 100)  # a negative scores at least 80/100 of the positive
BLOCK = 4096  # candidates a tree
ANCHORS_AT_ONCE = 16_384  # anchors that one task holds
TREES = 4  # trees that one task holds, about
LEAF = 48  # points of a leaf
CROWD = 4  # points that make a child of their own
WIDEST, SHRINK = 0.5, 0.7  # covering radius of the first level in radii of the sphere, and from level to level
EXACT = 1 << 53


def integer_rows(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, label, v)``: v holds the components floor(scale * x), x as double, as whole numbers in doubles."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long in Spark; from 2^53 on doubles are whole numbers themselves
    scaled = F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double"))
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < float(EXACT), F.floor(F.when(F.abs(y) < float(EXACT), y)).cast("double")).otherwise(y))
    return rows.where(usable & F.col(id_col).isNotNull() & label.isNotNull()).select(F.col(id_col).alias("id"), label.alias("label"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


class CoverTree:
    """Cover tree over the rows of one block; ``rows``, ``ids``, ``labels`` and ``vectors`` are in leaf order.

    Node n has the centre ``centre[n]``, the radius ``radius[n]``, the points ``start[n]`` to ``stop[n]`` and the
    children ``first[n]`` to ``last[n]``; without children it is a leaf.
    """

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)
        self.biggest = np.abs(self.vectors).max(initial=0.0)

    PARTS = {
        "rows": "<i8", "ids": "<i8", "labels": "<i8", "vectors": "<f8", "centre": "<f8", "radius": "<f8",
        "start": "<i4", "stop": "<i4", "first": "<i4", "last": "<i4",
    }

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> CoverTree:
        unit = max(1.0, np.abs(vectors).max(initial=0.0))  # squares of huge components stay finite
        norms = ((vectors / unit) ** 2).sum(axis=1)
        raised = np.hstack([vectors / unit, np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))[:, None]])
        square = (raised**2).sum(axis=1)
        far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * raised @ raised.T, 0.0)).astype(np.float32)
        order = np.arange(len(rows))
        # breadth first, so that the children of a node follow each other; a node holds order[start:stop]
        top = WIDEST / SHRINK * math.sqrt(float(norms.max(initial=0.0)))
        nodes = [{"centre": 0, "start": 0, "stop": len(rows), "cover": top, "leaf": False}]
        at = 0
        while at < len(nodes):
            node = nodes[at]
            at += 1
            points = order[node["start"] : node["stop"]]
            node["radius"] = float(far[node["centre"], points].max())
            node["first"] = node["last"] = len(nodes)
            cover = min(node["cover"], node["radius"]) * SHRINK
            if node["leaf"] or len(points) <= LEAF or node["radius"] <= top * 1e-6:
                continue
            centres, owner = cls._net(far, points, node["centre"], cover)
            crowd = np.bincount(owner, minlength=len(centres))
            owner = np.where(crowd[owner] < CROWD, len(centres), owner)  # the lonely points come last
            by_owner = np.argsort(owner, kind="stable")
            order[node["start"] : node["stop"]] = points[by_owner]
            cuts = (node["start"] + np.searchsorted(owner[by_owner], np.arange(len(centres) + 2))).tolist()
            if cuts[-2] == node["start"]:
                continue  # all are lonely: a leaf
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    lonely = i == len(centres)
                    nodes.append({"centre": node["centre"] if lonely else centres[i], "start": a, "stop": b, "cover": cover, "leaf": lonely})
            node["last"] = len(nodes)
        ints = {k: np.array([n[k] for n in nodes], dtype=np.int32) for k in ("start", "stop", "first", "last")}
        radius = (np.array([n["radius"] for n in nodes]) + 1e-3 * top) * unit  # distances in single precision: rounded up
        centre = vectors[[n["centre"] for n in nodes]]
        return cls(rows=rows[order], ids=ids[order], labels=labels[order], vectors=vectors[order], centre=centre, radius=radius, **ints)

    @staticmethod
    def _net(far: np.ndarray, points: np.ndarray, centre: int, cover: float) -> tuple[list[int], np.ndarray]:
        """Centres, the node's own first, that cover ``points``, and the number of each point's nearest centre."""
        centres = [centre]
        nearest = far[centre, points].copy()
        owner = np.zeros(len(points), dtype=np.int64)
        while nearest.max() > cover:
            c = int(points[nearest.argmax()])
            d = far[c, points]
            closer = d < nearest
            owner[closer] = len(centres)
            nearest[closer] = d[closer]
            centres.append(c)
        return centres, owner

    def to_row(self) -> dict:
        return {name: np.ascontiguousarray(getattr(self, name), dtype=kind).tobytes() for name, kind in self.PARTS.items()}

    @classmethod
    def from_row(cls, row: dict, dims: int) -> CoverTree:
        parts = {name: np.frombuffer(row[name], dtype=kind) for name, kind in cls.PARTS.items()}
        return cls(**parts | {name: parts[name].reshape(-1, dims) for name in ("vectors", "centre")})

    def scores(self, query: np.ndarray, points: slice) -> np.ndarray:
        """Exact inner products with the points: int64, or Python integers where floats could round."""
        vectors = self.vectors[points]
        if np.abs(query).max(initial=0.0) * self.biggest * max(1, len(query)) < EXACT:
            return (vectors @ query).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in vectors.tolist()], dtype=object)

    def search(self, wish: Wish) -> None:
        """Take what the tree's rows add to ``wish``."""
        slack = 1e-9 * (1 + wish.size * float(self.biggest) * max(1, len(wish.query)))  # of the centres' float products
        heap = [(-math.inf, 0, -math.inf)]
        while heap:
            minus_upper, n, lower = heapq.heappop(heap)
            if -minus_upper < min(wish.floor):
                break
            if not wish.wants(lower, -minus_upper):
                continue
            a, b = int(self.first[n]), int(self.last[n])
            if a < b:
                middle = self.centre[a:b] @ wish.query
                out = self.radius[a:b] * wish.size + slack
                for child, m, o in zip(range(a, b), middle.tolist(), out.tolist(), strict=True):
                    if wish.wants(m - o, m + o):
                        heapq.heappush(heap, (-(m + o), child, m - o))
            else:
                points = slice(self.start[n], self.stop[n])
                wish.verified += points.stop - points.start
                wish.take(self.rows[points], self.ids[points], self.labels[points], self.scores(wish.query, points))


class Wish:
    """What an anchor looks for: the best k rows of the same (or of another) label in each window (lowest, highest)."""

    def __init__(self, query: np.ndarray, row: int, label: int, same: bool, windows: list[tuple], k: int):
        self.query, self.row, self.label, self.same, self.windows, self.k = query, row, label, same, windows, k
        unit = max(1.0, float(np.abs(query).max(initial=0.0)))
        self.size = math.sqrt(float((query / unit) @ (query / unit))) * unit * (1 + 1e-9)
        self.floor = [low for low, _ in windows]  # what a row must reach to count
        self.found: list[list[tuple]] = [[] for _ in windows]  # (-score, id)
        self.verified = 0

    def wants(self, lower: float, upper: float) -> bool:
        """Whether scores between the bounds may count in a window; unknown bounds (not a number) may."""
        return any(not (upper < f or lower > high) for f, (_, high) in zip(self.floor, self.windows, strict=True))

    def take(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        hits = np.flatnonzero(((labels == self.label) == self.same) & (scores >= min(self.floor)) & (rows != self.row))
        ids, scores = ids[hits], scores[hits]
        for w, (low, high) in enumerate(self.windows):
            inside = np.flatnonzero((scores >= self.floor[w]) & (scores <= high))
            if len(inside) > self.k:  # ties at the k-th place stay in
                inside = inside[scores[inside] >= np.sort(scores[inside])[-self.k]]
            if not len(inside):
                continue
            self.found[w] = sorted(self.found[w] + [(-int(s), int(i)) for s, i in zip(scores[inside], ids[inside], strict=True)])[: self.k]
            if len(self.found[w]) == self.k:
                self.floor[w] = max(low, -self.found[w][-1][0])


_TREE = "slot int, " + ", ".join(f"{name} binary" for name in CoverTree.PARTS)


def _grow(dims: int, slots: int):
    schema = pa.schema([("slot", pa.int32()), *[(name, pa.binary()) for name in CoverTree.PARTS]])

    def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        rows, ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "id", "label"))
        grown = CoverTree.build(rows, ids, labels, _matrix(table.column("v"), dims))
        return pa.RecordBatch.from_pylist([{"slot": TaskContext.get().partitionId() % slots} | grown.to_row()], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK:
                    yield tree(held)
                    held, n = [], 0
        if n:
            yield tree(held)

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slot, label)`` of the labels in the trees."""
    for batch in batches:
        for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("labels").to_pylist(), strict=True):
            labels = np.unique(np.frombuffer(raw, dtype="<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([slot] * len(labels), pa.int32()), pa.array(labels)], names=["slot", "label"])


_FOUND = "row bigint, id bigint, place int, positive_id bigint, positive_score bigint, found_id bigint, found_score bigint"
_FOUND_SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in _FOUND.split(", ")])


def _ask(dims: int, k: int, same: bool, low: tuple[int, int]):
    """Search of a slot's trees for a group of anchors; negatives have one window a positive."""

    def run(trees: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        grown = [CoverTree.from_row(t, dims) for t in trees.to_pylist()] if anchors.num_rows else []
        for a in chain.from_iterable(b.to_pylist() for b in anchors.to_batches(max_chunksize=1024)):
            query = np.zeros(dims)
            query[: len(a["v"])] = a["v"]
            asked = [{"id": None, "score": None}] if same else a["positives"]
            # low[0] / low[1] * positive score <= negative score <= positive score, in whole numbers
            windows = [(-math.inf, math.inf) if same else (-(-low[0] * p["score"] // low[1]), p["score"]) for p in asked]
            wish = Wish(query, a["row"], a["label"], same, windows, k)
            for tree in grown:
                tree.search(wish)
            for place, (p, hits) in enumerate(zip(asked, wish.found, strict=True)):
                out += [(a["row"], a["id"], place, p["id"], p["score"], found, -minus) for minus, found in hits]
        columns = zip(*out, strict=True) if out else [[]] * len(_FOUND_SCHEMA)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window's rows, with their ranks."""
    w = Window.partitionBy("row", "place").orderBy(F.col("found_score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``rows`` ``(id, label, v)``."""
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "v")
    rows = write_table(numbered, "integer-rows")
    n, asked, dims = rows.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims, groups, slots = max(1, dims), max(1, -(-asked // ANCHORS_AT_ONCE)), max(1, -(-n // (BLOCK * TREES)))

    # equal labels side by side; a label of any share is spread over as many ranges as it fills
    dealt = rows.repartitionByRange(max(1, -(-n // BLOCK)), "label", F.xxhash64("row")).sortWithinPartitions("label")
    trees = write_table(dealt.mapInArrow(_grow(dims, slots), _TREE), "cover-trees")
    in_groups = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("slot", "group")
    anchors = rows.where(is_anchor).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))

    labels = trees.select("slot", "labels").mapInArrow(_labels, "slot int, label bigint").distinct()
    like = anchors.join(write_table(labels, "labels-of-slots"), "label")
    found = in_groups.cogroup(like.groupBy("slot", "group")).applyInArrow(_ask(dims, positives, True, low), _FOUND)
    best = _best(write_table(found, "positives-by-slot"), positives)
    best = best.select("row", F.struct("rank", F.col("found_id").alias("id"), F.col("found_score").alias("score")).alias("p"))
    # a score below 0 leaves none that is at least its low part and at most itself
    windows = best.where("p.score >= 0").groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("positives"))
    everywhere = anchors.join(windows, "row").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = in_groups.cogroup(everywhere.groupBy("slot", "group")).applyInArrow(_ask(dims, negatives, False, low), _FOUND)
    ranked = _best(write_table(found, "negatives-by-slot"), negatives)
    return ranked.select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score")
    )
