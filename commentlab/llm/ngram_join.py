"""N-gram Jaccard join with prefix filters under several global token orders.

A document's tokens are the 64-bit hashes of its distinct five-word shingles. Two sets with a Jaccard
similarity of at least 0.75 share a token among the first n - ceil(0.75 n) + 1 of each, under any order that
is the same for all documents. Every order here starts with the tokens whose bucket of a fixed-size corpus
sketch is light, so common passages come last, and breaks ties by a hash of its own; the sketch adds up the counts of all
tasks. The first order has, among light tokens, those of rare words first: shingles of common words meet by chance, and
the more so the larger the corpus. How common its words are is in six bits of a token, the other 58 are its hash.

1. Within a task, documents with equal sets go on as one row. Rows that share a prefix token under the first
   order meet in the group of that token; the group is named by the smallest of its rows, its leader, so that
   the tokens of copies name one group. One row per (leader, member) stands for all pairs of the group: their
   number grows with the documents, not with the square of a group. Rows of equal sets become one class.
2. Groups are cut into blocks of about ``BLOCK`` members and ``BLOCK_TOKENS`` tokens at most. Members without a partner of a fitting size go, then,
   by short signatures (counts of shingles in hash buckets, which bound the overlap from above), members
   that can have no partner; in a group of more than one block, those without one in their block look in the others.
   What is left is cut into blocks again.
3. The other members' whole sets come in. Candidate pairs share prefix tokens under every order; the
   filters are intersected, and of what is left every pair that is not connected already is verified exactly. A block
   sends a tree of edges, not all pairs.
4. In a group of more than one block, members of different components meet across blocks in the same way.

Nothing is capped: every pair of linked texts is in one block at least, or linked already.

Cases: a null or empty text or one of white space has no shingles and is linked with nothing; fewer than
five words are one shingle; equal rows and equal texts are one class; rows with a null doc_id take part, but
name no component unless nothing else is in it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from commentlab.llm.common import as_row, bound_batches, join_null_safe, write_table
from commentlab.llm.components import connected_components
from commentlab.session import cut_lineage

WORDS = 5
NUM, DEN = 75, 100  # similarity 0.75 as a ratio of integers
ORDERS = (0x51ED27, 0x2545F4, 0x9E3779)  # seeds of the token orders; the first one builds the groups
BUCKETS = 1 << 21  # of the corpus sketch: one byte each goes to the tasks, whatever the corpus
WORD_BUCKETS = 1 << 20
SLICE = 1 << 12  # buckets that are added up together
AT_ONCE = 1 << 20  # tokens counted at once
BLOCK = 1024  # members of a block, about
BLOCK_TOKENS = 1 << 22  # tokens of a block's sets, about
ROWS_AT_ONCE = 512
BROADCAST_ROWS = 1_000_000  # of three numbers each: 24 MB, whatever the ids and texts are
RARE = 14  # words of less than one in 2 ** RARE words count as equally rare
COMMON, COMMON_AT = 63, 21  # how common a token's words are, in six bits of the token, above those of its bucket
LONG_WORD = 256  # bytes
_U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # the six white-space characters of a word's ends
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)  # of the first bytes of eight


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit (multiplication wraps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, starts, ends, n): all texts in lower case, where their words start and end in them, and words per text."""
    coded = [t.encode("utf-8") for t in texts]
    raw = b"\n".join(coded).lower()  # bytes.lower() knows ASCII only: A-Z
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = IS_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    first = np.cumsum([0, *[len(c) + 1 for c in coded]])
    return raw, starts, ends, np.diff(np.searchsorted(starts, first))


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``raw[starts[i]:ends[i]]``: eight bytes of every word at a time, each mixed in by a function
    that has an inverse, so that only words of more than eight bytes can meet by chance. Very long words go one by one."""
    padded = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    eights = np.lib.stride_tricks.as_strided(padded, (max(len(padded) - 7, 1), 8), (1, 1))
    n = ends - starts
    out = _mix(n.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(1))
    long = np.flatnonzero(n > LONG_WORD)
    rest, at, left = None, starts, np.where(n > LONG_WORD, 0, n)
    while True:
        keep = np.flatnonzero(left > 0) if rest is None else np.flatnonzero(left > 8)
        if not len(keep):
            break
        if rest is None:
            rest, at, left = keep, starts[keep], left[keep]
        else:
            rest, at, left = rest[keep], at[keep] + 8, left[keep] - 8
        chunk = eights[at].view("<u8").ravel() & MASKS[np.minimum(left, 8)]
        out[rest] = _mix(out[rest] ^ chunk)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text)."""
    raw, starts, ends, n = _split(texts)
    return word_hashes(raw, starts, ends), n


class Shingler:
    """Shingle sets of batches of texts. ``common`` has, by the bucket of a word's hash, how common it is in quarters of a bit; six
    bits of a token then say how common its words are together, which depends on the shingle alone like the others."""

    common: np.ndarray | None = None

    def __init__(self, common: np.ndarray | None = None):
        if common is not None:
            self.common = common

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, token) of every shingle, by text."""
        return self.of_words(*_words(texts))

    def of_words(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = _mix(flat)
        for k in range(1, min(WORDS, len(flat))):
            code[: len(flat) - k] = _mix(code[: len(flat) - k] * _U(3) + flat[k:])
        text = np.repeat(np.arange(len(n)), n)
        upto = np.cumsum(n)
        last = np.maximum(upto - (WORDS - 1), upto - n)  # words from here on have too few behind them
        kept = np.ones(len(flat), dtype=bool)
        for a, b in zip(last.tolist(), upto.tolist(), strict=True):
            kept[a:b] = False
        # a text of fewer words is one token, that of all of them, at its first word
        short = np.flatnonzero((n > 0) & (n < WORDS))
        at = (upto - n)[short]
        for i, a in zip(short.tolist(), at.tolist(), strict=True):
            code[a] = xxhash.xxh3_64_intdigest(flat[a : a + n[i]].tobytes(), seed=int(n[i]))
        kept[at] = True
        if self.common is not None:
            each = self.common[(flat & _U(WORD_BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
            together = each.copy()
            for k in range(1, min(WORDS, len(flat))):
                together[: len(flat) - k] += each[k:]
            together[at] = 0
            bits = np.minimum(together // _U(4), _U(COMMON)) << _U(COMMON_AT)
            code = (code & ~_U(COMMON << COMMON_AT)) | bits
        return text[kept], code[kept]

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, tokens): the sorted distinct tokens of text i are ``tokens[ends[i]:ends[i + 1]]``."""
        doc, code = self.shingles(texts)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            code[a:b].sort()
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
        doc, code = doc[first], code[first]
        return np.searchsorted(doc, np.arange(len(texts) + 1)), code


def prefix_length(n: np.ndarray) -> np.ndarray:
    """First tokens of a set of n of which a set that is similar enough must share one."""
    return np.where(n > 0, n - (NUM * n + DEN - 1) // DEN + 1, 0)


def _smallest(key: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest keys; of equal ones at the limit the first."""
    if k == len(key):
        return np.arange(k)
    limit = np.partition(key, k - 1)[k - 1]
    below = np.flatnonzero(key <= limit)
    if len(below) > k:
        equal = np.flatnonzero(key == limit)
        below = np.setdiff1d(below, equal[k - len(below) :], assume_unique=True)
    return below


def prefixes(ends: np.ndarray, tokens: np.ndarray, levels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, token) of every prefix token under the order of ``seed``, light tokens first; of a set in any order. In the
    order that builds the groups, light tokens of rare words come before those of common words, which meet by chance."""
    n = np.diff(ends)
    length = prefix_length(n)
    level = levels[(tokens & _U(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
    key = (level << _U(57)) | (_mix(tokens ^ _U(seed)) >> _U(7))
    if seed == ORDERS[0]:
        common = (tokens >> _U(COMMON_AT)) & _U(COMMON)
        key = (level << _U(57)) | (common << _U(51)) | ((key & _U((1 << 57) - 1)) >> _U(6))
    places = [a + _smallest(key[a:b], k) for a, b, k in zip(ends[:-1].tolist(), ends[1:].tolist(), length.tolist(), strict=True) if k]
    chosen = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    return np.repeat(np.arange(len(n)), length), tokens[chosen]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket of tokens, and after them each bucket of words, occurs in this task's documents, in slices."""
    counts, held = np.zeros(BUCKETS + WORD_BUCKETS, dtype=np.int64), []

    def count() -> None:
        np.add(counts, np.bincount(np.concatenate(held), minlength=len(counts)), out=counts)
        held.clear()

    shingler = Shingler()
    for _, texts in _texts(batches):
        flat, n = _words(texts)
        held.append((shingler.of_words(flat, n)[1] & _U(BUCKETS - 1)).astype(np.int64))
        held.append((flat & _U(WORD_BUCKETS - 1)).astype(np.int64) + BUCKETS)
        if sum(map(len, held)) > AT_ONCE:
            count()
    if held:
        count()
    for at in np.flatnonzero(counts.reshape(-1, SLICE).any(axis=1)).tolist():
        n = counts[at * SLICE : (at + 1) * SLICE]
        raw = n.astype(np.min_scalar_type(n.max())).tobytes()  # of one, two, four or eight bytes each
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([raw], pa.binary())], names=["slice", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each slice, and its levels: of tokens 0 for a light bucket, else twice the logarithm of its count; of words four times
    the logarithm."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            n = np.frombuffer(counts, dtype=f"u{len(counts) // SLICE}").astype(np.int64)
            sums[at] = sums[at] + n if at in sums else n
    for at, n in sums.items():
        logs = np.log2(np.maximum(n, 1))
        usual = np.median(n)
        light = n <= usual + 4 * np.sqrt(usual) + 3
        level = np.where(light, 0, 1 + 2 * logs) if at * SLICE < BUCKETS else np.round(4 * logs)
        arrays = [pa.array([at], pa.int32()), pa.array([int(n.sum())]), pa.array([level.astype(np.uint8).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["slice", "n", "levels"])


def corpus_levels(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(levels, common): level of each sketch bucket of tokens, 0 for a light one; how common the words of each bucket are, four
    times the logarithm of their share, 0 for rare ones.

    Any levels give a right order as long as all tasks use the same. The counts of all tasks are added up: a token that every
    thousandth document holds stands out in none of many tasks. One byte a bucket comes back, whatever the corpus.
    """
    counted = docs.select("text").mapInArrow(_sketch, "slice int, counts binary")
    levels, words = np.zeros(BUCKETS + WORD_BUCKETS, dtype=np.uint8), 0
    for row in counted.repartition("slice").mapInArrow(_levels, "slice int, n bigint, levels binary").collect():
        levels[row["slice"] * SLICE :][:SLICE] = np.frombuffer(row["levels"], dtype=np.uint8)
        words += row["n"] if row["slice"] * SLICE >= BUCKETS else 0
    common = np.maximum(levels[BUCKETS:] + 4 * (RARE - np.log2(max(words, 1))), 0).astype(np.uint8)
    return levels[:BUCKETS].copy(), common


def signature(tokens: np.ndarray) -> bytes:
    """Tokens per hash bucket, two to four a bucket: 32 times shorter than the set, at least."""
    bits = max(1, int(len(tokens) - 1).bit_length() - 2)
    return np.bincount((tokens >> _U(64 - bits)).astype(np.int64), minlength=1 << bits).clip(0, 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these signatures share more tokens than this."""
    x, y = (np.frombuffer(s, dtype=np.uint8) for s in (a, b))
    full = x.max() == 255 or y.max() == 255  # a bucket that may hold more than it can count
    size = min(len(x), len(y))
    x, y = (v.reshape(size, -1).sum(axis=1, dtype=np.int64) for v in (x, y))
    return 1 << 60 if full else int(np.minimum(x, y).sum())


def _describe(levels: np.ndarray, common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, part, rows = Shingler(common), TaskContext.get().partitionId(), 0
        met: dict[bytes, int] = {}  # one entry per different text of this task
        for batch, texts in _texts(batches):
            ends, tokens = shingler.sets(texts)
            n = np.diff(ends)
            cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            digests = [xxhash.xxh3_128_digest(tokens[a:b].tobytes()) for a, b in cuts]
            own = [(part << 33) + rows + i for i in range(len(n))]
            rows += len(n)
            rid = [met.setdefault(d, r) for d, r in zip(digests, own, strict=True)]
            first = np.array([a == b for a, b in zip(rid, own, strict=True)]) & (n > 0)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            owner, prefix = prefixes(ends, tokens, levels, ORDERS[0])
            inside = first[owner]
            owner, prefix = owner[inside], prefix[inside]
            starts = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array(n),
                    pa.array(rid, pa.int64()),
                    pa.array(halves[:, 0].copy()),
                    pa.array(halves[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(prefix.view(np.int64))),
                    pa.array([signature(tokens[a:b]) if f else None for (a, b), f in zip(cuts, first.tolist(), strict=True)], pa.binary()),
                ],
                names=["doc_id", "text_id", "n", "rid", "h1", "h2", "prefix", "sig"],
            )

    return run


def _whole_sets(common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(common)
        for batch, texts in _texts(batches):
            ends, tokens = shingler.sets(texts)
            raw = [tokens[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(raw, pa.binary())], names=["cid", "tokens"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys out of sorted batches; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _shared(owner: np.ndarray, tokens: np.ndarray, m: int) -> np.ndarray:
    """How many tokens each two of m sets share: products of the incidence matrix, some columns at a time."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1 if len(column) else np.zeros(0, dtype=bool)
    some = common[column]
    owner, column = owner[some], (np.cumsum(common) - 1)[column[some]]
    total = np.zeros((m, m), dtype=np.float32)
    step = max(1, 8_000_000 // m)
    for low in range(0, int(common.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        x = np.zeros((m, min(step, int(common.sum()) - low)), dtype=np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _connect(candidates: np.ndarray, roots: np.ndarray, ends: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The smallest root that each set reaches by links among the candidate pairs. Sets are taken one by one and compared
    with their candidates in other components only, so that a crowd of copies costs one comparison each."""
    component = roots.copy()
    _, column = np.unique(tokens, return_inverse=True)
    own = np.zeros(column.max(initial=-1) + 1, dtype=bool)
    n = np.diff(ends)
    for i in np.flatnonzero(candidates.any(axis=1)).tolist():
        others = np.flatnonzero(candidates[i, :i])
        others = others[component[others] != component[i]]
        if not len(others):
            continue
        # one of each component at a time: a link makes the others of it needless
        while len(others):
            _, first = np.unique(component[others], return_index=True)
            tried = others[first]
            own[column[ends[i] : ends[i + 1]]] = True
            sizes = n[tried]
            places = np.repeat(ends[tried] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            shared = np.add.reduceat(own[column[places]].astype(np.int64), np.cumsum(sizes) - sizes)
            own[column[ends[i] : ends[i + 1]]] = False
            alike = tried[DEN * shared >= NUM * (n[i] + sizes - shared)]
            if len(alike):
                joined = np.unique(np.append(component[alike], component[i]))
                component[np.isin(component, joined)] = joined[0]
            others = np.setdiff1d(others, tried, assume_unique=True)
            others = others[component[others] != component[i]]
    return component


def _fits(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (NUM * n <= DEN * other) & (NUM * other <= DEN * n)


def _sizes_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of one-block groups with a partner of a fitting size; all members of larger groups."""
    for group in _groups(batches, ["leader", "block"]):
        n = group.column("n").to_numpy()
        keep = np.ones(len(n), dtype=bool)
        if group.column("blocks")[0].as_py() == 1:
            order = np.argsort(n, kind="stable")
            close = NUM * n[order][1:] <= DEN * n[order][:-1]  # the nearest size decides
            keep[order] = np.concatenate([close, [False]]) | np.concatenate([[False], close])
        yield from group.filter(pa.array(keep)).combine_chunks().to_batches()


def _possible(n: np.ndarray, sig: list[bytes], seeking: np.ndarray) -> np.ndarray:
    """Which members have a partner that the signatures leave possible; looked for as long as one of the two is ``seeking``."""
    met, place = ~seeking, np.arange(len(n))
    for i in np.flatnonzero(seeking).tolist():
        for j in np.flatnonzero(_fits(n[i], n) & (~seeking | (place < i))).tolist():
            if met[i] and met[j]:
                continue
            bound = overlap_bound(sig[i], sig[j])
            if DEN * bound >= NUM * (int(n[i] + n[j]) - bound):
                met[i] = met[j] = True
    return met


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block, with whether the signature leaves a partner in it possible; those of one-block groups only if so."""
    for group in _groups(batches, ["leader", "block"]):
        n = group.column("n").to_numpy()
        met = _possible(n, group.column("sig").to_pylist(), np.ones(len(n), dtype=bool))
        out = group.select(["leader", "block", "blocks", "cid", "n"]).append_column("met", pa.array(met))
        if group.column("blocks")[0].as_py() == 1:
            out = out.filter(pa.array(met))
        yield from out.combine_chunks().to_batches()


def _partners_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large groups that had no possible partner in their block and have one in another."""
    for group in _groups(batches, ["leader", "pair"]):
        group = group.combine_chunks()
        seeking = group.column("seeking").to_numpy(zero_copy_only=False)
        if not seeking.any():
            continue
        found = _possible(group.column("n").to_numpy(), group.column("sig").to_pylist(), seeking)
        yield from group.filter(pa.array(found & seeking)).select(["leader", "cid"]).combine_chunks().to_batches()


def _link(levels: np.ndarray, keys: list[str]) -> Callable:
    """Edges ``(a, b)`` that join the roots of linked sets of a block: to the smallest root reached in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            raw = group.column("tokens").to_pylist()
            roots = group.column("root").to_numpy()
            n = np.array([len(t) // 8 for t in raw], dtype=np.int64)
            tokens = np.frombuffer(b"".join(raw), dtype=np.uint64)
            ends = np.concatenate([[0], np.cumsum(n)])
            linked = (roots[:, None] != roots[None, :]) & _fits(n[:, None], n[None, :])
            for seed in ORDERS:
                if not linked.any():
                    break
                linked &= _shared(*prefixes(ends, tokens, levels, seed), len(n)) > 0
            if not linked.any():
                continue
            component = _connect(linked, roots, ends, tokens)
            moved = np.flatnonzero(component != roots)
            edges = sorted(set(zip(roots[moved].tolist(), component[moved].tolist(), strict=True)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return run


def _by_block(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cid, text)``: the texts of the rows that ``wanted`` (doc_id, text_id, cid) names. The join goes by two hashes, so that
    its rows have one size and a count of them is a check of their bytes; a larger table is joined by a shuffle."""
    keys = [F.col("text_id"), F.xxhash64(F.lit(1), F.col("doc_id")).alias("id_hash")]
    named = write_table(wanted.select(*keys, "cid"), "wanted")
    fits = named.count() <= BROADCAST_ROWS
    return docs.select(*keys, "text").join(F.broadcast(named) if fits else named, ["text_id", "id_hash"]).select("cid", "text")


def _blocks_for(members: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("bigint")


def _block_of(member: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(member), blocks).cast("int")


def _cross_blocks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(leader, pair, cid, root)``: blocks of groups that fill more than one block and more than one
    component. The members of a group's largest component meet the others, not each other."""
    placed = members.where(F.col("blocks") > 1).join(roots.withColumnsRenamed({"node": "cid"}), "cid", "left")
    placed = write_table(placed.select("leader", "cid", "n", F.coalesce("root", "cid").alias("root")), "large-groups")
    sizes = placed.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    groups = sizes.groupBy("leader").agg(
        F.max(F.struct("members", "tokens", "root")).alias("most"), F.sum("members").alias("members"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("roots")
    )
    groups = groups.where(F.col("roots") > 1).select(
        "leader",
        F.col("most.root").alias("main"),
        _blocks_for(F.col("most.members"), F.col("most.tokens")).alias("n_main"),
        _blocks_for(F.col("members") - F.col("most.members"), F.col("tokens") - F.col("most.tokens")).alias("n_rest"),
    )
    groups = cut_lineage(groups, "groups-to-cross")
    rows = placed.join(groups, "leader")
    is_main = F.col("root") == F.col("main")
    own = F.when(is_main, _block_of(F.col("cid"), F.col("n_main"))).otherwise(_block_of(F.col("cid"), F.col("n_rest")))
    rest = F.sequence(F.lit(0).cast("bigint"), F.col("n_rest") - 1)
    main = F.sequence(F.lit(0).cast("bigint"), F.col("n_main") - 1)

    def name(a: Column, b: Column, mark: str) -> Column:
        return F.concat_ws(mark, a.cast("string"), b.cast("string"))

    # "r-m": block r of the rest against block m of the main component; "r+s": two blocks of the rest
    with_main = F.transform(rest, lambda r: name(r, F.col("own"), "-"))
    with_rest = F.concat(
        F.transform(main, lambda m: name(F.col("own"), m, "-")),
        F.transform(rest, lambda r: name(F.least(F.col("own"), r), F.greatest(F.col("own"), r), "+")),
    )
    rows = rows.withColumn("own", own.cast("bigint"))
    return rows.select("leader", "cid", "root", F.explode(F.when(is_main, with_main).otherwise(with_rest)).alias("pair"))


def _possible_members(fitting: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(leader, block, blocks, cid, n)``: members with a partner that their signatures leave possible, in blocks again.

    In a group of more than one block, a member without one in its own block looks in all others: the signatures of those that
    look meet the signatures of every block, so that no group sends whole sets for members that are alike in a common line only."""
    names = "leader bigint, block int, blocks bigint, cid bigint, n bigint, met boolean"
    tried = write_table(_by_block(fitting.join(signatures, "cid"), ["leader", "block"]).mapInArrow(_partners, names), "members-tried")
    large = tried.where(F.col("blocks") > 1)
    looking = large.where(~F.col("met")).groupBy("leader").agg(F.count(F.lit(1)).alias("looking"))
    looking = cut_lineage(looking.select("leader", F.ceil(F.col("looking") / BLOCK).cast("bigint").alias("parts")), "groups-that-look")
    if looking.isEmpty():
        return write_table(tried.where("met").drop("met"), "possible-members")
    rows = large.join(looking, "leader")
    blocks, parts = (F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1) for c in ("blocks", "parts"))
    part = F.pmod(F.xxhash64(F.lit(2), F.col("cid")), F.col("parts")).cast("bigint")

    def placed(of: DataFrame, pair: Column, seeking: bool) -> DataFrame:
        return of.select("leader", "cid", "n", F.lit(seeking).alias("seeking"), F.explode(pair).alias("pair"))

    seek = placed(rows.where(~F.col("met")), F.transform(blocks, lambda b: b * F.col("parts") + part), True)
    sought = placed(rows, F.transform(parts, lambda s: F.col("block") * F.col("parts") + s), False)
    # one that looks, and is in the block that it looks in, comes once
    pairs = seek.unionByName(sought).groupBy("leader", "pair", "cid", "n").agg(F.max("seeking").alias("seeking"))
    pairs = write_table(pairs, "pairs-to-look-in").join(signatures, "cid")
    found = _by_block(pairs, ["leader", "pair"]).mapInArrow(_partners_across, "leader bigint, cid bigint").distinct()
    found = write_table(found, "members-found-across")
    possible = tried.join(found.withColumn("across", F.lit(True)), ["leader", "cid"], "left").where(F.col("met") | F.col("across"))
    possible = write_table(possible.select("leader", "cid", "n"), "possible-members")
    return write_table(_in_blocks(possible), "possible-members-in-blocks")


def _in_blocks(members: DataFrame) -> DataFrame:
    """``(leader, block, blocks, cid, n)`` of the groups of more than one member."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens")).where(F.col("members") > 1)
    sizes = sizes.select("leader", _blocks_for(F.col("members"), F.col("tokens")).alias("blocks"))
    blocked = members.join(cut_lineage(sizes, "group-sizes"), "leader").withColumn("block", _block_of(F.col("cid"), F.col("blocks")))
    return blocked.select("leader", "block", "blocks", "cid", "n")


def _number_classes(described: DataFrame, found: DataFrame) -> DataFrame:
    """``(rid, cid, doc_id, text_id, n, sig)`` of the rows that are in a group: the smallest row of a set names it."""
    rows = described.where(F.col("sig").isNotNull()).drop("prefix")
    rows = write_table(rows.join(found.select("rid").distinct(), "rid"), "rows-in-groups")
    classes = rows.groupBy("h1", "h2").agg(F.min("rid").alias("cid"))
    return write_table(rows.join(cut_lineage(classes, "classes"), ["h1", "h2"]).drop("h1", "h2"), "numbered-rows")


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(described, numbered, roots): a row per document, the class of each row in a group, a root per linked class."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    levels, common = corpus_levels(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = write_table(
        docs.mapInArrow(
            _describe(levels, common),
            f"doc_id {kind}, text_id bigint, n bigint, rid bigint, h1 bigint, h2 bigint, prefix array<bigint>, sig binary",
        ),
        "described",
    )
    postings = described.select("rid", F.explode("prefix").alias("token"))
    leaders = postings.groupBy("token").agg(F.min("rid").alias("leader"), F.max("rid").alias("last"))
    leaders = write_table(leaders.where(F.col("leader") < F.col("last")).drop("last"), "leaders")
    found = write_table(postings.join(leaders, "token").select("leader", "rid").distinct(), "rows-by-leader")
    numbered = _number_classes(described, found)
    members = write_table(found.join(numbered.select("rid", "cid", "n"), "rid").select("leader", "cid", "n").distinct(), "members")

    one = numbered.where(F.col("rid") == F.col("cid"))
    names = "leader bigint, block int, blocks bigint, cid bigint, n bigint"
    fitting = write_table(_by_block(_in_blocks(members), ["leader", "block"]).mapInArrow(_sizes_fit, names), "members-of-fitting-size")
    members = _possible_members(fitting, one.select("cid", "sig"))

    wanted = one.join(members.select("cid").distinct(), "cid").select("doc_id", "text_id", "cid")
    sets = _texts_of(docs, wanted).mapInArrow(_whole_sets(common), "cid bigint, tokens binary")
    sets = write_table(sets, "sets").dropDuplicates(["cid"])  # rows that repeat id and text

    blocks = members.join(sets, "cid").withColumn("root", F.col("cid"))
    links = _by_block(blocks, ["leader", "block"]).mapInArrow(_link(levels, ["leader", "block"]), "a bigint, b bigint")
    roots = cut_lineage(connected_components(links), "roots")
    crossed = write_table(_cross_blocks(members, roots), "crossed")
    across = _by_block(crossed.join(sets, "cid"), ["leader", "pair"]).mapInArrow(_link(levels, ["leader", "pair"]), "a bigint, b bigint")
    across = cut_lineage(across, "links-across")
    if not across.isEmpty():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = cut_lineage(connected_components(across.unionByName(stars)), "roots")
    return described, numbered, roots


def similarity_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_id, n_shingles, root, component_id)`` for every row of ``docs``; root names its component."""
    described, numbered, roots = similar_classes(docs)
    named = numbered.select("rid", "cid").join(roots.withColumnsRenamed({"node": "cid"}), "cid", "left")
    named = cut_lineage(named.select("rid", F.coalesce("root", "cid").alias("root")), "root-of-row")
    rows = described.select("doc_id", "text_id", "n", "rid").join(named, "rid", "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "rid"))
    rows = cut_lineage(rows.select("doc_id", "text_id", "n", root.alias("root")), "root-of-document")
    smallest = cut_lineage(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest")), "smallest")
    return rows.join(smallest, "root", "left").select(
        "doc_id", "text_id", F.col("n").alias("n_shingles"), "root", F.coalesce("smallest", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest (doc_id, text hash), and every row without words.

    Rows equal in id and text are one document: they stay or go together. Other columns pass through under any name.
    """
    found = similarity_components(docs)
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")
    first = found.where("root is not null").groupBy("root").agg(F.min(row).alias("keep"))
    stay = first.select("keep.doc_id", "keep.text_id")
    lone = found.where("root is null").select("doc_id", "text_id").distinct()
    stay = write_table(stay.unionByName(lone), "documents-that-stay")
    marked = docs.select(as_row(docs), "doc_id", F.xxhash64("text").alias("text_id"))
    return join_null_safe(marked, stay, ["doc_id", "text_id"]).select("row.*")
