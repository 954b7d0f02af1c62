"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both vocabularies encode a text; each token list gives the cumulative byte ends of its tokens, kept as a table from
end to index. The ends that both tables hold are the places where tokens of both end; in order, they slice the two id
lists into groups, and within a group every token of one list is linked with every token of the other.

1. Texts are cut before spaces and line breaks that follow other text. Tokens of both vocabularies end there, so groups
   never reach over a cut, and every different cut (a word with what leads and trails it) is encoded and aligned once
   while a worker remembers it. New cuts are strung together, so that one pair of tables serves many of them. A text's
   digest and counts are put together from its cuts.
2. A task's texts form blocks of bounded size. Per block, one row holds its cuts' links and in how many texts each
   linked pair of ids occurs; the texts are rows of numbers of cuts. So pairs are counted once a block before any shuffle.
3. The counts of all blocks are added up by pair, each pair is held against the highest count of its first id, and the
   block's pairs come back to the block, where each text sums them over its cuts.

Cases: null and empty texts, and texts that a vocabulary does not give back byte by byte (the second vocabulary writes
spaces as U+2581, so a text that holds that character is one), have no tokens: zeros and an empty digest. Strings of
special tokens are plain text. Rows that repeat count each as a document. An empty table gives an empty result. Only
the id and text columns are read, so that other columns may have any name.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from commentlab.llm.common import byte_alphabet, write_table
from commentlab.llm.token_counts import SPACE, check_cuts, plain_pieces, units

ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20
HELD_CUTS = 200_000
LONG_CUT = 200  # characters; longer cuts hardly come again and are not kept
STRUNG = 1 << 17  # characters of new cuts that are encoded as one text
LONG_PIECE = 2000  # characters; the faster library's time grows with the square of a piece's length
BIG_GROUP = 1 << 12  # links; a larger group's are counted by pairs of ids, not one by one
# a block of texts ends when it holds so many different cuts, texts, or pairs (counted once a text)
BLOCK_CUTS, BLOCK_TEXTS, BLOCK_PAIRS = 1 << 16, 1 << 13, 1 << 22
BLOCK_BITS = 24


def default_paths() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteVocabulary:
    """Byte-level vocabulary: the bytes of every id, and ids of cuts.

    Where the merges follow each other in the order of the ids they make, ids are the ranks that the faster of the two
    libraries for such vocabularies takes, with the same pattern for splitting; other vocabularies go to the first one."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        split = data["pre_tokenizer"]
        if not split or split["type"] != "ByteLevel" or split["add_prefix_space"] or data["normalizer"]:
            raise ValueError("not a byte-level vocabulary that takes texts as they are")
        alphabet = byte_alphabet()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * self.size
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = token.encode("utf-8") if token in special else bytes(alphabet[c] for c in token)
        vocab = data["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        plain = {token: i for token, i in vocab.items() if token not in special}
        self.ranked = None
        if split.get("use_regex", True) and made == sorted(made) and len(set(made)) == len(plain) - len(alphabet):
            ranks = {self.bytes[i]: i for i in plain.values()}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, long: bool) -> list[int]:
        """Ids of one or more cuts in a string; ``long`` says that one of them may be longer than ``LONG_PIECE``."""
        if self.ranked is not None and not long:
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceVocabulary:
    """Piece vocabulary that puts a space in front of a text: the bytes of every id, and ids of cuts."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        check_cuts(list(plain_pieces(self.model)))
        self.size = self.model.get_piece_size()
        self.space = self.model.piece_to_id(SPACE)
        self.bytes = [self._bytes(i) for i in range(self.size)]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode("utf-8")

    def encode(self, text: str) -> list[int]:
        """Ids of one or more cuts in a string. The library puts a space in front: it stands for the string's own leading
        space, else its token is dropped."""
        if text[0] != " ":
            return self.model.encode(text)[1:]
        return self.model.encode(text[1:]) if len(text) > 1 else [self.space]


def index_by_end(sizes: Sequence[int]) -> np.ndarray:
    """Cumulative byte end of each token -> number of tokens up to it; 0 for bytes that end none."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    index = np.zeros(ends[-1] + 1 if len(ends) else 1, dtype=np.int64)
    index[ends] = np.arange(1, len(ends) + 1)
    return index


def group_slices(a_sizes: Sequence[int], b_sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, a, b): groups end at the bytes ``ends``, after the first ``a`` and ``b`` tokens of the lists."""
    a, b = index_by_end(a_sizes), index_by_end(b_sizes)
    n = min(len(a), len(b))
    ends = np.flatnonzero((a[:n] > 0) & (b[:n] > 0))
    return ends, a[ends], b[ends]


class Cut(NamedTuple):
    """Alignment of one cut. A link's code is first id * number of second ids + second id; ``codes`` holds one for every link,
    or, with ``times``, one for every linked pair of ids."""

    digest: str
    counts: tuple[int, int, int, int]  # tokens, tokens, groups, links
    codes: bytes
    times: bytes | None = None


_cut = partial(tuple.__new__, Cut)  # a cut of its four fields, as ``Cut._make``


class Aligner:
    """Alignments of cuts; None where a vocabulary does not give the cut back byte by byte."""

    def __init__(self, paths: tuple[str, str]):
        self.a, self.b = ByteVocabulary(paths[0]), PieceVocabulary(paths[1])
        self.a_size, self.b_size = (np.array([len(x) for x in v.bytes], dtype=np.int64) for v in (self.a, self.b))
        # how a digest spells an id within its group's list and, after it, at the list's end: first ids, then second ones
        ends = [("|", self.a.size), (";", self.b.size)]
        self.names = [f"{i}{after}" for end, size in ends for i in range(size) for after in (",", end)]
        self.name_size = np.array([len(x) for x in self.names], dtype=np.int64)
        self.young: dict[str, Cut | None] = {}
        self.old: dict[str, Cut | None] = {}

    def _groups(self, text: str, long: bool = False) -> tuple | None:
        a, b, raw = self.a.encode(text, long), self.b.encode(text), text.encode("utf-8")
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends, i, j = group_slices(self.a_size[a], self.b_size[b])
        first_a, first_b = np.concatenate([[0], i[:-1]]), np.concatenate([[0], j[:-1]])
        # digests of all groups as one string: a group's first ids stand behind the second ids of the groups before
        spelled_a, spelled_b = 2 * a, 2 * (self.a.size + b)
        spelled_a[i - 1] += 1
        spelled_b[j - 1] += 1
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(first_b, i - first_a)] = spelled_a
        order[np.arange(len(b)) + np.repeat(i, j - first_b)] = spelled_b
        digests = "".join(map(self.names.__getitem__, order.tolist()))
        return a, b, ends, first_a, i, first_b, j, digests, np.cumsum(self.name_size[order])[i + j - 1]

    def _strung(self, cuts: list[str]) -> list[Cut | None]:
        """Alignments of cuts that end in other characters than white space, encoded as one string."""
        found = self._groups("".join(cuts))
        if found is None:
            return [self._single(c) for c in cuts]
        a, b, ends, first_a, last_a, first_b, last_b, digests, digest_end = found
        links = (last_a - first_a) * (last_b - first_b)
        upto = np.searchsorted(ends, np.cumsum(list(map(len, map(str.encode, cuts))))) + 1  # groups up to each cut's end
        big = np.flatnonzero(links > BIG_GROUP)
        spelled = np.where(links > BIG_GROUP, 0, links)
        group = np.repeat(np.arange(len(links)), spelled)
        place = np.arange(len(group)) - np.repeat(np.cumsum(spelled) - spelled, spelled)
        width = (last_b - first_b)[group]
        codes = (a[first_a[group] + place // width] * self.b.size + b[first_b[group] + place % width]).tobytes()
        single = set(np.searchsorted(upto, big, side="right").tolist())  # cuts with a group that is not spelled out
        n_a, n_b, n_l = (np.concatenate([[0], x]).take(upto) for x in (last_a, last_b, np.cumsum(spelled)))
        counts = zip(*[np.diff(x, prepend=0).tolist() for x in (n_a, n_b, upto, n_l)], strict=True)
        last, end = digest_end[upto - 1].tolist(), (8 * n_l).tolist()
        own_digests = [digests[k : k2 - 1] for k, k2 in zip([0, *last[:-1]], last, strict=True)]
        own_codes = [codes[k:k2] for k, k2 in zip([0, *end[:-1]], end, strict=True)]
        out: list[Cut | None] = list(map(_cut, zip(own_digests, counts, own_codes, repeat(None))))
        for n in single:
            out[n] = self._single(cuts[n])
        return out

    def _single(self, cut: str) -> Cut | None:
        """Alignment of one cut by itself, its links counted by pairs of ids."""
        found = self._groups(cut, len(cut) > LONG_PIECE)
        if found is None:
            return None
        a, b, _, first_a, last_a, first_b, last_b, digests, _ = found
        links: Counter[int] = Counter()
        for i, j, k, m in zip(first_a.tolist(), last_a.tolist(), first_b.tolist(), last_b.tolist(), strict=True):
            second = Counter(b[k:m].tolist()).items()
            for x, n in Counter(a[i:j].tolist()).items():
                for y, t in second:
                    links[x * self.b.size + y] += n * t
        codes, times = (np.fromiter(x, dtype=np.int64, count=len(links)).tobytes() for x in (links.keys(), links.values()))
        return Cut(digests[:-1], (len(a), len(b), len(last_a), sum(links.values())), codes, times)

    def of(self, cuts: set[str]) -> dict[str, Cut | None]:
        """Alignments of ``cuts``."""
        if len(self.young) > HELD_CUTS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        rest = cuts.difference(young)
        known = cuts.difference(rest)
        absent = rest.difference(old)
        out = {c: old[c] for c in rest.difference(absent)}
        # cuts that end in white space, are no neighbours of another cut, or take the other library go by themselves
        alone = [c for c in absent if c[-1].isspace() or SPACE in c or len(c) > LONG_PIECE]
        strung = list(absent.difference(alone))
        string = np.cumsum(list(map(len, strung))) // STRUNG
        bounds = [0, *(np.flatnonzero(string[1:] != string[:-1]) + 1).tolist(), len(strung)]
        for first, end in zip(bounds, bounds[1:]):
            if first < end:
                out.update(zip(strung[first:end], self._strung(strung[first:end]), strict=True))
        out.update((c, self._single(c)) for c in alone)
        once = [c for c in absent if len(c) > LONG_CUT]
        remembered = dict(zip(known, map(young.__getitem__, known), strict=True))
        young.update(out)
        for c in once:
            del young[c]
        return out | remembered


_ALIGNERS: dict[tuple[str, str], Aligner] = {}  # one a worker process: its tasks share what is remembered


def aligner_of(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ALIGNERS[paths] = Aligner(paths)
    return _ALIGNERS[paths]


ROWS = "block bigint, cuts binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
TABLES = "codes array<bigint>, docs array<bigint>, sizes binary, pairs binary, times binary"


def _different(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order, and how often each comes: a plain sort, which few numbers take fastest."""
    numbers = np.sort(numbers)
    bounds = np.empty(len(numbers) + 1, dtype=bool)
    bounds[0] = bounds[-1] = True
    np.not_equal(numbers[1:], numbers[:-1], out=bounds[1:-1])
    bounds = np.flatnonzero(bounds)
    return numbers[bounds[:-1]], bounds[1:] - bounds[:-1]


def _pack(places: np.ndarray, repeats: np.ndarray) -> bytes:
    """Rising places (as differences) and repeats in as many bytes a number as they need; the tables are compressed."""
    steps = np.diff(places, prepend=0)
    kinds = [np.min_scalar_type(int(x.max())).newbyteorder("<") for x in (steps, repeats)]
    return bytes(k.itemsize for k in kinds) + b"".join(x.astype(k).tobytes() for x, k in zip((steps, repeats), kinds, strict=True))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(packed) - 2) // (packed[0] + packed[1])
    steps = np.frombuffer(packed, f"<u{packed[0]}", n, 2)
    return np.cumsum(steps, dtype=np.int64), np.frombuffer(packed, f"<u{packed[1]}", n, 2 + n * packed[0]).astype(np.int64)


class Block:
    """Texts of one task whose pairs are counted together."""

    def __init__(self, number: int):
        self.number = number
        self.places: dict[str, int] = {}
        self.digests: list[str] = []
        self.codes: list[bytes] = []
        self.times: list[bytes | None] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)
        self.rows: list[tuple] = []
        self.seen: list[np.ndarray] = []
        self.n_seen = 0

    def full(self) -> bool:
        return len(self.codes) >= BLOCK_CUTS or len(self.rows) >= BLOCK_TEXTS or self.n_seen >= BLOCK_PAIRS

    def add(self, doc_ids: list, texts: list[list[str]], known: dict[str, Cut | None]) -> None:
        """Take texts, each a list of cuts; ``known`` holds those that are not in the block yet."""
        lost = {c for c, x in known.items() if x is None}
        new = [c for c in known if c not in lost] if lost else list(known)
        self.places.update(zip(new, range(len(self.codes), len(self.codes) + len(new)), strict=True))
        if new:
            digests, counts, codes, times = zip(*map(known.__getitem__, new), strict=True)
            self.digests += digests
            self.codes += codes
            self.times += times
            self.counts = np.concatenate([self.counts, np.fromiter(chain.from_iterable(counts), np.int64, 4 * len(new)).reshape(-1, 4)])
        for doc_id, cuts in zip(doc_ids, texts, strict=True):
            if not cuts or (lost and not lost.isdisjoint(cuts)):
                self.rows.append((doc_id, b"", 0, 0, 0, 0, ""))
                continue
            places = list(map(self.places.__getitem__, cuts))
            digest = hashlib.sha256(";".join(map(self.digests.__getitem__, places)).encode()).hexdigest()
            own, repeats = _different(np.array(places))
            codes, _ = _different(np.frombuffer(b"".join(map(self.codes.__getitem__, own.tolist())), dtype=np.int64))
            self.seen.append(codes)
            self.n_seen += len(codes)
            self.rows.append((doc_id, _pack(own, repeats), *(repeats @ self.counts[own]).tolist(), digest))

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids, cuts, n_a, n_b, n_groups, n_links, digests = zip(*self.rows, strict=True)
        n = len(self.rows)
        cols = [pa.array(ids, schema.field("doc_id").type), pa.array([self.number] * n, pa.int64()), pa.array(cuts, pa.binary())]
        cols += [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
        cols += [pa.array(digests, pa.string()), *[pa.nulls(n, f.type) for f in list(schema)[len(cols) + 1 :]]]
        yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if not self.seen:
            return
        codes, docs = np.unique(np.concatenate(self.seen), return_counts=True)
        links = np.frombuffer(b"".join(self.codes), dtype=np.int64)
        sizes = np.fromiter(map(len, self.codes), dtype=np.int64, count=len(self.codes)) // 8
        times = np.ones(len(links), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        for i, x in enumerate(self.times):
            if x is not None:
                times[starts[i] : starts[i] + sizes[i]] = np.frombuffer(x, dtype=np.int64)
        used = np.searchsorted(codes, links)
        # a cut that only came with texts that have no tokens may hold pairs that no text of the block counts
        times[codes[np.minimum(used, len(codes) - 1)] != links] = 0
        row = {
            "block": self.number, "codes": codes, "docs": docs, "sizes": zlib.compress(sizes.astype("<u4").tobytes(), 1),
            "pairs": zlib.compress(np.minimum(used, len(codes) - 1).astype("<u4").tobytes(), 1), "times": zlib.compress(times.astype("<i8").tobytes(), 1),
        }
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of some rows at a time: few enough, and not too many characters unless it is one row."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
    first = chars = 0
    for i, t in enumerate(texts):
        if i > first and (i - first == ROWS_AT_ONCE or chars + len(t or "") > CHARS_AT_ONCE):
            yield ids[first:i], texts[first:i]
            first, chars = i, 0
        chars += len(t or "")
    if first < len(ids):
        yield ids[first:], texts[first:]


def _align_texts(paths: tuple[str, str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, first = aligner_of(paths), TaskContext.get().partitionId() << BLOCK_BITS
        block = Block(first)
        gc.disable()  # a million remembered cuts, none in a cycle, would be looked through again and again
        try:
            for batch in batches:
                for ids, texts in _parts(batch):
                    cut = [units(" " + t) if t else [] for t in texts]
                    block.add(ids, cut, aligner.of(set(chain.from_iterable(cut)).difference(block.places)))
                    if block.full():
                        yield from block.batches(schema)
                        block = Block(block.number + 1)
            if block.rows:
                yield from block.batches(schema)
        finally:
            gc.enable()

    return run


def _sum_block(schema: pa.Schema):
    def run(block: pa.Table, pairs: pa.Table) -> pa.Table:
        is_text = block.column("sizes").is_null()
        rows, tables = block.filter(is_text), block.filter(pc.invert(is_text))
        n_best, count_sum = np.zeros(rows.num_rows, dtype=np.int64), np.zeros(rows.num_rows, dtype=np.int64)
        if tables.num_rows:
            order = np.argsort(pairs.column("pos").to_numpy())
            counts = pairs.column("n").to_numpy()[order]
            best = pairs.column("best").to_numpy()[order]
            get = lambda name, kind: np.frombuffer(zlib.decompress(tables.column(name)[0].as_py()), dtype=kind).astype(np.int64)
            sizes, at, times = get("sizes", "<u4"), get("pairs", "<u4"), get("times", "<i8")
            starts = np.cumsum(sizes) - sizes
            cut_sum, cut_best = np.add.reduceat(counts[at] * times, starts), np.add.reduceat(best[at] * times, starts)
            for i, cuts in enumerate(rows.column("cuts").to_pylist()):
                if cuts:
                    own, often = _unpack(cuts)
                    n_best[i], count_sum[i] = cut_best[own] @ often, cut_sum[own] @ often
        data = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.Table.from_arrays([data[f.name] if f.name in data else rows.column(f.name) for f in schema], schema=schema)

    return run


def align(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``."""
    paths = paths or default_paths()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = f"doc_id {kind}, {ROWS}, {TABLES}"
    aligned = write_table(rows.mapInArrow(_align_texts(paths, to_arrow_schema(StructType.fromDDL(names))), names), "aligned")

    in_blocks = aligned.where("sizes is not null").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("pos", "pair"))
    in_blocks = in_blocks.select("block", "pos", F.col("pair.codes").alias("code"), F.col("pair.docs").alias("docs"))
    counts = write_table(in_blocks.groupBy("code").agg(F.sum("docs").alias("n")), "pair-counts")
    width = PieceVocabulary(paths[1]).size
    counts = counts.withColumn("a", F.expr(f"code div {width}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    ranked = counts.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    back = in_blocks.join(ranked, "code").select(F.col("block").alias("of_block"), "pos", "n", "best")

    result = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    texts = aligned.drop("codes", "docs").groupBy("block")
    return texts.cogroup(back.groupBy("of_block")).applyInArrow(_sum_block(to_arrow_schema(StructType.fromDDL(result))), result)
