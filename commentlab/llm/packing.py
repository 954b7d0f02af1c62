"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows.

Every source is a queue of its documents' tokens. A round gives each queue its share of one window as credit;
the queue sends whole segments of ``segment`` tokens as long as its credit lasts and carries the rest, its
deficit, to the next round. The rounds follow each other in one token stream that is cut every ``window``
tokens, so every window holds the target proportions up to about a segment per source, and only the last
window is padded. When a queue is empty its share goes to the others by weight.

After r rounds a queue has been credited its share of r windows, so its deficit, what it has sent and its
place in the stream are functions of r and of the table of source totals. Any task can work them out for the
documents it holds: the deficits are carried over windows and partitions without a sequential pass.

Weights default to the sources' token counts, the only ones that hold up to the last window when every
token is packed; others may be given and hold until the first queue runs dry.

Cases: a null or empty text is one end token; a null source is a queue of its own; documents longer than a
window are cut; equal rows are packed each; an empty table gives an empty result. More than
``max_sources`` sources are refused, since the source totals go to every task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer
from tokenizers.models import BPE

from commentlab.llm.common import byte_alphabet, bound_batches, join_null_safe, starts_before, write_table

WINDOW = 2048
SEGMENT = 16
END_ID = 1
MAX_SOURCES = 4096
ROWS_AT_ONCE = 512
HELD_PIECES = 250_000
PIECES_AT_ONCE, RANKED_AT_ONCE = 200, 2000
LONG_PIECE = 2000  # characters; the faster library's time grows with the square of a piece's length

# The pieces that the default tokenizer's pre-tokenizer makes of lower-cased text, and the
# characters for which they are known to be right: ASCII, Latin letters in composed form (without the capitals
# whose small letter lies beyond these), common punctuation.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_EXTENDED = "".join(c for c in map(chr, range(0x131, 0x250)) if c.lower() <= "\u024f")
_PLAIN = re.compile(rf"[\t\n\r -~\u00a1\u00ab\u00bb\u00bf-\u012f{_EXTENDED}\u2010-\u2027]*")
_CHUNKS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_SEPARATOR = "\x01"
_TOKENIZERS: dict[str, WordTokenizer] = {}


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class RankedPieces:
    """Ids of pieces by a faster library, which merges the neighbours whose joined bytes have the lowest rank.

    It knows no suffix at the end of a word: a byte that no plain piece holds stands for it, and joins to the last byte before any
    other merge. Its merges are those of the vocabulary where merges only join what earlier ones made and make every
    token once, and where every token by itself is merged to that token: then the two parts of a token that ever stand
    side by side are those that its merge names. ``of`` gives None for other vocabularies.
    """

    def __init__(self, ranks: dict[bytes, int], ids: np.ndarray):
        self.merges = tiktoken.Encoding("pieces", pat_str=f"[^{_SEPARATOR}]+{_SEPARATOR}", mergeable_ranks=ranks, special_tokens={})
        self.ids = ids
        self.ends = np.zeros(len(ids), dtype=bool)
        self.ends[[i for token, i in ranks.items() if len(token) > 1 and token.endswith(_SEPARATOR.encode())]] = True

    @classmethod
    def of(cls, model: dict, dtype: str) -> RankedPieces | None:
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        others = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or not suffix or any(model.get(k) for k in others):
            return None
        alphabet = byte_alphabet()
        mark = ord(_SEPARATOR)
        end = {c: chr(0xE000 + b) for c, b in alphabet.items()}  # one character for a byte and the suffix

        def one_each(token: str) -> str:
            cut = token.removesuffix(suffix)
            return token if cut == token or not cut else cut[:-1] + end[cut[-1]]

        def raw(token: str) -> bytes:
            cut = token.removesuffix(suffix)
            return bytes(alphabet[c] for c in cut) + bytes([mark] * (cut != token))

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        tokens = [*alphabet, *[c + suffix for c, b in alphabet.items() if b != mark]]
        made = set(tokens)
        for a, b in pairs:
            if a not in made or b not in made or a + b in made or a.endswith(suffix) or mark in raw((a + b).removesuffix(suffix)):
                return None
            if (a + b).endswith(suffix) != b.endswith(suffix):  # spells the suffix in the middle of a word
                return None
            made.add(a + b)
        tokens += [a + b for a, b in pairs]
        if not made <= vocab.keys():
            return None
        plain = BPE({one_each(t): i for i, t in enumerate(tokens)}, [(one_each(a), one_each(b)) for a, b in pairs])
        if any(len(plain.tokenize(one_each(t))) != 1 for t in tokens):
            return None
        return cls({raw(t): i for i, t in enumerate(tokens)}, np.array([vocab[t] for t in tokens], dtype=dtype))

    def encode(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids; no piece is empty or holds the separator."""
        found = np.array(self.merges.encode_ordinary(_SEPARATOR.join([*pieces, ""])), dtype=np.int64)
        ids, width = self.ids[found].tobytes(), self.ids.itemsize
        cuts = (width * (np.flatnonzero(self.ends[found]) + 1)).tolist()
        for w, a, b in zip(pieces, [0, *cuts[:-1]], cuts, strict=True):
            yield w, ids[a:b]


class WordTokenizer:
    """Token ids of whole texts, one look-up per piece.

    The tokenizer lower-cases, splits text into runs of letters, single digits and runs of other characters, and
    encodes each by itself, so the ids of a text are those of its pieces in turn. Text with other characters, or
    that may hold a special token, is handed over word by word as it is: no piece crosses white space. The ids
    of pieces seen lately are kept in two generations; when the young one is full it replaces the old one.

    New pieces are merged by ranks where ``RankedPieces`` finds that the vocabulary allows it, else by the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.separator = self._ids(_SEPARATOR)
        with open(path, encoding="utf-8") as f:
            self.ranked = RankedPieces.of(json.load(f)["model"], self.dtype)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: many are encoded as one text, with a separator between them to tell them apart."""
        if self.ranked is not None:
            plain = [w for w in pieces if len(w) <= LONG_PIECE and _PLAIN.fullmatch(w) and "<|" not in w]
            for at in range(0, len(plain), RANKED_AT_ONCE):
                self.young.update(self.ranked.encode(plain[at : at + RANKED_AT_ONCE]))
            pieces = list(set(pieces).difference(plain))
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            group = pieces[at : at + PIECES_AT_ONCE]
            ids = self._ids(f" {_SEPARATOR} ".join(group))
            cuts = np.flatnonzero(ids == self.separator[0]).tolist() if len(self.separator) == 1 else []
            if len(cuts) == len(group) - 1:
                raw, width = ids.tobytes(), ids.itemsize
                for w, a, b in zip(group, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True):
                    self.young[w] = raw[a * width : b * width]
            else:  # a piece holds the separator itself
                for w in group:
                    self.young[w] = self._ids(w).tobytes()

    @staticmethod
    def pieces(text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for chunk in _CHUNKS.findall(text):
            out += _PIECES.findall(chunk.lower()) if _PLAIN.fullmatch(chunk) and "<|" not in chunk else [chunk]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids (``dtype``) of each text."""
        if len(self.young) > HELD_PIECES:
            self.young, self.old = {}, self.young
        pieces = [self.pieces(t) for t in texts]
        absent = []
        for w in set(chain.from_iterable(pieces)).difference(self.young):
            if (ids := self.old.get(w)) is None:
                absent.append(w)
            else:
                self.young[w] = ids
        self._learn(absent)
        return [b"".join(map(self.young.__getitem__, ps)) for ps in pieces]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tok = WordTokenizer.of(path)
        end = np.array([end_id], dtype=tok.dtype).tobytes()
        width = len(end)
        sent: dict[str | None, int] = {}
        for batch in _slices(batches):
            ids = [x + end for x in tok.encode([t or "" for t in batch.column("text").to_pylist()])]
            counts = [len(x) // width for x in ids]
            starts = []
            for source, n in zip(batch.column("source").to_pylist(), counts, strict=True):
                starts.append(at := sent.get(source, 0))
                sent[source] = at + n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(starts, pa.int64()),
                    pa.array([part] * len(ids), pa.int32()),
                ],
                names=["doc_id", "source", "doc_tokens", "ids", "_local", "_part"],
            )

    return run


class RoundRobin:
    """The schedule: what each queue has sent after r rounds, in closed form.

    Queue s is credited ``weight[s] * v`` tokens at virtual time v, until it is empty; v grows within a round
    by as much as one window of credit for the queues that are not empty yet.
    """

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int = WINDOW, segment: int = SEGMENT):
        self.totals = totals.astype(np.int64)
        self.weights = weights.astype(np.float64)
        self.window, self.segment = window, segment
        empty_at = self.totals / self.weights
        self.v_knots = np.concatenate([[0.0], np.unique(empty_at)])
        self.credit_knots = np.array([np.minimum(self.weights * v, self.totals).sum() for v in self.v_knots])
        self.credit_knots[-1] = float(self.totals.sum())
        self.rounds = -(-int(self.totals.sum()) // window)

    def sent(self, r: np.ndarray, s: np.ndarray | slice) -> np.ndarray:
        """Tokens that queue ``s`` has sent after ``r`` rounds; broadcasts r against s."""
        total = self.totals[s]
        credit = self.weights[s] * np.interp(r * float(self.window), self.credit_knots, self.v_knots)
        half = self.segment / 2  # a queue starts with half a segment of credit
        whole = (np.floor((credit + half) / self.segment) * self.segment).astype(np.int64)
        done = (r >= self.rounds) | (credit >= total)
        return np.where(done, total, np.minimum(whole, total))

    def stream_start(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Place in the stream of what queue ``s[i]`` sends in round ``r[i]``."""
        each, at = np.unique(r, return_inverse=True)
        now, then = self.sent(each[:, None], slice(None)), self.sent(each[:, None] + 1, slice(None))
        earlier = np.cumsum(then - now, axis=1) - (then - now)
        return now.sum(axis=1)[at] + earlier[at, s]

    def pieces(self, s: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents at ``[start, start + n)`` of queue ``s``: row, start in the row, length, place."""

        def round_of(tokens: np.ndarray) -> np.ndarray:
            v = np.clip(tokens, 0, None) / self.weights[s]
            return (np.interp(v, self.v_knots, self.credit_knots) / self.window).astype(np.int64)

        # the credit is at most a segment away from what was sent; rounds outside send nothing of the row
        low = np.maximum(round_of(start - self.segment) - 1, 0)
        high = np.minimum(round_of(start + n + self.segment) + 2, self.rounds)
        row, r = _ranges(low, high - low)
        q = s[row]
        first, end = self.sent(r, q), self.sent(r + 1, q)
        a, b = np.maximum(first, start[row]), np.minimum(end, (start + n)[row])
        some = b > a
        row, r, q, a, b, first = row[some], r[some], q[some], a[some], b[some], first[some]
        place = self.stream_start(r, q) + (a - first) if len(r) else a
        # cut where a window ends
        window = place // self.window
        parts = (place + (b - a) - 1) // self.window - window + 1
        piece, k = _ranges(np.zeros(len(row), dtype=np.int64), parts)
        cut = np.maximum(place[piece], (window[piece] + k) * self.window)
        stop = np.minimum((place + b - a)[piece], (window[piece] + k + 1) * self.window)
        row = row[piece]
        return row, (a - place)[piece] + cut - start[row], stop - cut, cut


def _ranges(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the numbers ``low[i] .. low[i] + n[i] - 1``, with i beside them."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]


def _cut(order: list[str | None], schedule: RoundRobin, dtype: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {source: i for i, source in enumerate(order)}
        for batch in _slices(batches):
            s = np.array([number[x] for x in batch.column("source").to_pylist()], dtype=np.int64)
            n = batch.column("doc_tokens").to_numpy(zero_copy_only=False)
            row, start, length, place = schedule.pieces(s, batch.column("start").to_numpy(zero_copy_only=False), n)
            if int(length.sum()) != int(n.sum()):
                raise AssertionError("the pieces of a batch do not add up to its tokens")
            ids = [np.frombuffer(x, dtype=dtype).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            cuts = [memoryview(ids[i])[4 * a : 4 * (a + k)] for i, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "source": batch.column("source").take(pa.array(row)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                "doc_tokens": pa.array(n[row]),
                "sequence_id": pa.array(place // schedule.window),
                "offset": pa.array(place % schedule.window),
            }
            if with_ids:
                out["ids"] = pa.array([bytes(c) for c in cuts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    segment: int = SEGMENT,
    weights: dict[str | None, float] | None = None,
    max_sources: int = MAX_SOURCES,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``with_ids``, the ids as little-endian unsigned 32-bit numbers."""
    bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    tokens = rows.mapInArrow(
        _tokenise(path, end_id), f"doc_id {kind}, source string, doc_tokens bigint, ids binary, _local bigint, _part int"
    )
    tokens = write_table(tokens, "tokens")
    totals = tokens.groupBy("source").agg(F.sum("doc_tokens").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda t: (t["source"] is None, t["source"] or ""))
    order, n = [t["source"] for t in totals], np.array([t["n"] for t in totals], dtype=np.int64)
    if weights is None:
        share = n
    elif missing := [s for s in order if weights.get(s, 0) <= 0]:
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    else:
        share = np.array([weights[s] for s in order])
    schedule = RoundRobin(n, share, window, segment)
    # one row a task and source; written, so that the planner knows its bytes and broadcasts it where it may
    starts = write_table(starts_before(tokens, "doc_tokens", ["source"], "_before"), "starts")
    placed = join_null_safe(tokens, starts, ["_part", "source"])
    schema = f"doc_id {kind}, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.select("doc_id", "source", "doc_tokens", "ids", (F.col("_local") + F.col("_before")).alias("start")).mapInArrow(
        _cut(order, schedule, WordTokenizer.of(path).dtype, with_ids), schema + (", ids binary" if with_ids else "")
    )
