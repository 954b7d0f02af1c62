"""Token counts by byte-pair merging, without token ids.

A text is normalised as the vocabulary's library does it (spaces become U+2581, one is put in front) and taken as a
linked list of its characters. A heap holds the adjacent pairs that join to a piece of the vocabulary; the pair of the
lowest rank (the leftmost of equal ones) is popped again and again and merged, its neighbours form new pairs, and entries
whose symbols have changed since are passed over. Every merge takes one token away, so that the count is the number of
initial symbols less the merges. A character that the vocabulary lacks stands for its UTF-8 bytes (byte fallback).

No piece of the vocabulary reaches over the start of a space or line break that follows other text (checked when the
vocabulary is loaded), so merges never cross these places: texts are cut there and every different cut is merged once
while a worker remembers it. Cuts seen lately are kept in two generations of bounded size.

Cases: a null or empty text counts 0 tokens and 0 bytes; whole texts count, whatever their length; strings of special
tokens are plain text; rows that repeat count each; an empty table gives an empty result. Only the id and text columns
are read, so that other columns may have any name.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat
from operator import add

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

LIMIT = 4096
ROWS_AT_ONCE = 512
HELD_UNITS = 400_000
LONG_UNIT = 200  # characters; longer cuts hardly come again and are not kept
SPACE = "▁"  # fixed value: how pieces write a space
_WORDS = re.compile(r"\s*\S+|\s+")
_CUTS = re.compile(rf"(?<=[^\s{SPACE}])(?=[ \n])")
_ODD = re.compile(rf"[^\S \n]|{SPACE}")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    """``text`` cut before every space or line break that follows a character which is no white space."""
    return _CUTS.split(text) if _ODD.search(text) else _WORDS.findall(text)


def check_cuts(pieces: list[str]) -> None:
    """Refuse a vocabulary with a piece that reaches over a place where ``units`` cuts."""
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if b == "\n" or (b == SPACE and a != SPACE):
                raise ValueError(f"piece {piece!r} reaches over the start of white space")


def plain_pieces(sp: SentencePieceProcessor) -> dict[str, int]:
    """piece -> id of all pieces that texts are merged to, in the order of ids."""
    ids = range(sp.get_piece_size())
    return {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class MergeRanks:
    """Ranks of a byte-pair vocabulary with byte fallback: the lower a rank, the earlier its pair is merged."""

    def __init__(self, ranks: dict[str, float]):
        check_cuts(list(ranks))
        self.ranks = ranks

    @classmethod
    def from_model(cls, path: str) -> MergeRanks:
        sp = SentencePieceProcessor(model_file=path)
        if sp.normalize(" Aﬁ\n  b ") != f"{SPACE}{SPACE}Aﬁ\n{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the vocabulary rewrites texts beyond their spaces")
        return cls({piece: -sp.get_score(i) for piece, i in plain_pieces(sp).items()})

    def count(self, text: str) -> int:
        """Tokens of ``text``, whose spaces are written as U+2581."""
        rank_of = self.ranks.get
        symbols: list[str | None] = list(text)
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        # what a character counts beyond one token: only those that the vocabulary lacks, as bytes
        extra = {c: len(c.encode("utf-8")) - 1 for c in set(text).difference(self.ranks)}
        tokens = end + (sum(map(extra.get, symbols, repeat(0))) if extra else 0)
        heap = []
        for i, pair in enumerate(map(add, text, text[1:])):
            if (rank := rank_of(pair)) is not None:
                heap.append((rank, i, i + 1, pair))
        heapq.heapify(heap)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(pair):
                continue  # one of the two has been merged since
            tokens -= 1
            if extra:
                tokens -= extra.get(a, 0) + extra.get(b, 0)
            symbols[left], symbols[right] = pair, None
            after[left] = following = after[right]
            if following < end:
                before[following] = left
                joined = pair + symbols[following]
                if (rank := rank_of(joined)) is not None:
                    heapq.heappush(heap, (rank, left, following, joined))
            if (leading := before[left]) >= 0:
                joined = symbols[leading] + pair
                if (rank := rank_of(joined)) is not None:
                    heapq.heappush(heap, (rank, leading, left, joined))
        return tokens


class TokenCounter:
    """Counts of whole texts; every different cut of the texts is merged once while it is remembered."""

    def __init__(self, ranks: MergeRanks):
        self.ranks = ranks
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _learn(self, absent: set[str]) -> dict[str, int]:
        """Counts of cuts that ``young`` lacks; the long ones are returned, not kept."""
        long = {}
        for unit in absent:
            known = self.old.get(unit)
            n = self.ranks.count(unit.replace(" ", SPACE)) if known is None else known
            (self.young if len(unit) <= LONG_UNIT else long)[unit] = n
        return long

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.young) > HELD_UNITS:
            self.young, self.old = {}, self.young
        cut = [units(" " + t) if t else [] for t in texts]
        long = self._learn(set(chain.from_iterable(cut)).difference(self.young))
        if long:
            known = self.young
            return [sum(known[u] if u in known else long[u] for u in us) for us in cut]
        return [sum(map(self.young.__getitem__, us)) for us in cut]


_COUNTERS: dict[str, TokenCounter] = {}  # one a worker process: its tasks share what is remembered


def counter_of(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(MergeRanks.from_model(path))
    return _COUNTERS[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                counts = counter.counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return run


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``."""
    text = F.col(text_col)
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), n_bytes.alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_count(model or default_model()), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
