"""Quality rules by distribution divergence.

Two histograms of every whole text are compared with references of its language by Jensen-Shannon distance
(base 2, 0 to 1): character classes, and common words (one bin a word, one for all other words, one for
tokens without a letter). The references are counted over all different texts of the language, so that copies
do not move them; a word is common
when it makes up at least one in ``COMMON_SHARE`` of the language's words, so a language has a bounded
number of them. A distance counts only from a minimum length on, because short texts scatter widely, and the
limit of the word distance falls with the length up to ``FULL_WORDS`` words. A
document is rejected when a base rule fails or a counted distance is above its limit.

Cases: a null or empty text has no words and fails the base rules. A document whose language is null is
held against every reference, and the nearest counts; one that names a language with too few words for a reference,
or any document where there is none, has no distance counted. Equal rows are judged each. Ties of word counts do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlab.llm.common import SPACE_CHARS, bound_batches, write_table

COMMON_SHARE = 1000  # a common word: at least one in so many words of its language
MIN_REFERENCE_WORDS = 2000
MAX_LANGUAGES = 1000
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.32
MIN_WORDS, MAX_WORD_DISTANCE = 30, 0.53
FULL_WORDS, SCATTER = 100, 0.5  # below so many words the limit is higher, as a sample's scatter falls with the root of its length
WINDOW = 5
HELD_WORDS = 200_000  # different words whose counts a task holds, over all languages
FILTER_BITS = 1 << 24  # of the filter of repeated texts: 2 MB go to the tasks, whatever the corpus

# The symbols of the base rules.
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "symbol", "ascii lower", "ascii upper", "other lower", "other upper", "other letter", "digit", "punctuation", "rest")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _class_of(ch: str) -> int:
    if ch in SPACE_CHARS:
        return 0
    if ch in SYMBOLS:
        return 1
    kind = unicodedata.category(ch)
    if kind in ("Ll", "Lu"):
        return (2 if kind == "Ll" else 3) + 2 * (ch > "\x7f")
    return 6 if kind[0] in "LM" else 7 if kind[0] == "N" else 8 if kind[0] == "P" else 9


_TABLE: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """Characters of each class; code points of the planes from 3 on count as rest."""
    if not _TABLE:
        table = np.full(0x110000, 9, dtype=np.uint8)
        table[:0x30000] = [_class_of(chr(i)) for i in range(0x30000)]
        _TABLE.append(table)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(_TABLE[0][codes], minlength=len(CLASSES))


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    code, distinct = ids, len(number)
    for k in range(1, width):
        if distinct > (2**62) // len(number):  # keep the codes exact: number the prefixes anew
            _, code = np.unique(code, return_inverse=True)
            distinct = int(code.max()) + 1
        code = code[:-1] * len(number) + ids[k:]
        distinct *= len(number)
    _, at, n = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[at] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
    return len(lines) - len(set(lines))


class WordKeys:
    """Lower-cased words without punctuation at the ends; "" for a token without a letter or digit inside."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def count(self, words: list[str]) -> Counter:
        out: Counter = Counter()
        if len(self.known) > HELD_WORDS:
            self.known.clear()
        for w, n in Counter(words).items():
            key = self.known.get(w)
            if key is None:
                key = _EDGES.sub("", w.lower())
                self.known[w] = key = w if key == w else key  # one string for both
            out[key] += n
        return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (square root of the divergence to base 2) of two count vectors."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    total = 0.0
    for a in (p, q):
        some = a > 0
        total += float((a[some] * np.log2(a[some] / m[some])).sum())
    return float(np.sqrt(max(0.0, total / 2)))


@dataclass
class Reference:
    """Counts of one language: by character class, of its common words, of all words and of non-words."""

    classes: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    n_words: int = 0
    n_other: int = 0

    def __post_init__(self) -> None:
        self.bins = {w: i for i, w in enumerate(sorted(self.words))}
        common = [self.words[w] for w in sorted(self.words)]
        self.histogram = np.array([*common, self.n_words - sum(common), self.n_other], dtype=np.float64)

    def word_distance(self, counts: Counter) -> float:
        own = np.zeros(len(self.histogram))
        for w, n in counts.items():
            own[self.bins.get(w, -2) if w else -1] += n
        return jensen_shannon(own, self.histogram)


def _repeated_texts(texts: DataFrame) -> np.ndarray:
    """Filter of the hashes ``h`` of texts that more than one row of a language holds; its size does not grow."""
    repeated = texts.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit, width = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), 1 << 15  # of one bitmap of Spark's
    maps = repeated.groupBy(F.floor(bit / width).cast("int").alias("at")).agg(F.bitmap_construct_agg(bit % width).alias("bits")).collect()
    bits = np.zeros((FILTER_BITS // width, width // 8), dtype=np.uint8)
    for r in maps:
        bits[r["at"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits.ravel()


def _filtered(bits: np.ndarray, hit: bool):
    """Batches of the rows whose hash is in the filter, or of those whose hash is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("h").to_numpy() & (FILTER_BITS - 1)
            yield batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1) == hit))

    return run


def _count_references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str | None, Counter] = defaultdict(Counter)
    classes: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), dtype=np.int64))
    keys, held = WordKeys(), 0

    def counts(lang: str, word: list, cls: list, n: list) -> pa.RecordBatch:
        cols = [pa.array([lang] * len(n), pa.string()), pa.array(word, pa.string()), pa.array(cls, pa.int32()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "word", "cls", "n"])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in classes.items():
            some = np.flatnonzero(c).tolist()
            yield counts(lang, [None] * len(some), some, c[some].tolist())
        while words:  # a language's counts go as soon as they are sent
            lang, c = words.popitem()
            yield counts(lang, list(c), [-1] * len(c), list(c.values()))
        classes.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text and lang is not None:
                before = len(words[lang])
                words[lang].update(keys.count(_WORD.findall(text)))
                classes[lang] += class_counts(text)
                held += len(words[lang]) - before
                if held > HELD_WORDS:
                    yield from flush()
                    held = 0
    yield from flush()


def build_references(docs: DataFrame, max_languages: int = MAX_LANGUAGES) -> dict[str, Reference]:
    """References of every language with enough words, counted over all different texts.

    Texts whose hash is not in the filter of repeated ones stand once and are counted where they are read; of the
    others one row each (by 128 bits of hash) is counted after a shuffle. Tasks send partial counts; words are summed by (language, word). Only what is bounded by definition
    comes back: the class counts, and at most ``COMMON_SHARE`` words a language.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & (F.col("text") != ""))
    texts = texts.withColumn("h", F.xxhash64("text"))
    bits, counted = _repeated_texts(texts), "lang string, word string, cls int, n bigint"
    copies = texts.withColumn("g", F.xxhash64(F.lit(1), "text")).mapInArrow(_filtered(bits, True), "lang string, text string, h bigint, g bigint")
    once = texts.mapInArrow(lambda batches: _count_references(_filtered(bits, False)(batches)), counted)
    parts = write_table(once.union(copies.dropDuplicates(["lang", "h", "g"]).mapInArrow(_count_references, counted)), "language-counts")
    is_word = F.col("word") != ""
    totals = parts.groupBy("lang").agg(
        F.sum(F.when(is_word, F.col("n")).otherwise(0)).alias("n_words"),
        F.sum(F.when(F.col("word") == "", F.col("n")).otherwise(0)).alias("n_other"),
        *[F.sum(F.when(F.col("cls") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(CLASSES))],
    )
    totals = write_table(totals.where(F.col("n_words") >= MIN_REFERENCE_WORDS), "language-totals")
    known = totals.limit(max_languages + 1).collect()
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages with {MIN_REFERENCE_WORDS} words or more")
    counts = parts.where(is_word).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = counts.join(totals.select("lang", "n_words"), "lang").where(F.col("n") * COMMON_SHARE >= F.col("n_words"))
    words: dict[str, dict[str, int]] = defaultdict(dict)
    for r in common.select("lang", "word", "n").collect():
        words[r["lang"]][r["word"]] = r["n"]
    return {
        r["lang"]: Reference(np.array([r[f"c{i}"] for i in range(len(CLASSES))], dtype=np.float64), words[r["lang"]], r["n_words"], r["n_other"])
        for r in known
    }


def word_limit(n: int) -> float:
    """Limit of the word distance of a text of ``n`` words."""
    return MAX_WORD_DISTANCE + SCATTER * max(0.0, n**-0.5 - FULL_WORDS**-0.5)


def judge_text(text: str, refs: list[Reference], keys: WordKeys) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char and word distance, kept."""
    words = _WORD.findall(text)
    classes = class_counts(text)
    n, chars, repeats = len(words), len(text) - int(classes[0]), repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    by_class = min((jensen_shannon(classes, r.classes) for r in refs), default=None) if len(text) >= MIN_CHARS else None
    by_word = None
    if n >= MIN_WORDS and refs:
        counts = keys.count(words)
        by_word = min(r.word_distance(counts) for r in refs)
    far = (by_class or 0) > MAX_CHAR_DISTANCE or (by_word is not None and by_word > word_limit(n))
    return n, chars, int(classes[1]), duplicate_lines(text), repeats, failed, by_class, by_word, not failed and not far


_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_()),
]


def references_for(lang: str | None, references: dict[str, Reference]) -> list[Reference]:
    """What a document is held against: its language's reference if there is one, all if it names no language."""
    return list(references.values()) if lang is None else [references[lang]] if lang in references else []


def judge(docs: DataFrame, references: dict[str, Reference], id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` and the measures, distances and verdict of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        for batch in batches:
            rows = [
                judge_text(text or "", references_for(lang, references), keys)
                for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True)
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in id_cols] + [pa.array(x, t) for x, (_, t) in zip(cols, _FIELDS, strict=True)],
                names=[*id_cols, *[f for f, _ in _FIELDS]],
            )

    bound_batches(docs.sparkSession)
    rows = docs.select(*id_cols, F.col("lang").cast("string").alias("_lang"), F.col("text").alias("_text"))
    ids = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in id_cols)
    return rows.mapInArrow(
        run,
        f"{ids}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, char_distance double, word_distance double, kept boolean",
    )


def quality(docs: DataFrame) -> DataFrame:
    """References from ``docs`` itself, then the verdict of each of its rows."""
    return judge(docs, build_references(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns (the verdict is taken where the text is read)."""
    references = build_references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        for batch in batches:
            good = [
                judge_text(text or "", references_for(lang, references), keys)[-1]
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
