"""Line dedup by overlapping three-line windows.

A document's lines with a word (trimmed) form overlapping windows of three consecutive lines; blank lines
between them are skipped when windows are formed. Windows are compared by two 64-bit hashes over all
documents. The first occurrence, by (doc_id, text hash, line number), stays; every later one covers the lines
from its first to its last, blank lines between included. The covered positions of a document are merged
and removed. The earliest place of a line is never covered, so no line's text vanishes from the corpus.

Cases: a document with fewer than three lines with words, an empty or null text has no window and stays as
it is. Rows equal in id and text are one document and get the same result. A null id sorts first. Columns
of the input beside id and text pass through, also when named like a helper column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.llm.common import SPACE_CHARS, WORD_PATTERN, as_row, join_null_safe
from commentlab.session import cut_lineage

WINDOW_LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """``(doc_id, text_id, first, last, h1, h2)``: each window of ``width`` lines with a word, by line numbers."""
    numbered = F.transform(
        _lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(SPACE_CHARS)).alias("l"))
    )
    full = docs.select(
        "doc_id", F.xxhash64("text").alias("text_id"), F.filter(numbered, lambda x: x["l"] != "").alias("full")
    ).where(F.size("full") >= width)

    # shifted copies of the line array, so that each window is one element of the zipped array
    shifts = [F.slice("full", F.lit(k + 1), F.size("full") - F.lit(width - 1)).alias(f"s{k}") for k in range(width)]
    windows = full.select("doc_id", "text_id", F.explode(F.arrays_zip(*shifts)).alias("w"))
    texts = [F.col(f"w.s{k}.l") for k in range(width)]
    return windows.select(
        "doc_id",
        "text_id",
        F.col("w.s0.i").alias("first"),
        F.col(f"w.s{width - 1}.i").alias("last"),
        F.xxhash64(*texts).alias("h1"),
        F.xxhash64(F.lit(width), *reversed(texts)).alias("h2"),
    )


def later_windows(windows: DataFrame) -> DataFrame:
    """The windows that occur earlier elsewhere. A window shared by very many documents is met as partial
    minima per task, then as one row that is joined back (a skewed key is split by AQE)."""
    place = F.struct("doc_id", "text_id", "first")
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep"))
    repeated = cut_lineage(repeated.where(F.col("n") > 1).drop("n"), "repeated-windows")
    return windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("keep")))


def dedup_lines(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_removed``, which replace columns of these
    names."""
    docs = docs.drop("n_lines", "n_removed")
    windows = cut_lineage(line_windows(docs.select("doc_id", "text"), width), "line-windows")
    covered = (
        later_windows(windows)
        .groupBy("doc_id", "text_id")
        .agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
        .select(
            "doc_id",
            "text_id",
            F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"])))).alias("gone"),
        )
    )
    rows = docs.select(as_row(docs), "doc_id", F.xxhash64("text").alias("text_id"))
    marked = join_null_safe(rows, covered, ["doc_id", "text_id"], "left")
    text = F.col("row.text")
    # the outer lambda binds the line array to a variable, so the text is split once, not once a line
    kept = F.transform(
        F.array(_lines(text)),
        lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: ls[i]),
    )
    cleaned = F.when(F.col("gone").isNotNull(), F.array_join(kept[0], "\n")).otherwise(text)
    return marked.select(
        *[(cleaned if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns],
        F.coalesce(F.size(_lines(text)), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def keep_unrepeated(docs: DataFrame, width: int = WINDOW_LINES) -> DataFrame:
    """``docs`` cleaned, without the documents that lose their last word: all they say stands in earlier ones. A document that
    loses nothing stays, also one without words."""
    beside = docs.drop("text")
    cleaned = dedup_lines(docs.select(as_row(beside, "beside"), "doc_id", "text"), width)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD_PATTERN)
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    return kept.select(*[F.col("text") if c == "text" else F.col("beside")[c].alias(c) for c in docs.columns])
