"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all its predecessor kept, written as Parquet and read again, and returns the columns of
``documents``; the last one returns the packed pieces with their token ids.

In every stage extra columns pass through under any name, and an empty table gives an empty one. Null and empty texts fail the
base rules of the first stage (fewer than ten words); the later stages keep them, when they are run by themselves, as
their docstrings say. No stage depends on the order or the partitioning of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commentlab.llm import line_dedup, mixing, ngram_join, packing, quality
from commentlab.session import cut_lineage
from commentlab.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail a base rule or diverge from their language's references go.

    A document without words fails a base rule. Rows that repeat are judged each, and alike; they count once in a reference.
    A null language is a language of its own; a null id is kept like any other."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: three-line windows that an earlier document holds are cut from the later ones; a document that is cut to
    nothing goes, since all it says is kept elsewhere.

    Earlier is by (id, hash of the text, line), a null id first. Rows equal in id and text are one document and
    are cut alike. Null texts, and texts of fewer than three lines with words, stay as they are."""
    return line_dedup.keep_unrepeated(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near copies stays: the one with the smallest id, of equal ids that with
    the smallest hash of the text, and rows equal in both stay together.

    Documents without words are near copies of nothing and stay. A null id comes last."""
    return ngram_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the target of its source asks for, 0 to 3 times.

    Ties in the seeded order go by id and size. Rows equal in id, source and size come equally often. A null source is a
    source of its own; null and empty texts have size 0 and count for nothing."""
    return mixing.repeat_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of documents in sequences of at most 2048 tokens, sources mixed in every sequence.

    A null or empty text is its end token. Rows that repeat are packed each. A null source is a queue of its own."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

# tokenizing and the divergence rules are beyond SQL; tests compare every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread_by=False)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
