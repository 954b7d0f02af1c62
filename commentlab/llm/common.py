"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentlab.session import scratch_path

# A word is a run of characters other than these white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

BATCH_SETTING, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20) + "b"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From here on rows go to Python in batches of ``BATCH_BYTES``, unless the session names a size of its own.

    A task holds a batch several times: outside the JVM's heap, in buffers that double as they grow, and in Python as Arrow
    data, as strings and as what is returned. Spark's own bound lets 10,000 whole texts into one.
    """
    if spark.conf.get(BATCH_SETTING, SPARKS_OWN) in (SPARKS_OWN, str(64 << 20)):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), from one split and a look at the first and last character."""
    parts = F.size(F.split(text, f"{SPACE_CLASS}+", -1))

    def outer(c: Column) -> Column:  # a separator (or nothing) at the end makes an empty part
        return F.ascii(c).isin(0, 32, 9, 10, 11, 12, 13) & ~c.eqNullSafe(F.lit("\u0000"))

    lead = F.when(outer(F.left(text, F.lit(1))), 1).otherwise(0)
    tail = F.when((F.length(text) > 0) & outer(F.right(text, F.lit(1))), 1).otherwise(0)
    return F.coalesce((parts - lead - tail).cast("bigint"), F.lit(0).cast("bigint"))


def starts_before(written: DataFrame, size_col: str, group: list[str], out: str) -> DataFrame:
    """Per (``_part``, group): how much ``size_col`` the earlier input partitions hold of the group.

    ``written`` is a written table whose rows carry the number ``_part`` of the task that wrote them. The
    result has one row per (task, group), so a group of any size is only ever met as one number per task.
    """
    sums = written.groupBy("_part", *group).agg(F.sum(size_col).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("bigint").alias(out))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL equal to NULL; the right side's key columns are dropped."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back: computed once, and kept if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one, so that helper columns beside it can have any name; ``select(name + ".*")`` gives
    them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)
