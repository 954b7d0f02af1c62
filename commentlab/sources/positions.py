"""Row positions in file order (D1 and D7 by position), without sorting the rows.

A position is the number of rows before a row in its folder: files in the order of their paths, rows in the order in
which each file holds them. It comes from Spark's file metadata, never from the values:

- Parquet files carry the row's index in its file; the files' row counts come from the same metadata.
- Text formats have no row index. Spark cuts a file into blocks and reads a block's rows in order in one task, so a row
  has its place in the block from the task that read it, and the blocks' row counts add up. These rows are written
  once, so that their places and the counts come from one reading.

The counts form a table of one row per file or block, summed up by a distributed scan; it is joined to the rows by file
and block. Rows themselves are not shuffled for their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlab.operators.order import segmented_scan
from commentlab.session import cut_lineage

_FILE, _BLOCK, _PLACE, _BEFORE = "_file", "_block", "_place", "_before"


def _with_offsets(rows: DataFrame, counted: DataFrame, pos_col: str) -> DataFrame:
    """``rows`` with ``pos_col`` from ``counted`` (_file, _block, n), the rows of each part of the folder."""
    scanned = segmented_scan(counted.withColumn("_all", F.lit(0)), ["_all"], [_FILE, _BLOCK], {_BEFORE: ("sum", "n", False)})
    offsets = cut_lineage(scanned.select(_FILE, _BLOCK, F.coalesce(_BEFORE, F.lit(0)).alias(_BEFORE)), "file-offsets")
    placed = rows.join(offsets, [_FILE, _BLOCK])
    return placed.withColumn(pos_col, (F.col(_BEFORE) + F.col(_PLACE)).cast("bigint")).drop(_FILE, _BLOCK, _PLACE, _BEFORE)


def parquet_positions(spark: SparkSession, path: str, pos_col: str = "position", columns: list[str] | None = None) -> DataFrame:
    """The rows of a Parquet file or folder with their 0-based position."""
    source = spark.read.parquet(path)
    meta = [F.col("_metadata.file_path").alias(_FILE), F.lit(0).cast("bigint").alias(_BLOCK), F.col("_metadata.row_index").alias(_PLACE)]
    rows = source.select(*[F.col(f"`{c}`") for c in columns or source.columns], *meta)
    # only metadata is read here: no column of the files
    counted = source.select(*meta).groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"))
    return _with_offsets(rows, counted, pos_col)


def text_positions(spark: SparkSession, path: str, schema: T.StructType, pos_col: str = "position", fmt: str = "csv", **options: object) -> DataFrame:
    """The rows of a file or folder of a text format (CSV, JSON, text) with their 0-based position."""
    source = spark.read.schema(schema).format(fmt).options(**options).load(path)
    # rows of one task count up, whatever blocks the task reads one after the other
    tagged = source.select(
        "*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias("_met")
    )
    tagged = cut_lineage(tagged, "rows-in-file-order")
    counted = cut_lineage(tagged.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("_met").alias("_first")), "file-blocks")
    rows = tagged.join(counted.drop("n"), [_FILE, _BLOCK])
    return _with_offsets(rows.withColumn(_PLACE, F.col("_met") - F.col("_first")).drop("_met", "_first"), counted.drop("_first"), pos_col)


def attach_by_position(left: DataFrame, right: DataFrame, pos_col: str = "position", how: str = "inner") -> DataFrame:
    """D1 by row position: ``right``'s columns beside the row of ``left`` at the same position (``how`` as in ``join``)."""
    clash = set(left.columns) & set(right.columns) - {pos_col}
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}; rename them first")
    return left.join(right, pos_col, how)


def alignment(left: DataFrame, right: DataFrame, left_id: Column | str, right_id: Column | str, pos_col: str = "position") -> DataFrame:
    """Are two tables' ids equal position by position? One row: ``positions``, ``same``, ``different`` (NULL equals
    NULL), ``left_only`` and ``right_only`` (positions beyond the other table)."""
    a = left.select(pos_col, F.lit(True).alias("_l"), (F.col(left_id) if isinstance(left_id, str) else left_id).alias("_a"))
    b = right.select(pos_col, F.lit(True).alias("_r"), (F.col(right_id) if isinstance(right_id, str) else right_id).alias("_b"))
    both = F.col("_l") & F.col("_r")
    equal = F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, pos_col, "full_outer").agg(
        F.count(F.lit(1)).alias("positions"),
        F.count(F.when(both & equal, 1)).alias("same"),
        F.count(F.when(both & ~equal, 1)).alias("different"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"),
    )
