"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

``water_fill`` shares a word budget over the sources in proportion to their weights, clamps a source at
``max_epochs`` times its own words and reshares the excess until no source is above its cap. That fixed
point has one water level: target = min(cap, level * weight). Sources reach their caps in the order of
cap / weight, so running sums over the source table (one row per source) give the level.

``mix`` turns targets into repetitions of documents. A source is passed whole floor(target / size) times; the
rest of its target goes to the documents at the front of a seeded order (md5 of seed and id), cut where the
running size is nearest to the rest. Reruns and other partitionings give the same choice.

Cases: a null or empty text has size 0 (its repetitions take 0 words); a null source is a source of its own,
last in order; a source of size 0 gets target 0; an empty table gives an empty result; rows that are equal
in id and size are interchangeable. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentlab.llm.common import as_row, join_null_safe, word_count
from commentlab.operators.order import segmented_scan, shuffle_key
from commentlab.session import cut_lineage

SEED = 20240
MAX_EPOCHS = 3


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, for ranks 1, 2, 3, ..."""
    return (rank - 1) % 3 + 1


def water_fill(sizes: DataFrame, budget: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, weight)`` plus ``target``; ``budget`` defaults to the sum of the sizes.

    One row per source goes through the two windows, however many documents there are. A budget above
    the sum of all caps leaves every source at its cap.
    """
    everything = Window.partitionBy(F.lit(1))
    fill_order = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    above = fill_order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = fill_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = (F.sum("source_size").over(everything) if budget is None else budget).cast("bigint")
    capped = (
        sizes.withColumn("_cap", F.col("source_size") * F.lit(max_epochs).cast("bigint"))
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("_left", total - F.coalesce(F.sum("_cap").over(above), F.lit(0)))
        .withColumn("_level", F.col("_left").cast("double") / F.sum("weight").over(here_on).cast("double"))
    )
    # the level that holds is that of the first source it does not lift above its cap
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)
    target = F.least(F.col("_cap").cast("double"), F.col("_hold._level") * F.col("weight").cast("double"))
    return capped.withColumn("_hold", first).select(
        "source", "source_size", "weight", F.coalesce(target, F.col("_cap").cast("double")).alias("target")
    )


def source_targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``(source, size)`` rows under the cyclic weights, sources by code point, null last."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()))
    return water_fill(sizes.withColumn("weight", cyclic_weight(rank).cast("bigint")), max_epochs=max_epochs)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies (0 to ``max_epochs``), taken."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    ).withColumn("_key", shuffle_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed))
    sized = cut_lineage(sized, "mix-sizes")
    targets = cut_lineage(source_targets(sized, max_epochs), "mix-targets")
    scanned = segmented_scan(sized, ["source"], ["_key", "doc_id", "size"], {"_before": ("sum", "size", False)})
    both = join_null_safe(scanned, targets.drop("weight"), ["source"])
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = F.when(F.lit(2) * F.col("_before") + F.col("size") < F.lit(2.0) * rest, 1).otherwise(0)
    return (
        both.withColumn("_whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("copies", (F.col("_whole") + extra).cast("int"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
        )
    )


def repeat_documents(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as ``mix`` says (0 to ``max_epochs`` times).

    Rows that share a doc_id, a source and a size are one document here: each of them appears as often as
    the rounded mean of their copies, so ids need not be unique. Other columns pass through under any name.
    """
    chosen = mix(docs, seed=seed, max_epochs=max_epochs).groupBy("doc_id", "size", "source").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    rows = docs.select(as_row(docs), "doc_id", "source", word_count(F.col("text")).alias("size"))
    joined = join_null_safe(rows, chosen, ["doc_id", "size", "source"])
    times = F.round(F.col("copies") / F.col("rows")).cast("int")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).where(F.col("copy") > 0).select("row.*")
