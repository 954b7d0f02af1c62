"""Metric series (W1–W4): step numbers, running means, running best, learning-rate schedule.

All running values are distributed scans (``segmented_scan``), so one long series does not end up in a
single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commentlab.operators.order import segmented_scan


def series_steps(df: DataFrame, series_col: str = "series", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """0-based step per named series."""
    out = segmented_scan(df, [series_col], list(order), {}, row_number_col="_rn")
    return out.withColumn("step", (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def running_mean(df: DataFrame, keys: tuple[str, ...] = ("series", "epoch"), step_col: str = "step", value_col: str = "value") -> DataFrame:
    """Mean of the values so far within each key (an epoch in the key is the meter's reset)."""
    out = segmented_scan(df, list(keys), [step_col], {"_s": ("sum", value_col, True), "_n": ("count", value_col, True)})
    return out.withColumn("running_mean", F.col("_s") / F.col("_n"))


def epoch_values(df: DataFrame, series_col: str = "series", epoch_col: str = "epoch", value_col: str = "value") -> DataFrame:
    """One value per (series, epoch): the epoch mean."""
    return df.groupBy(series_col, epoch_col).agg(F.avg(value_col).alias("value"))


def running_best(epochs: DataFrame, series_col: str = "series", epoch_col: str = "epoch", value_col: str = "value") -> DataFrame:
    """improved = value > best so far (strict, best starts at 0); is_best marks the earliest epoch
    holding the maximum. Input has one row per (series, epoch) — already aggregated, so a window per
    series holds at most one row per epoch."""
    w = Window.partitionBy(series_col).orderBy(epoch_col)
    prev_best = F.max(value_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    top = F.row_number().over(Window.partitionBy(series_col).orderBy(F.col(value_col).desc(), F.col(epoch_col)))
    return epochs.withColumn("improved", (F.col(value_col) > F.coalesce(prev_best, F.lit(0.0))).cast("int")).withColumn(
        "is_best", (top == 1).cast("int")
    )


def lr_schedule(epochs: DataFrame, lr0: float = 1.0, decay: float = 0.5, series_col: str = "series", epoch_col: str = "epoch", loss_col: str = "value") -> DataFrame:
    """Lr after each epoch = lr0 * decay ** (number of epochs so far whose loss exceeded the previous
    epoch's). One row per (series, epoch) in; a window per series holds one row per epoch."""
    w = Window.partitionBy(series_col).orderBy(epoch_col)
    rose = (F.col(loss_col) > F.lag(loss_col).over(w)).cast("int")
    ups = F.sum(F.coalesce(F.col("_rose"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return epochs.withColumn("_rose", rose).withColumn("lr", F.lit(lr0) * F.pow(F.lit(decay), ups)).drop("_rose")
