"""Evaluation on score and label tables.

Inputs are long tables — ``(id, label, logit, target)`` for multi-label scores and
``(id, scores, target)`` for class scores — so every metric is a group-by (partial aggregation on the
map side, one row per label afterwards) or a distributed scan; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.functions.math import argmax, logsumexp, sigmoid, soft_margin_term
from commentlab.operators.order import segmented_scan


def label_matrix(df: DataFrame, labels: Sequence[str], id_col: str = "id") -> DataFrame:
    """Long form (id, label, target) of the label columns; ``sequence.sparse_vectors`` turns it into ML vectors."""
    return df.unpivot([id_col], list(labels), "label", "target")


def threshold(logit: Column | str, t: float = 0.5, scale: str = "prob") -> Column:
    """Positive iff score > t. ``scale='logit'`` compares the raw logit (reference parity);
    ``scale='prob'`` compares the sigmoid."""
    x = F.col(logit) if isinstance(logit, str) else logit
    v = x if scale == "logit" else sigmoid(x)
    return (v > F.lit(t)).cast("int")


def with_predictions(scores: DataFrame, t: float = 0.5, scale: str = "logit") -> DataFrame:
    """B5 + B6: add ``pred`` and ``match`` to a long score table."""
    return scores.withColumn("pred", threshold("logit", t, scale)).withColumn(
        "match", (F.col("pred") == F.col("target")).cast("int")
    )


def label_counts(long: DataFrame) -> DataFrame:
    """Positives and rows per label."""
    return long.groupBy("label").agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("positives"), F.count(F.lit(1)).alias("total")
    )


def label_balance(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Share of positives per label, plus the share of rows with no positive label ('clean')."""
    clean = F.lit(True)
    for c in labels:
        clean = clean & (F.col(c) == 0)
    aggs = [F.avg((F.col(c) == 1).cast("double")).alias(c) for c in labels] + [F.avg(clean.cast("double")).alias("clean")]
    wide = df.agg(*aggs)
    return wide.unpivot([], [*labels, "clean"], "label", "share")


def describe(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std (n-1), min, exact quartiles (linear interpolation), max — per ``by`` group.

    The exact percentile keeps a value -> count map per group, so its state is bounded by the number of
    distinct values (token counts here), not by the rows."""
    q = F.percentile(F.col(col), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"),
        q.alias("_q"),
        F.max(col).cast("double").alias("max"),
    ]
    out = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    quart = [F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75")]
    return out.select(*by, "count", "mean", "std", "min", *quart, "max")


def quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Exact quantile, NumPy's linear rule."""
    return df.agg(F.percentile(F.col(col), F.lit(q)).alias("quantile"))


def table_shape(df: DataFrame) -> DataFrame:
    """E5: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def label_accuracy(pred: DataFrame) -> DataFrame:
    """Per-label accuracy over all rows."""
    return pred.groupBy("label").agg(F.avg("match").alias("accuracy"))


def label_accuracy_batched(pred: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per-label mean of per-batch accuracies (a short last batch counts as much as a full one)."""
    per_batch = pred.groupBy("label", batch_col).agg(F.avg("match").alias("acc"))
    return per_batch.groupBy("label").agg(F.avg("acc").alias("accuracy"))


def macro(per_label: DataFrame, col: str = "accuracy") -> DataFrame:
    """Unweighted mean over labels."""
    return per_label.agg(F.avg(col).alias(f"macro_{col}"))


def label_auc(scores: DataFrame, score_col: str = "logit") -> DataFrame:
    """Per-label ROC AUC with tied scores counted half (rank-sum form).

    Rows are first reduced to one row per (label, score) — the combine happens map-side — then the
    negatives below each score are summed by a distributed scan, so no label is sorted in one task.
    """
    grouped = scores.groupBy("label", F.col(score_col).alias("score")).agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("pos"), F.sum((F.col("target") != 1).cast("bigint")).alias("neg")
    )
    scanned = segmented_scan(grouped, ["label"], ["score"], {"neg_below": ("sum", "neg", False)})
    return scanned.groupBy("label").agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auc")
    )


def confusion_matrix(pairs: DataFrame, k: int, target_col: str = "target", pred_col: str = "pred") -> DataFrame:
    """K x k counts (row = target, column = prediction), zero cells kept."""
    counts = pairs.groupBy(target_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    return fill_confusion(counts, k, target_col, pred_col)


def fill_confusion(counts: DataFrame, k: int, target_col: str = "target", pred_col: str = "pred") -> DataFrame:
    """Counted cells (target, pred, n) completed to the k x k grid. The grid comes from ``range``
    (no cross join). A cell outside 0..k-1, or with a null, is an error: the grid has a fixed size and
    leaving the cell out would change the total."""
    spark = counts.sparkSession

    def inside(c: str) -> Column:
        return F.coalesce((F.col(c) >= 0) & (F.col(c) < k), F.lit(False))

    valid = inside(target_col) & inside(pred_col)
    wrong = F.raise_error(F.concat_ws(" ", F.lit(f"confusion cell outside 0..{k - 1}:"), F.col(target_col).cast("string"), F.col(pred_col).cast("string")))
    counts = counts.select(
        F.when(valid, F.col(target_col)).otherwise(wrong).cast("int").alias(target_col),
        F.when(valid, F.col(pred_col)).otherwise(wrong).cast("int").alias(pred_col),
        "n",
    )
    grid = spark.range(k * k).select((F.col("id") / k).cast("int").alias(target_col), (F.col("id") % k).cast("int").alias(pred_col))
    return grid.join(F.broadcast(counts), [target_col, pred_col], "left").select(
        target_col, pred_col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_wide(cm: DataFrame, k: int, target_col: str = "target", pred_col: str = "pred") -> DataFrame:
    """E14 wide form: one row per target, one column ``p<j>`` per prediction. The pivot values are given
    (0..k-1), so Spark needs no extra pass to find them."""
    wide = cm.groupBy(target_col).pivot(pred_col, list(range(k))).agg(F.sum("n"))
    return wide.select(target_col, *[F.coalesce(F.col(str(j)), F.lit(0)).cast("bigint").alias(f"p{j}") for j in range(k)])


def confusion_accuracy(cm: DataFrame, target_col: str = "target", pred_col: str = "pred") -> DataFrame:
    """100 * trace / total."""
    return cm.agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col(target_col) == F.col(pred_col), F.col("n")).otherwise(0)).alias("correct"),
    ).withColumn("accuracy_pct", F.lit(100.0) * F.col("correct") / F.col("total"))


def class_predictions(class_scores: DataFrame) -> DataFrame:
    """M5 on a class-score table: (id, target, pred)."""
    return class_scores.select("id", "target", argmax("scores").alias("pred"))


def soft_margin_loss(scores: DataFrame) -> DataFrame:
    """Mean over rows and labels of the logistic loss (every row has every label)."""
    return scores.agg(F.avg(soft_margin_term("logit", "target")).alias("loss"))


def cross_entropy(class_scores: DataFrame) -> DataFrame:
    """Mean of logsumexp(scores) - scores[target]."""
    term = logsumexp("scores") - F.element_at("scores", F.col("target") + 1)
    return class_scores.agg(F.avg(term).alias("loss"))


def loss_batched(scores: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Mean of per-batch mean losses."""
    per = scores.groupBy(batch_col).agg(F.avg(soft_margin_term("logit", "target")).alias("l"))
    return per.agg(F.avg("l").alias("loss"))


def exact_match(pred: DataFrame) -> DataFrame:
    """Share of rows whose every label is predicted right."""
    per = pred.groupBy("id").agg(F.bool_and(F.col("match") == 1).alias("ok"))
    return per.agg(F.avg(F.col("ok").cast("double")).alias("exact_match"))


def mask_consistency(df: DataFrame, a: str, b: str, unscored: int = -1) -> DataFrame:
    """Rows where two label columns disagree on being scored, and the number checked."""
    bad = (F.col(a) != unscored) != (F.col(b) != unscored)
    return df.agg(F.count(F.lit(1)).alias("checked"), F.sum(bad.cast("bigint")).alias("violations"))


def mask_violations(df: DataFrame, a: str, b: str, unscored: int = -1) -> DataFrame:
    """The rows themselves."""
    return df.where((F.col(a) != unscored) != (F.col(b) != unscored))
