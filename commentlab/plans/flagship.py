"""Flagship query: documents ⟕ labels → scored only → normalise → token count → describe + positives.

"How long are the scored comments, and how many positives does each label have?" One row per label:
positives and rows (E1) next to the length statistics of the scored comments (E3, E4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions import text as T
from commentlab.plans import fixtures as fx
from commentlab.plans.fixtures import with_views
from commentlab.plans.q_text import sql_normalise, sql_ws_tokens
from commentlab.plans.registry import r6, register

_SQL = with_views(
    "WITH lens AS (SELECT id, toxic, quality, "
    f"len({sql_ws_tokens(sql_normalise('comment_text'))}) AS n FROM scored_comments), "
    "st AS (SELECT count(n) AS n_docs, avg(n) AS mean, stddev_samp(n) AS std, quantile_cont(n, 0.25) AS q25, "
    "quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, quantile_cont(n, 0.8) AS q80, "
    "CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max FROM lens), "
    "pos AS (SELECT 'toxic' AS label, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives, "
    "CAST(count(*) AS BIGINT) AS total FROM lens UNION ALL "
    "SELECT 'quality', CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT), CAST(count(*) AS BIGINT) FROM lens) "
    "SELECT label, positives, total, CAST(n_docs AS BIGINT) AS n_docs, round(mean, 6) AS mean, round(std, 6) AS std, "
    "round(min, 6) AS min, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(q80, 6) AS q80, "
    "round(max, 6) AS max FROM pos, st",
    "scored_comments",
)


@register("scored_length_report", _SQL)
def scored_length_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = fx.scored_comments(spark, sf)
    lens = scored.select("id", *fx.LABELS, T.token_count(T.normalise_comment("comment_text", null_as="nan")).alias("n"))
    # long form (id, n, label, target): every statistic becomes a per-label aggregate, no join needed
    long = lens.unpivot(["id", "n"], list(fx.LABELS), "label", "target")
    out = long.groupBy("label").agg(
        F.sum((F.col("target") == 1).cast("bigint")).alias("positives"),
        F.count(F.lit(1)).alias("total"),
        F.count("n").alias("n_docs"),
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("std"),
        F.min("n").cast("double").alias("min"),
        F.percentile("n", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.8)])).alias("_q"),
        F.max("n").cast("double").alias("max"),
    )
    quant = {"q25": 0, "q50": 1, "q75": 2, "q80": 3}
    return out.select(
        "label",
        "positives",
        "total",
        "n_docs",
        r6("mean").alias("mean"),
        r6("std").alias("std"),
        r6("min").alias("min"),
        *[r6(F.col("_q")[i]).alias(k) for k, i in quant.items()],
        r6("max").alias("max"),
    )
