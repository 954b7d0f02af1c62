"""Queries: order, limits, splits, batches, sampling, union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.operators import order as O
from commentlab.plans import fixtures as fx
from commentlab.plans.fixtures import with_views
from commentlab.plans.registry import r6, register

SEED = 666
VAL_FRACTION = 0.2
BATCH = 64
PREFIX_ROWS = 300  # the reference's debug prefix
SHUFFLE_SQL = f"md5('{SEED}:' || CAST(id AS VARCHAR)), id"


def _split_sql(source: str, order: str) -> str:
    return (
        f"SELECT id, CASE WHEN rk <= floor({VAL_FRACTION} * n) THEN 'val' ELSE 'train' END AS split FROM "
        f"(SELECT id, row_number() OVER (ORDER BY {order}) AS rk, count(*) OVER () AS n FROM {source})"
    )


@register(
    "head_tail",
    with_views(
        "(SELECT id, 'head' AS part FROM comments ORDER BY id LIMIT 5) UNION ALL "
        "(SELECT id, 'tail' AS part FROM comments ORDER BY id DESC LIMIT 5)",
        "comments",
    ),
)
def head_tail(spark: SparkSession, sf: str) -> DataFrame:
    """First and last rows by position (the id order)."""
    c = fx.comments(spark, sf).select("id")
    head = O.head_rows(c, ["id"], 5).withColumn("part", F.lit("head"))
    tail = O.tail_rows(c, ["id"], 5).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


@register("prefix_rows", with_views(f"SELECT id, toxic FROM comments ORDER BY id LIMIT {PREFIX_ROWS}", "comments"))
def prefix_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Work on a prefix (the reference's debug mode / first-n feature rows); the limit is the feature."""
    return O.head_rows(fx.comments(spark, sf).select("id", "toxic"), ["id"], PREFIX_ROWS)


@register("split_ordered", with_views(_split_sql("comments", "id"), "comments"))
def split_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """S3: first 20 % in id order -> val (what the reference's preprocessing actually does)."""
    return O.ordered_split(fx.comments(spark, sf).select("id"), ["id"], VAL_FRACTION)


@register("split_shuffled", with_views(_split_sql("scored_comments", SHUFFLE_SQL), "scored_comments"))
def split_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded shuffled split with exact sizes."""
    return O.shuffled_split(fx.scored_comments(spark, sf).select("id"), "id", SEED, VAL_FRACTION)


TEST_FRACTION = 0.2
THREE_WAY_SQL = (
    f"SELECT id, CASE WHEN rk <= floor({VAL_FRACTION} * n) THEN 'val' WHEN rk <= floor({VAL_FRACTION} * n) + floor({TEST_FRACTION} * n) "
    "THEN 'test' ELSE 'train' END AS split FROM "
    f"(SELECT id, row_number() OVER (ORDER BY {SHUFFLE_SQL}) AS rk, count(*) OVER () AS n FROM scored_comments)"
)


@register("split_three_way", with_views(THREE_WAY_SQL, "scored_comments"))
def split_three_way(spark: SparkSession, sf: str) -> DataFrame:
    """S4 with a test part: models are chosen on val and reported on test."""
    return O.three_way_split(fx.scored_comments(spark, sf).select("id"), "id", SEED, VAL_FRACTION, TEST_FRACTION)


@register(
    "shuffled_order",
    with_views(f"SELECT id, row_number() OVER (ORDER BY {SHUFFLE_SQL}) AS ord FROM comments", "comments"),
)
def shuffled_order(spark: SparkSession, sf: str) -> DataFrame:
    """S5."""
    return O.shuffled_order(fx.comments(spark, sf).select("id"), "id", SEED)


@register(
    "batches",
    with_views(
        f"SELECT id, CAST(floor((row_number() OVER (ORDER BY {SHUFFLE_SQL}) - 1) / {BATCH}) AS BIGINT) AS batch_id "
        "FROM scored_comments",
        "scored_comments",
    ),
)
def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffled batches of 64, short last batch kept."""
    sc = fx.scored_comments(spark, sf).select("id")
    return O.batches(sc, [O.shuffle_key("id", SEED), F.col("id")], BATCH)


@register(
    "batches_overlap_tail",
    with_views(
        f"WITH r AS (SELECT id, row_number() OVER (ORDER BY {SHUFFLE_SQL}) AS rk, count(*) OVER () AS n FROM scored_comments) "
        f"SELECT id, CAST(floor((rk - 1) / {BATCH}) AS BIGINT) AS batch_id FROM r WHERE rk <= floor(n / {BATCH}) * {BATCH} "
        f"UNION ALL SELECT id, CAST(floor(n / {BATCH}) AS BIGINT) AS batch_id FROM r WHERE rk > n - {BATCH}",
        "scored_comments",
    ),
)
def batches_overlap_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Full batches, then one more batch of the last 64 rows."""
    sc = fx.scored_comments(spark, sf).select("id")
    return O.batches_overlap_tail(sc, [O.shuffle_key("id", SEED), F.col("id")], BATCH)


@register(
    "sample_every_n",
    with_views("SELECT series, epoch, step, round(value, 6) AS value FROM metrics WHERE step % 50 = 0", "metrics"),
)
def sample_every_n(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th step of each (series, epoch)."""
    m = fx.metrics(spark, sf)
    return O.sample_every_n(m, "step", 50, 0).select("series", "epoch", "step", r6("value").alias("value"))


@register(
    "union_splits",
    with_views(
        _split_sql("scored_comments", SHUFFLE_SQL) + " UNION ALL SELECT id, 'test' AS split FROM comments WHERE toxic = -1",
        "scored_comments",
    ),
)
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Train / val (shuffled split of the scored rows) and test (unscored rows) back into one table."""
    c = fx.comments(spark, sf)
    labelled = O.shuffled_split(c.where(F.col("toxic") != -1).select("id"), "id", SEED, VAL_FRACTION)
    test = c.where(F.col("toxic") == -1).select("id", F.lit("test").alias("split"))
    return labelled.unionByName(test)
