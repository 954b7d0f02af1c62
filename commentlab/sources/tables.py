"""The supplied Parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# tables whose rows carry heavy per-row work (whole texts): spread small scans over all task slots
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None | bool = True) -> DataFrame:
    """Read one supplied table; column pruning and filters reach the Parquet scan through Catalyst.

    ``spread_by``: when the scan yields fewer partitions than the cluster has task slots (a few large row
    groups), hash-partition by that key so the row-wise work uses every slot and later group-bys on the
    key need no further shuffle. The partition count comes from the plan (no job runs); a large input
    already has enough splits and is left untouched.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if spread_by is True:
        spread_by = SPREAD_KEYS.get(name)
    if spread_by:
        slots = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < slots:
            df = df.repartition(slots, spread_by)
    return df
