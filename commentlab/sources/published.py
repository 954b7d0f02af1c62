"""Versioned result folders with a published pointer.

A result is written to a folder of its own and then named by one row of the pointer table beside it. Nothing is ever
overwritten: a reader follows the last pointer to a folder that is complete, and a writer that is lost between the two steps
leaves the previous version in place. Writing a version again (a replayed batch) adds a folder and a pointer of the
same key and place, and either of the two may be read.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_POINTERS = "key string, place bigint, folder string, columns string"


def pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """``(key, place, folder, columns)`` of the published versions; None before the first one."""
    try:
        return spark.read.schema(_POINTERS).parquet(os.path.join(root, "published"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` to a new folder, not yet published; the folder's name."""
    folder = uuid.uuid4().hex
    df.write.parquet(os.path.join(root, "data", folder))
    return folder


def publish(df: DataFrame, root: str, folder: str, key: str, place: int = 0) -> None:
    """Name a written folder as the version ``place`` of ``key``."""
    spark = df.sparkSession
    row = spark.createDataFrame([(key, place, folder, df.schema.json())], _POINTERS)
    row.coalesce(1).write.mode("append").parquet(os.path.join(root, "published"))


def read_version(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The last published version of ``key``; None if there is none."""
    found = pointers(spark, root)
    last = found and found.where(F.col("key") == key).agg(F.max(F.struct("place", "folder", "columns")).alias("v")).first()["v"]
    return spark.read.schema(StructType.fromJson(json.loads(last["columns"]))).parquet(os.path.join(root, "data", last["folder"])) if last else None


def input_fingerprint(spark: SparkSession, *paths: str) -> str:
    """A value that changes when a file below ``paths`` is added, removed, replaced or touched: the files' paths, sizes and
    modification times, from the listing alone (no file is opened)."""
    files = None
    for path in paths:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
        files = listed if files is None else files.unionByName(listed)
    one = F.xxhash64("path", "length", "modificationTime")
    n, size, mixed = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(one), F.lit(0))).first()
    return f"{n}-{size}-{mixed & 0xFFFFFFFFFFFFFFFF:016x}"
