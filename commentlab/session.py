"""Session helpers: building a local session for tests and finding the shared scratch folder.

On a cluster the shared folder is whatever the deployment names in ``spark.checkpoint.dir``; the library
only reads that setting. A private folder is created only when the setting is absent (local runs, tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "commentlab") -> SparkSession:
    """A ``local[cores]`` session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the session names one. A local master (tests) without the setting
    gets a private folder, recorded in the session, so every later call (and ``DataFrame.checkpoint``) uses
    the same place; on a cluster, where a private folder would not be shared, the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or _PRIVATE_DIRS.get(spark.sparkContext.applicationId)
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="commentlab-")
        _PRIVATE_DIRS[spark.sparkContext.applicationId] = path
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 — some deployments refuse runtime core settings; the cache above suffices
            pass
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(path, "rdd"))
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for one written artefact."""
    return os.path.join(shared_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and return the table read back.

    Used where a later step depends on a value that must not change if a task is recomputed (for
    example a partition number), and to keep long plans short. A written table (rather than
    ``DataFrame.checkpoint``) computes its input once and gives the planner file sizes, so small
    results are broadcast by the usual size rules.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
