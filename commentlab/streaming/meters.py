"""Structured Streaming versions of the cleaning step and of the meters (ST1–ST3).

Sources are file streams over a folder of Parquet files, or over one table, be it a file or a folder. Sink and checkpoint
folder belong to the caller: a run with the folders of an earlier run goes on where that one stopped, reads the files
that have come since, and every row counts once. Aggregating meters keep one state row per key (series x epoch, or
target x prediction): the state is bounded by the key domain, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from commentlab.functions import math as X
from commentlab.functions import text as T
from commentlab.sources.published import publish, read_version, write_version

METER = "meter"


def folder_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A file stream of the Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A file stream of one supplied table (schema from the Parquet footer, not inferred from rows)."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a stream does not start from the plain path of one file, and a name filter on the folder misses the files of a table
    # that is a folder itself: a pattern of this one name finds both
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def run_append(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Run a stateless stream over what has arrived (``availableNow``) into the Parquet folder ``sink``; return its rows
    (none before the first batch).

    The file sink's own log names the files of finished batches, so that a batch that is run again counts once."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    try:
        return spark.read.schema(stream.schema).parquet(sink)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], stream.schema)
        raise


def run_complete(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame | None:
    """Run an aggregating stream over what has arrived; return the whole result table (None before the first batch).

    Every batch writes the result to a folder of its own and publishes it when it is complete (``sources.published``):
    a run that is lost in between leaves the version before it, and its batch is run again by the next run."""

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch, sink, write_version(batch, sink), METER, batch_id)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_version(stream.sparkSession, sink, METER)


def clean_stream(docs: DataFrame) -> DataFrame:
    """ST1: T1 and T5 applied to each arriving comment (stateless)."""
    return docs.select(
        F.col("doc_id").alias("id"),
        T.normalise_comment("text", null_as="nan").alias("text"),
        F.array_join(T.clean_tokens("text"), " ").alias("tokens"),
    )


def mean_meter(events: DataFrame) -> DataFrame:
    """ST2: count, sum and mean per (series, epoch) — the average meter, "reset" = epoch in the key."""
    m = events.select(
        F.col("event_type").alias("series"), (F.dayofmonth("ts") - 1).cast("bigint").alias("epoch"), (F.col("value") / 100).alias("value")
    )
    return m.groupBy("series", "epoch").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


def confusion_meter(class_scores: DataFrame, n_classes: int) -> DataFrame:
    """ST3: counts per (target, prediction) of a stream of class scores (first ``n_classes`` entries)."""
    scores = F.slice("embedding", 1, n_classes).cast("array<double>")
    pairs = class_scores.select(F.col("label").alias("target"), X.argmax(scores).alias("pred"))
    return pairs.groupBy("target", "pred").agg(F.count(F.lit(1)).alias("n"))
