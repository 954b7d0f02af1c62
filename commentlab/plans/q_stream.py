"""Queries: streaming cleaning and meters (ST1–ST3); each equals its batch counterpart, in one run or resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.operators import metrics as M
from commentlab.plans import fixtures as fx
from commentlab.plans.q_metrics import _CM_SQL
from commentlab.plans.q_text import sql_clean_tokens, sql_normalise
from commentlab.plans.registry import r6, register
from commentlab.session import scratch_path
from commentlab.sources.tables import table
from commentlab.streaming import meters as St


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """Sink and checkpoint of a new run."""
    return scratch_path(spark, f"{name}_out"), scratch_path(spark, f"{name}_ckpt")


_CLEAN_SQL = f"SELECT doc_id AS id, {sql_normalise('text')} AS text, array_to_string({sql_clean_tokens('text')}, ' ') AS tokens FROM documents"
_METER_SQL = (
    "SELECT event_type AS series, CAST(day(ts) - 1 AS BIGINT) AS epoch, count(value) AS n, round(sum(value / 100), 6) AS total, "
    "round(round(sum(value / 100) * 10000) * 100 / count(value)) / 1000000 AS mean FROM events GROUP BY event_type, day(ts)"
)


def _meter_report(table: DataFrame) -> DataFrame:
    mean = F.round(F.round(F.col("total") * 10000) * 100 / F.col("n"), 0) / 1000000
    return table.select("series", "epoch", "n", r6("total").alias("total"), mean.alias("mean"))


@register("stream_clean", _CLEAN_SQL)
def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: a stream of documents cleaned (T1) and tokenised (T5) row by row, appended to a sink."""
    # the supplied table is one file with one row group: spread its rows, whose cleaning is the work
    docs = St.table_stream(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return St.run_append(St.clean_stream(docs), *_folders(spark, "stream_clean"))


@register("stream_mean_meter", _METER_SQL)
def stream_mean_meter(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: the streaming average meter per (series, epoch)."""
    return _meter_report(St.run_complete(St.mean_meter(St.table_stream(spark, sf, "events")), *_folders(spark, "stream_mean_meter")))


def _arrivals(spark: SparkSession, rows: DataFrame, key: str, run) -> DataFrame:
    """``run`` over a folder that rows arrive in twice: one half of them, then the other, by a hash of ``key``."""
    inbox = scratch_path(spark, "arriving")
    out = None
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64(key), F.lit(2)) == half).write.mode("append").parquet(inbox)
        out = run(St.folder_stream(spark, inbox, rows.schema))
    return out


@register("stream_resumed_clean", _CLEAN_SQL)
def stream_resumed_clean(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 in two runs with the same sink and checkpoint; files arrive in between, each row is cleaned once."""
    folders = _folders(spark, "stream_resumed_clean")
    return _arrivals(spark, table(spark, sf, "documents", spread_by=False), "doc_id", lambda s: St.run_append(St.clean_stream(s), *folders))


@register("stream_resumed_meter", _METER_SQL)
def stream_resumed_meter(spark: SparkSession, sf: str) -> DataFrame:
    """ST2 in two runs with the same sink and checkpoint: the second goes on from the first one's counts."""
    folders = _folders(spark, "stream_resumed_meter")
    return _meter_report(_arrivals(spark, table(spark, sf, "events"), "event_id", lambda s: St.run_complete(St.mean_meter(s), *folders)))


@register("stream_confusion", _CM_SQL.replace("FROM class_scores", "FROM (SELECT label AS target, CAST(embedding[1:10] AS DOUBLE[]) AS scores FROM embeddings)") + "SELECT target, pred, n FROM cm")
def stream_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: the streaming confusion meter; zero cells are added from the sink table afterwards."""
    stream = St.confusion_meter(St.table_stream(spark, sf, "embeddings"), fx.N_CLASSES)
    cells = St.run_complete(stream, *_folders(spark, "stream_confusion"))
    return M.fill_confusion(cells, fx.N_CLASSES)
