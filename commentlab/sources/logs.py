"""Run logs as a metrics table.

Line kinds (the reference's writers), ``[MMdd_HHmmss]`` being a timestamp prefix without a year:
    config   ``[ts]key value``
    epoch    ``[ts]N EPOCH, accuaracy : x``      (spelling kept as written by the reference)
    batch    ``N EPOCH M batch: train loss x``
anything else is kept with kind ``other``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line formats of the reference's run logs.
TS_FORMAT = "MMdd_HHmmss"
EPOCH_RE = r"^\[(\d{4}_\d{6})\](\d+) EPOCH, accuaracy : (\S+)\z"
BATCH_RE = r"^(\d+) EPOCH (\d+) batch: train loss (\S+)\z"
CONFIG_RE = r"^\[(\d{4}_\d{6})\](\S+) (.*)\z"


def format_ts(ts: Column) -> Column:
    """``%m%d_%H%M%S``."""
    return F.date_format(ts, TS_FORMAT)


def parse_ts(s: Column, year: int) -> Column:
    """The prefix has no year (it would parse as 1970), so the year is a parameter."""
    return F.to_timestamp(F.concat(F.lit(str(year)), s), "yyyy" + TS_FORMAT)


def epoch_line(ts: Column, epoch: Column, value: Column) -> Column:
    return F.concat(F.lit("["), format_ts(ts), F.lit("]"), epoch.cast("string"), F.lit(" EPOCH, accuaracy : "), value.cast("string"))


def batch_line(epoch: Column, step: Column, value: Column) -> Column:
    return F.concat(epoch.cast("string"), F.lit(" EPOCH "), step.cast("string"), F.lit(" batch: train loss "), value.cast("string"))


def config_line(ts: Column, key: Column, value: Column) -> Column:
    return F.concat(F.lit("["), format_ts(ts), F.lit("]"), key, F.lit(" "), value.cast("string"))


def parse_log_lines(lines: DataFrame, year: int, line_col: str = "value") -> DataFrame:
    """``(kind, ts, epoch, batch, key, value, line)`` from raw log lines."""
    v = F.col(line_col)
    is_epoch = v.rlike(EPOCH_RE)
    is_batch = v.rlike(BATCH_RE)
    is_config = v.rlike(CONFIG_RE)
    kind = F.when(is_epoch, "epoch").when(is_batch, "batch").when(is_config, "config").otherwise("other")
    ts = F.when(is_epoch, parse_ts(F.regexp_extract(v, EPOCH_RE, 1), year)).when(
        is_config & ~is_epoch, parse_ts(F.regexp_extract(v, CONFIG_RE, 1), year)
    )
    epoch = F.when(is_epoch, F.regexp_extract(v, EPOCH_RE, 2)).when(is_batch, F.regexp_extract(v, BATCH_RE, 1)).cast("int")
    batch = F.when(is_batch, F.regexp_extract(v, BATCH_RE, 2)).cast("int")
    key = F.when(is_epoch, F.lit("accuracy")).when(is_batch, F.lit("train_loss")).when(is_config, F.regexp_extract(v, CONFIG_RE, 2))
    value = F.when(is_epoch, F.regexp_extract(v, EPOCH_RE, 3)).when(is_batch, F.regexp_extract(v, BATCH_RE, 3)).when(
        is_config, F.regexp_extract(v, CONFIG_RE, 3)
    )
    return lines.select(
        kind.alias("kind"), ts.alias("ts"), epoch.alias("epoch"), batch.alias("batch"), key.alias("key"), value.alias("value"), v.alias("line")
    )


def read_log(spark: SparkSession, path: str, year: int) -> DataFrame:
    return parse_log_lines(spark.read.text(path), year)
