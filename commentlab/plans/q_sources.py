"""Queries: file sources and sinks (A1–A11). Each writes a view of the tables to the shared folder in the
reference's file format, reads it back with the matching reader, and returns what was read; the oracle
queries the view itself."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlab.functions import math as X
from commentlab.functions import text as Tx
from commentlab.operators import metrics as M
from commentlab.operators import order as O
from commentlab.operators import vocab as V
from commentlab.plans import fixtures as fx
from commentlab.plans.fixtures import with_views
from commentlab.plans.q_order import SEED, SHUFFLE_SQL, VAL_FRACTION
from commentlab.plans.q_text import sql_clean_tokens, sql_normalise
from commentlab.plans.q_vocab import Corpus, vsql
from commentlab.plans.registry import r6, register
from commentlab.session import scratch_path, shared_dir
from commentlab.sources import files as io
from commentlab.sources import logs as L
from commentlab.sources import positions as P
from commentlab.sources.tables import table, table_path

LOG_YEAR = 2024


@register("csv_roundtrip", with_views("SELECT id, comment_text, toxic, quality FROM comments", "comments"))
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A5 then A1: headed CSV with quoted newlines, commas and doubled quotes, read back unchanged."""
    path = scratch_path(spark, "comments_csv")
    io.write_csv(fx.comments(spark, sf), path)
    return io.read_csv(spark, path, io.COMMENT_SCHEMA)


@register(
    "tsv_fill",
    with_views(
        "SELECT comment_text AS text, CASE WHEN toxic = -1 THEN '0' ELSE CAST(toxic AS VARCHAR) END AS label FROM comments", "comments"
    ),
)
def tsv_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A2 + B3: header-less (text, label) TSV; missing labels come back as '0'."""
    c = fx.comments(spark, sf)
    out = c.select(F.col("comment_text").alias("text"), F.when(F.col("toxic") != -1, F.col("toxic").cast("string")).alias("label"))
    path = scratch_path(spark, "corpus_tsv")
    io.write_tsv(out, path)
    return io.read_tsv_filled(spark, path)


@register(
    "typed_load",
    with_views(
        "SELECT CASE WHEN rk <= floor(0.2 * n) THEN 'val' ELSE 'train' END AS split, comment_text, CAST(toxic AS TINYINT) AS toxic, "
        f"CAST(quality AS TINYINT) AS quality FROM (SELECT *, row_number() OVER (ORDER BY {SHUFFLE_SQL}) AS rk, count(*) OVER () AS n "
        "FROM scored_comments) UNION ALL SELECT 'test', comment_text, CAST(toxic AS TINYINT), CAST(quality AS TINYINT) FROM comments WHERE toxic = -1",
        "comments",
        "scored_comments",
    ),
)
def typed_load(spark: SparkSession, sf: str) -> DataFrame:
    """A3: train / val / test written as three CSV folders, read with byte labels, id dropped."""
    c = fx.comments(spark, sf)
    labelled = c.where(F.col("toxic") != -1)
    # only the ids are ranked; the texts are joined back
    split = labelled.join(O.shuffled_split(labelled.select("id"), "id", SEED, VAL_FRACTION), "id")
    paths = {}
    for name in ("train", "val"):
        paths[name] = scratch_path(spark, f"split_{name}")
        io.write_csv(split.where(F.col("split") == name).drop("split"), paths[name])
    paths["test"] = scratch_path(spark, "split_test")
    io.write_csv(c.where(F.col("toxic") == -1), paths["test"])
    return io.read_splits(spark, paths, list(fx.LABELS)).select("split", "comment_text", "toxic", "quality")


@register(
    "read_vectors",
    vsql("SELECT token, CAST(len(vec) AS BIGINT) AS dim, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS vec_sum, "
        "round(list_sum(list_transform(CAST(vec AS DOUBLE[]), lambda v, i: v * i)), 6) AS vec_places FROM word_vectors", "word_vectors"),
)
def read_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A4: word-vector text with a ``count dim`` header line, parsed back."""
    path = scratch_path(spark, "vectors_txt")
    io.write_vectors_text(Corpus(spark, sf).vectors, path, fx.DIM)
    back = io.read_vectors_text(spark, path)
    return back.select("token", F.col("dim").cast("bigint").alias("dim"), r6(X.array_sum("vec")).alias("vec_sum"), r6(X.place_sum("vec")).alias("vec_places"))


@register(
    "tsv_tokens",
    with_views(f"SELECT id, array_to_string({sql_clean_tokens('comment_text')}, ' ') AS tokens FROM comments", "comments"),
)
def tsv_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned token lists (T5) as a TSV of (id, space-joined tokens)."""
    c = fx.comments(spark, sf).select("id", F.array_join(Tx.clean_tokens("comment_text"), " ").alias("tokens"))
    path = scratch_path(spark, "tokens_tsv")
    io.write_tsv(c, path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("tokens", T.StringType())])
    return io.read_csv(spark, path, schema, header=False, sep="\t", multi_line=False).na.fill("", ["tokens"])


@register("vocab_dump", vsql("SELECT token, id FROM vocab", "vocab"))
def vocab_dump(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + S6: dictionary dump ``token\\tid`` sorted by token."""
    path = scratch_path(spark, "vocab_tsv")
    io.write_tsv(Corpus(spark, sf).vocab.select("token", "id").orderBy("token"), path)
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("id", T.LongType())])
    return io.read_csv(spark, path, schema, header=False, sep="\t", multi_line=False)


@register("oov_sink", vsql("SELECT token FROM vocab WHERE token NOT IN (SELECT token FROM word_vectors)", "vocab", "word_vectors"))
def oov_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-vocabulary tokens, one per line."""
    c = Corpus(spark, sf)
    path = scratch_path(spark, "oov_txt")
    io.write_token_lines(V.oov_tokens(c.vocab, c.vectors), path)
    return io.read_token_lines(spark, path)


@register(
    "predictions_sink",
    with_views("SELECT id, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS label FROM class_scores", "class_scores"),
)
def predictions_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions ``id,label`` with a header."""
    preds = M.class_predictions(fx.class_scores(spark, sf)).select("id", F.col("pred").alias("label"))
    path = scratch_path(spark, "predictions_csv")
    io.write_csv(preds, path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType())])
    return io.read_csv(spark, path, schema, multi_line=False)


@register("materialised", with_views(f"SELECT id, {sql_normalise('comment_text')} AS comment_text FROM comments", "comments"))
def materialised(spark: SparkSession, sf: str) -> DataFrame:
    """A10: prepare the normalised comments once for each state of the input files, reuse them on later calls."""
    inputs = [table_path(sf, t) for t in ("documents", "labels")]
    root = os.path.join(shared_dir(spark), "prepared", "normalised-" + hashlib.md5(sf.encode()).hexdigest()[:12])
    return io.materialise(
        spark, root, inputs, lambda: fx.comments(spark, sf).select("id", Tx.normalise_comment("comment_text", null_as="nan").alias("comment_text"))
    )


# ---- D1 / D7 in file order


@register(
    "file_order_alignment",
    "SELECT CAST(count(*) AS BIGINT) AS positions, CAST(count(*) FILTER (WHERE a.doc_id = b.doc_id) AS BIGINT) AS same, "
    "CAST(count(*) FILTER (WHERE a.doc_id <> b.doc_id) AS BIGINT) AS different, "
    "CAST(count(*) FILTER (WHERE b.doc_id IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (WHERE a.doc_id IS NULL) AS BIGINT) AS right_only "
    "FROM (SELECT doc_id, row_number() OVER () AS p FROM documents) a FULL OUTER JOIN (SELECT doc_id, row_number() OVER () AS p FROM labels) b ON a.p = b.p",
)
def file_order_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Do the files of documents and labels name the same ids row by row?"""
    a, b = (P.parquet_positions(spark, table_path(sf, t), columns=["doc_id"]) for t in ("documents", "labels"))
    return P.alignment(a, b, "doc_id", "doc_id")


_BY_POSITION = (
    "a AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id DESC) - 1 AS position FROM documents), "
    f"b AS (SELECT id AS label_id, toxic, row_number() OVER (ORDER BY {SHUFFLE_SQL}) - 1 AS position FROM scored_comments) "
)


def _two_folders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A CSV folder of documents, in falling order of the ids, and a Parquet folder of label rows in shuffled order."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("doc_id"))
    path, other = scratch_path(spark, "documents_csv"), scratch_path(spark, "label_rows")
    io.write_csv(docs, path)
    fx.scored_comments(spark, sf).select(F.col("id").alias("label_id"), "toxic").orderBy(O.shuffle_key("label_id", SEED), "label_id").write.parquet(other)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())])
    return P.text_positions(spark, path, schema, header=True), P.parquet_positions(spark, other)


@register(
    "attach_by_position",
    with_views(f"WITH {_BY_POSITION} SELECT CAST(position AS BIGINT) AS position, doc_id, CAST(n_chars AS BIGINT) AS n_chars, label_id, toxic FROM a JOIN b USING (position)", "scored_comments"),
)
def attach_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """D1 by row position: label rows beside the documents at the same place of another folder, whatever their ids."""
    return P.attach_by_position(*_two_folders(spark, sf))


@register(
    "shuffled_alignment",
    with_views(
        f"WITH {_BY_POSITION} SELECT CAST(count(*) AS BIGINT) AS positions, CAST(count(*) FILTER (WHERE doc_id = label_id) AS BIGINT) AS same, "
        "CAST(count(*) FILTER (WHERE doc_id <> label_id) AS BIGINT) AS different, CAST(count(*) FILTER (WHERE label_id IS NULL) AS BIGINT) AS left_only, "
        "CAST(count(*) FILTER (WHERE doc_id IS NULL) AS BIGINT) AS right_only FROM a FULL OUTER JOIN b USING (position)",
        "scored_comments",
    ),
)
def shuffled_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """D7 on two folders that hold ids in different orders."""
    return P.alignment(*_two_folders(spark, sf), "doc_id", "label_id")


_FIXED6 = "round(round(sum(value) * 10000) * 100 / count(value)) / 1000000"
_LOG_SQL = (
    "SELECT 'config' AS kind, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS ts, CAST(-1 AS INTEGER) AS epoch, "
    "CAST(-1 AS INTEGER) AS batch, 'series' AS key, CAST(NULL AS DOUBLE) AS num, series AS text FROM metrics GROUP BY series "
    "UNION ALL SELECT 'epoch', strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S'), CAST(epoch AS INTEGER), CAST(-1 AS INTEGER), 'accuracy', "
    f"{_FIXED6}, NULL FROM metrics GROUP BY series, epoch "
    "UNION ALL SELECT 'batch', NULL, CAST(epoch AS INTEGER), CAST(step AS INTEGER), 'train_loss', round(value, 6), NULL FROM metrics"
)


@register("log_ingest", with_views(_LOG_SQL, "metrics"))
def log_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A11 + T10: write the metric series as run-log lines (config, epoch accuracy, batch loss), read the
    text back and parse it into a metrics table (-1 = the line kind has no epoch / batch number)."""
    m = fx.metrics(spark, sf)
    config = m.groupBy("series").agg(F.min("ts").alias("ts")).select(L.config_line(F.col("ts"), F.lit("series"), F.col("series")).alias("value"))
    epoch_mean = F.round(F.round(F.sum("value") * 10000) * 100 / F.count("value"), 0) / 1000000
    epochs = m.groupBy("series", "epoch").agg(F.max("ts").alias("ts"), epoch_mean.alias("v"))
    epoch_lines = epochs.select(L.epoch_line(F.col("ts"), F.col("epoch"), F.col("v")).alias("value"))
    batch_lines = m.select(L.batch_line(F.col("epoch"), F.col("step"), F.col("value")).alias("value"))
    path = scratch_path(spark, "run_log")
    config.unionByName(epoch_lines).unionByName(batch_lines).write.mode("overwrite").text(path)
    parsed = L.read_log(spark, path, LOG_YEAR)
    numeric = F.col("kind").isin("epoch", "batch")
    return parsed.select(
        "kind",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.coalesce("epoch", F.lit(-1)).alias("epoch"),
        F.coalesce("batch", F.lit(-1)).alias("batch"),
        "key",
        F.when(numeric, r6(F.col("value").cast("double"))).alias("num"),
        F.when(F.col("kind") == "config", F.col("value")).alias("text"),
    )
