"""Queries: text functions and table basics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions import text as T
from commentlab.operators import metrics as M
from commentlab.operators.order import global_rank
from commentlab.plans import fixtures as fx
from commentlab.plans.fixtures import duck_lit, with_views
from commentlab.plans.registry import register
from commentlab.sources.tables import table

TRUNC_CHARS = 100


# ---- DuckDB spellings of the text functions (used by several oracles)


def sql_normalise(x: str, cr_to_bang: bool = True) -> str:
    out = f"coalesce({x}, 'nan')"
    for pattern, repl in T.normalise_steps(cr_to_bang):
        out = f"regexp_replace({out}, {duck_lit(pattern)}, {duck_lit(repl)}, 'g')"
    return out


def sql_clean_tokens(x: str) -> str:
    out = x
    for lit in T.BR_LITERALS:
        out = f"replace({out}, {duck_lit(lit)}, ' ')"
    out = f"lower(regexp_replace({out}, {duck_lit(T.CLEAN_PUNCT)}, ' ', 'g'))"
    return f"regexp_extract_all({out}, {duck_lit(T.NON_WS_RUN)})"


def sql_ws_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {duck_lit(T.NON_WS_RUN)})"


def sql_word_punct(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {duck_lit(T.WORD_OR_MARK)})"


# ---- T1 / T2 / T3 / T4 / T6 / T7


@register("normalise_comment", with_views(f"SELECT id, {sql_normalise('comment_text')} AS text FROM comments", "comments"))
def normalise_comment(spark: SparkSession, sf: str) -> DataFrame:
    return fx.comments(spark, sf).select("id", T.normalise_comment("comment_text", null_as="nan").alias("text"))


@register("normalise_keep_cr", with_views(f"SELECT id, {sql_normalise('comment_text', False)} AS text FROM comments", "comments"))
def normalise_keep_cr(spark: SparkSession, sf: str) -> DataFrame:
    return fx.comments(spark, sf).select("id", T.normalise_comment("comment_text", cr_to_bang=False, null_as="nan").alias("text"))


@register("newline_to_space", "SELECT doc_id AS id, replace(text, chr(10), ' ') AS text FROM documents")
def newline_to_space(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.newline_to_space("text").alias("text"))


@register(
    "rstrip_text",
    "SELECT doc_id AS id, regexp_replace(text, '\\n+\\z', '') AS rstrip_nl, "
    f"regexp_replace(text, {duck_lit('[' + T.WS + ']+\\z')}, '') AS rstrip_ws FROM documents",
)
def rstrip_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), T.rstrip_newlines("text").alias("rstrip_nl"), T.rstrip_space("text").alias("rstrip_ws"))


@register("lower_text", "SELECT doc_id AS id, lower(text) AS text FROM documents")
def lower_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.lower_text("text").alias("text"))


@register(
    "truncate_chars",
    with_views(f"SELECT id, substring({sql_normalise('comment_text')}, 1, {TRUNC_CHARS}) AS text FROM comments", "comments"),
)
def truncate_chars(spark: SparkSession, sf: str) -> DataFrame:
    """The reference cuts the normalised comment to max_seq_len characters before tokenising."""
    c = fx.comments(spark, sf)
    return c.select("id", T.truncate_chars(T.normalise_comment("comment_text", null_as="nan"), TRUNC_CHARS).alias("text"))


# ---- T5 / T8 / T9


@register(
    "clean_tokens",
    with_views(
        f"SELECT id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM "
        f"(SELECT id, {sql_clean_tokens('comment_text')} AS t FROM comments)",
        "comments",
    ),
)
def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.comments(spark, sf).select("id", T.clean_tokens("comment_text").alias("t"))
    return c.select("id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@register(
    "token_count",
    f"SELECT doc_id AS id, CAST(len({sql_ws_tokens('text')}) AS BIGINT) AS n_tokens FROM documents",
)
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), T.token_count("text").cast("bigint").alias("n_tokens"))


@register(
    "tokenise_words_punct",
    with_views(
        f"SELECT id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens FROM "
        f"(SELECT id, {sql_word_punct(sql_normalise('comment_text', False))} AS t FROM comments)",
        "comments",
    ),
)
def tokenise_words_punct(spark: SparkSession, sf: str) -> DataFrame:
    """Normalise (without the CR step), then words and punctuation marks as tokens; whole text."""
    c = fx.comments(spark, sf)
    t = T.word_punct_tokens(T.normalise_comment("comment_text", cr_to_bang=False, null_as="nan"))
    return c.select("id", t.alias("t")).select("id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


# ---- B1 / B2 / B4 / D1 / D7 / E5 / E20


@register("label_columns", with_views("SELECT toxic, quality FROM comments", "comments"))
def label_columns(spark: SparkSession, sf: str) -> DataFrame:
    """B1: the label columns are the columns after id and text."""
    c = fx.comments(spark, sf)
    return c.select(*c.columns[2:])


@register("scored_only", with_views("SELECT id, toxic, quality FROM scored_comments", "scored_comments"))
def scored_only(spark: SparkSession, sf: str) -> DataFrame:
    return fx.scored_comments(spark, sf).select("id", "toxic", "quality")


@register(
    "label_matrix",
    with_views(
        "SELECT id, 'toxic' AS label, toxic AS target FROM scored_comments "
        "UNION ALL SELECT id, 'quality', quality FROM scored_comments",
        "scored_comments",
    ),
)
def label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.label_matrix(fx.scored_comments(spark, sf).select("id", *fx.LABELS), fx.LABELS)


@register("attach_labels", with_views("SELECT id, comment_text, toxic, quality FROM comments", "comments"))
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels joined to comments on the id; no label -> -1."""
    return fx.comments(spark, sf)


@register(
    "id_alignment",
    "SELECT CAST(count(*) AS BIGINT) AS positions, "
    "CAST(count(*) FILTER (WHERE a.doc_id = b.doc_id) AS BIGINT) AS same, "
    "CAST(count(*) FILTER (WHERE a.doc_id <> b.doc_id) AS BIGINT) AS different, "
    "CAST(count(*) FILTER (WHERE b.doc_id IS NULL) AS BIGINT) AS left_only, "
    "CAST(count(*) FILTER (WHERE a.doc_id IS NULL) AS BIGINT) AS right_only FROM "
    "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) a FULL OUTER JOIN "
    "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM labels) b ON a.p = b.p",
)
def id_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Are the ids of two tables equal position by position (both in id order)?"""
    a = global_rank(table(spark, sf, "documents").select(F.col("doc_id").alias("a")), ["a"], rank_col="p")
    b = global_rank(table(spark, sf, "labels").select(F.col("doc_id").alias("b")), ["b"], rank_col="p")
    j = a.join(b, "p", "full_outer")
    return j.agg(
        F.count(F.lit(1)).alias("positions"),
        F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same"),
        F.count(F.when(F.col("a") != F.col("b"), 1)).alias("different"),
        F.count(F.when(F.col("b").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("right_only"),
    )


@register("table_shape", with_views("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(4 AS BIGINT) AS columns FROM comments", "comments"))
def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    return M.table_shape(fx.comments(spark, sf))


@register(
    "mask_consistency",
    with_views(
        "SELECT CAST(count(*) AS BIGINT) AS checked, "
        "CAST(sum(CASE WHEN (toxic <> -1) <> (quality <> -1) THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM comments",
        "comments",
    ),
)
def mask_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return M.mask_consistency(fx.comments(spark, sf), "toxic", "quality")


_MASKED = "SELECT id, CASE WHEN id % 10 = 3 THEN -1 ELSE toxic END AS toxic, quality FROM comments"


@register(
    "mask_violations",
    with_views(f"SELECT id, toxic, quality FROM ({_MASKED}) WHERE (toxic <> -1) <> (quality <> -1)", "comments"),
)
def mask_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The rows whose two label columns disagree on being scored, on a view where one mask has holes."""
    c = fx.comments(spark, sf).select("id", F.when(F.col("id") % 10 == 3, -1).otherwise(F.col("toxic")).alias("toxic"), "quality")
    return M.mask_violations(c, "toxic", "quality")
