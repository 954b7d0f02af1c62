"""Queries: the SQL surface and the pluggable tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions.sql import register_sql_functions, tokenise
from commentlab.plans import fixtures as fx
from commentlab.plans.fixtures import with_views
from commentlab.plans.q_metrics import CLAMP
from commentlab.plans.q_text import sql_clean_tokens, sql_normalise, sql_ws_tokens
from commentlab.plans.registry import register
from commentlab.sources.tables import table


def _python_split(text: str) -> list[str]:
    """A user tokenizer written in Python: ``str.split()``."""
    return text.split()


@register(
    "custom_tokenizer",
    f"SELECT doc_id AS id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
    f"(SELECT doc_id, {sql_ws_tokens('text')} AS t FROM documents)",
)
def custom_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    """A Python callable plugged in as the tokenizer (runs as a pandas UDF over Arrow batches)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tokenise("text", _python_split).alias("t"))
    return d.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register(
    "sql_functions",
    with_views(
        f"SELECT id, {sql_normalise('comment_text')} AS text, array_to_string({sql_clean_tokens('comment_text')}, ' ') AS tokens FROM comments",
        "comments",
    ),
)
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """normalise_comment / clean_tokens called from Spark SQL."""
    register_sql_functions(spark)
    fx.comments(spark, sf).createOrReplaceTempView("cl_comments")
    return spark.sql("SELECT id, normalise_comment(comment_text) AS text, array_join(clean_tokens(comment_text), ' ') AS tokens FROM cl_comments")


@register(
    "sql_score_functions",
    with_views(f"SELECT id, label, round(1 / (1 + exp(-logit)), 6) AS prob, round(greatest(-{CLAMP}, least({CLAMP}, logit)), 6) AS clamped FROM scored", "scored"),
)
def sql_score_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Sigmoid / clamp called from Spark SQL."""
    register_sql_functions(spark)
    fx.scored(spark, sf).createOrReplaceTempView("cl_scored")
    return spark.sql(f"SELECT id, label, round(sigmoid(logit), 6) AS prob, round(clamp(logit, {CLAMP}), 6) AS clamped FROM cl_scored")


@register("sql_token_table", with_views("SELECT id, pos, token FROM tokens", "tokens"))
def sql_token_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table function tokens_of(text) joined laterally to the documents."""
    register_sql_functions(spark)
    table(spark, sf, "documents").createOrReplaceTempView("cl_documents")
    return spark.sql("SELECT d.doc_id AS id, t.pos, t.token FROM cl_documents d, LATERAL tokens_of(d.text) t")
