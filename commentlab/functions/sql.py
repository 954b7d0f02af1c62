"""SQL surface (X2–X4): the scalar functions under SQL names, a token table function, and a pluggable
tokenizer.

``register_sql_functions`` defines session-scoped SQL functions whose bodies are ordinary Spark SQL
expressions (``CREATE TEMPORARY FUNCTION … RETURN``), so a SQL user gets the same JVM-side plans as the
DataFrame API. Only a user-supplied Python tokenizer runs in Python, as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from commentlab.functions import text as T


def _sql_normalise(arg: str) -> str:
    out = f"coalesce({arg}, 'nan')"
    for pattern, repl in T.normalise_steps(True):
        out = f"regexp_replace({out}, {T.spark_sql_regex(pattern)}, '{repl}')"
    return out


def _sql_clean_tokens(arg: str) -> str:
    out = arg
    for lit in T.BR_LITERALS:
        out = f"replace({out}, '{lit}', ' ')"
    out = f"lower(regexp_replace({out}, {T.spark_sql_regex(T.CLEAN_JAVA)}, ' '))"
    return f"regexp_extract_all({out}, {T.spark_sql_regex(T.NON_WS_JAVA)}, 0)"


def register_sql_functions(spark: SparkSession) -> None:
    """X3 + X4: normalise_comment, clean_tokens, clamp, sigmoid, tokens_of (table function)."""
    stmts = [
        f"CREATE OR REPLACE TEMPORARY FUNCTION normalise_comment(s STRING) RETURNS STRING RETURN {_sql_normalise('s')}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION clean_tokens(s STRING) RETURNS ARRAY<STRING> RETURN {_sql_clean_tokens('s')}",
        "CREATE OR REPLACE TEMPORARY FUNCTION clamp(x DOUBLE, c DOUBLE) RETURNS DOUBLE RETURN greatest(-c, least(c, x))",
        "CREATE OR REPLACE TEMPORARY FUNCTION sigmoid(x DOUBLE) RETURNS DOUBLE RETURN 1D / (1D + exp(-x))",
        "CREATE OR REPLACE TEMPORARY FUNCTION tokens_of(t STRING) RETURNS TABLE (pos INT, token STRING) "
        f"RETURN SELECT posexplode(regexp_extract_all(lower(t), {T.spark_sql_regex(T.WORD_JAVA)}, 0))",
    ]
    for s in stmts:
        spark.sql(s)


def tokenise(col: Column | str, how: str | Callable[[str], list[str]] = "regex") -> Column:
    """Pluggable tokenizer. 'regex' (T9), 'whitespace' (T8), 'clean' (T5) are native expressions;
    a Python callable ``str -> list[str]`` runs as an Arrow-batched pandas UDF."""
    c = F.col(col) if isinstance(col, str) else col
    if how == "regex":
        return T.word_punct_tokens(c)
    if how == "whitespace":
        return T.whitespace_tokens(c)
    if how == "clean":
        return T.clean_tokens(c)
    if not callable(how):
        raise ValueError(f"unknown tokenizer {how!r}")
    fn = how

    @F.pandas_udf(Ty.ArrayType(Ty.StringType()))
    def _tok(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else list(fn(x)))

    return _tok(c)
