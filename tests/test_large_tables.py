"""Queries over tables that are folders, and work that must not grow with the vocabulary or with every single token."""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlab.functions.sql import register_sql_functions
from commentlab.operators import vocab as V
from commentlab.plans.q_vocab import _sparse_summary
from commentlab.streaming import meters as St


def test_sql_functions_use_the_fast_spelling(spark):
    register_sql_functions(spark)
    spark.range(1).selectExpr("CAST(id AS STRING) AS s").createOrReplaceTempView("some_texts")
    for query in ("SELECT clean_tokens(s) AS x FROM some_texts", "SELECT t.token FROM some_texts, LATERAL tokens_of(s) t"):
        plan = spark.sql(query)._jdf.queryExecution().optimizedPlan().toString()
        assert "(?U)" in plan and "x{2028}" not in plan


def test_token_difference_keeps_no_row_per_token(spark):
    rows = [("en", "a"), ("en", "a"), ("en", "b"), ("de", "b"), ("de", "c"), (None, "d"), ("en", "d"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, token string")
    out = V.token_difference(df, F.col("lang") == "en", F.col("lang") != "en")
    want = df.where("lang = 'en'").select("token").subtract(df.where("lang <> 'en'").select("token"))
    assert sorted(out.collect(), key=str) == sorted(want.collect(), key=str)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_summary_does_not_build_the_dense_vector(spark):
    size = 2**31 - 1
    rows = [(1, SparseVector(size, [0, 7], [1.0, 2.0])), (2, SparseVector(size, [], []))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", VectorUDT())]))
    got = {r["id"]: tuple(r)[1:] for r in _sparse_summary(df, size).collect()}
    assert got == {1: (2, 17.0, 7, True), 2: (0, 0.0, -1, True)}


def test_stream_of_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(i, i % 3, [float(i == j) for j in range(10)]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    df.repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    meter = St.confusion_meter(St.table_stream(spark, str(tmp_path), "embeddings"), 10)
    cells = St.run_complete(meter, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    assert sorted(tuple(r) for r in cells.collect()) == sorted((i % 3, i, 1) for i in range(10))
