"""CSV / TSV / text sources and sinks (A1–A10).

Readers always take an explicit schema (no inference pass over the data). Writers write one directory of
part files per call — never ``coalesce(1)`` — so a write is as parallel as the frame. Every path is a
folder in the shared location; Spark's commit protocol makes each write all-or-nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlab.sources.published import input_fingerprint, publish, read_version, write_version

COMMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("comment_text", T.StringType()),
        T.StructField("toxic", T.IntegerType()),
        T.StructField("quality", T.IntegerType()),
    ]
)


def comment_schema(labels: list[str], label_type: T.DataType = T.IntegerType(), id_type: T.DataType = T.LongType()) -> T.StructType:
    return T.StructType(
        [T.StructField("id", id_type), T.StructField("comment_text", T.StringType())] + [T.StructField(c, label_type) for c in labels]
    )


# --- A1 / A5: headed CSV whose text holds quoted newlines, commas and doubled quotes


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "overwrite") -> None:
    """A5: headed, quoted CSV (doubled quotes inside text), UTF-8, no row index."""
    (
        df.write.mode(mode)
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        # the CSV writer trims white space by default; text must come back unchanged
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A1: ``escape='"'`` is needed for text with quotes, ``multi_line`` for text with newlines. A file of the multi-line kind
    is read by one task; without newlines in the values pass False, and large files are split."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


# --- A2: header-less TSV (text, label), nulls filled with '0'

TSV_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


def read_tsv_filled(spark: SparkSession, path: str, fill: str = "0") -> DataFrame:
    """A2 (+B3): ``pd.read_csv(sep='\\t', header=None, names=[text, label]).fillna('0')``."""
    return read_csv(spark, path, TSV_SCHEMA, header=False, sep="\t").na.fill(fill)


# --- A3: typed positional load of several splits


def read_splits(spark: SparkSession, paths: dict[str, str], labels: list[str], drop: tuple[str, ...] = ("id",)) -> DataFrame:
    """A3: one typed reader per split (labels as bytes), the split name as a column, ``drop`` removed."""
    schema = comment_schema(labels, T.ByteType())
    parts = [read_csv(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop(*drop)


# --- A4: word-vector text


def write_vectors_text(vectors: DataFrame, path: str, dim: int, header: bool = True) -> None:
    """Write ``token v1 ... vd`` lines, optionally preceded by a ``count dim`` line."""
    body = vectors.select(F.concat_ws(" ", F.col("token"), F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    if header:
        count = vectors.agg(F.count(F.lit(1)).alias("n"))
        first = count.select(F.concat_ws(" ", F.col("n").cast("string"), F.lit(str(dim))).alias("value"))
        body = first.unionByName(body)
    body.write.mode("overwrite").text(path)


def read_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``(token, vec array<float>, dim)``; a two-item line is the optional ``count dim`` header and is
    skipped; the dimension is taken from each line."""
    lines = spark.read.text(path).select(F.split(F.trim(F.col("value")), " ").alias("items"))
    body = lines.where(F.size("items") > 2)
    return body.select(
        F.col("items")[0].alias("token"),
        F.transform(F.slice("items", 2, F.size("items") - 1), lambda x: x.cast("float")).alias("vec"),
    ).withColumn("dim", F.size("vec"))


# --- A6 / A7 / A8 / A9: token, dictionary, OOV and prediction sinks


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    write_csv(df, path, header=header, sep="\t")


def write_token_lines(df: DataFrame, path: str, token_col: str = "token") -> None:
    """One token per line."""
    df.select(F.col(token_col).alias("value")).write.mode("overwrite").text(path)


def read_token_lines(spark: SparkSession, path: str, token_col: str = "token") -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias(token_col))


# --- A10: prepare once, reuse afterwards


def materialise(spark: SparkSession, root: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A10: what ``build`` makes of the files ``inputs``, prepared once for each state of these files.

    The key is a fingerprint of the files' paths, sizes and modification times. With the inputs unchanged the prepared
    table is read and ``build`` is not called; a changed input is prepared anew, published when it is complete."""
    key = input_fingerprint(spark, *inputs)
    ready = read_version(spark, root, key)
    if ready is not None:
        return ready
    df = build()
    publish(df, root, write_version(df, root), key)
    return read_version(spark, root, key)
