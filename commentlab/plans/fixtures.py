"""Derived views over the supplied tables (FIXTURES.md §2), each as a Spark plan and as the DuckDB SQL the
oracle runs. Every view is computed from the tables, so its work grows with them.

``word_vectors`` gives nine embedding rows in ten to the most frequent tokens, with a gap at every tenth rank, and
every tenth row to a rare token, so the semi/anti joins (D3/D4) have both sides populated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions.text import WORD_OR_MARK, word_punct_tokens
from commentlab.operators import order, vocab as V
from commentlab.session import cut_lineage
from commentlab.sources.tables import table

LABELS = ("toxic", "quality")
MIN_FREQ = 10
DIM = 64
N_CLASSES = 10
# weight tables taken from fixed embedding rows (model parameters, not data subsets)
HEAD_ROWS = {"toxic": 400, "quality": 401}
N_KERNELS, KERNEL_WIDTH = 8, 3
ATTN_ROWS, ATTN_OUT_ROW, ATTN_HIDDEN = list(range(100, 124)), 124, 24


def duck_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ----------------------------------------------------------------------------------------------- Spark


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """documents LEFT JOIN labels: (id, comment_text, toxic, quality), -1 = not scored."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    out = docs.join(labels, "id", "left")
    return out.select(
        "id", "comment_text", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("quality", F.lit(-1)).alias("quality")
    )


def scored_comments(spark: SparkSession, sf: str) -> DataFrame:
    """B2: comments with a score. Filtering the labels before an inner join is the same as filtering
    ``coalesce(toxic, -1) <> -1`` after the left join, and the plain predicate reaches the Parquet reader."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    labels = table(spark, sf, "labels").where(F.col("toxic") != -1).select(F.col("doc_id").alias("id"), "toxic", "quality")
    return docs.join(labels, "id").select("id", "comment_text", "toxic", "quality")


def scored_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids that have a score, whether or not a document has them: for picking documents by a semi-join. They come from
    the labels alone, whose bytes the planner knows, so that they are broadcast below its threshold."""
    return table(spark, sf, "labels").where(F.col("toxic") != -1).select(F.col("doc_id").alias("id"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(id, pos, token) of every document, whole text, regex word/mark tokenizer."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.explode_tokens(docs, "id", word_punct_tokens("text"))


def token_counts(spark: SparkSession, sf: str, tok: DataFrame | None = None) -> DataFrame:
    """(token, freq) over the whole corpus, materialised once in the shared folder: the vocabulary and
    the distinct-token list both read it, so the texts are tokenised once for both."""
    return cut_lineage(V.token_frequencies(tok if tok is not None else tokens(spark, sf)))


def vocab(spark: SparkSession, sf: str, counts: DataFrame | None = None) -> DataFrame:
    return V.vocab_from_counts(counts if counts is not None else token_counts(spark, sf), MIN_FREQ)


def word_vectors(spark: SparkSession, sf: str, counts: DataFrame | None = None) -> DataFrame:
    """(token, vec): by frequency rank, row ``vec_id`` goes to rank vec_id + 1; where vec_id ends in 9, to the
    rank that is vec_id div 10 from the last."""
    counts = counts if counts is not None else token_counts(spark, sf)
    ranked = order.global_rank(counts.select("token", "freq"), [F.col("freq").desc(), F.col("token")], rank_col="rk", total_col="total")
    front = F.when(F.col("rk") % 10 != 0, F.col("rk") - 1)
    back = (F.col("total") - F.col("rk")) * 10 + 9
    given = ranked.select("token", F.explode(F.array(front, back)).alias("vec_id"))
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return given.join(emb, "vec_id").select("token", "vec")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Long score table (id, label, logit, target) from the scored comments by a fixed formula."""
    sc = scored_comments(spark, sf).select("id", *LABELS)
    long = sc.unpivot(["id"], list(LABELS), "label", "target")
    k = F.when(F.col("label") == "toxic", 0).otherwise(1)
    logit = ((F.col("id") * (F.lit(31) + F.lit(6) * k) + 17) % 101 - 50).cast("double") / F.lit(25.0)
    return long.select("id", "label", logit.alias("logit"), F.col("target").cast("int").alias("target"))


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        F.slice("embedding", 1, N_CLASSES).cast("array<double>").alias("scores"),
        F.col("label").alias("target"),
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metric series from events: (series, epoch, step, ts, event_id, value)."""
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("series"),
        (F.dayofmonth("ts") - 1).cast("bigint").alias("epoch"),
        "ts",
        "event_id",
        (F.col("value") / 100).alias("value"),
    )
    out = order.segmented_scan(ev, ["series", "epoch"], ["ts", "event_id"], {}, row_number_col="_rn")
    return out.withColumn("step", (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def _embedding_rows(spark: SparkSession, sf: str, ids: list[int]) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", F.col("embedding").cast("array<double>").alias("w"))


def head(spark: SparkSession, sf: str) -> DataFrame:
    """Linear head (label, w, bias)."""
    rows = _embedding_rows(spark, sf, list(HEAD_ROWS.values()))
    lab = F.create_map(*[x for k, v in HEAD_ROWS.items() for x in (F.lit(v), F.lit(k))])
    return rows.select(lab[F.col("vec_id")].alias("label"), "w", F.lit(0.0).alias("bias"))


def kernels(spark: SparkSession, sf: str) -> DataFrame:
    """Trigram filters (kernel, offset, w)."""
    ids = list(range(N_KERNELS * KERNEL_WIDTH))
    rows = _embedding_rows(spark, sf, ids)
    return rows.select(
        (F.col("vec_id") / KERNEL_WIDTH).cast("int").alias("kernel"), (F.col("vec_id") % KERNEL_WIDTH).cast("int").alias("offset"), "w"
    )


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """Attention scorer: layer 1 rows (unit 0..23, w) and the output row (unit -1, first 24 entries)."""
    rows = _embedding_rows(spark, sf, ATTN_ROWS + [ATTN_OUT_ROW])
    return rows.select(
        F.when(F.col("vec_id") == ATTN_OUT_ROW, F.lit(-1)).otherwise(F.col("vec_id") - ATTN_ROWS[0]).cast("int").alias("unit"),
        F.when(F.col("vec_id") == ATTN_OUT_ROW, F.slice("w", 1, ATTN_HIDDEN)).otherwise(F.col("w")).alias("w"),
    )


# ----------------------------------------------------------------------------------------------- SQL

SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "comments": (
        "SELECT d.doc_id AS id, d.text AS comment_text, coalesce(l.toxic, -1) AS toxic, coalesce(l.quality, -1) AS quality "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        (),
    ),
    "scored_comments": ("SELECT * FROM comments WHERE toxic <> -1", ("comments",)),
    "tokens": (
        "SELECT id, CAST(pos - 1 AS INTEGER) AS pos, token FROM ("
        "SELECT doc_id AS id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM ("
        f"SELECT doc_id, regexp_extract_all(lower(text), {duck_lit(WORD_OR_MARK)}) AS t FROM documents))",
        (),
    ),
    "vocab": (
        "SELECT token, CAST(rk + 1 AS BIGINT) AS id, freq, rk AS rank FROM ("
        "SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) AS rk FROM ("
        f"SELECT token, count(*) AS freq FROM tokens GROUP BY token HAVING count(*) >= {MIN_FREQ})) "
        "UNION ALL SELECT '<unk>', 0, 0, NULL UNION ALL SELECT '<pad>', 1, 0, NULL",
        ("tokens",),
    ),
    "word_vectors": (
        "SELECT t.token, e.embedding AS vec FROM ("
        "SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS rk, count(*) OVER () AS total FROM tokens GROUP BY token) t "
        "JOIN embeddings e ON (e.vec_id % 10 <> 9 AND e.vec_id = t.rk - 1) OR (e.vec_id % 10 = 9 AND e.vec_id = (t.total - t.rk) * 10 + 9)",
        ("tokens",),
    ),
    "scored": (
        "SELECT id, 'toxic' AS label, CAST((id * 31 + 17) % 101 - 50 AS DOUBLE) / 25.0 AS logit, toxic AS target FROM scored_comments "
        "UNION ALL SELECT id, 'quality' AS label, CAST((id * 37 + 17) % 101 - 50 AS DOUBLE) / 25.0 AS logit, quality AS target FROM scored_comments",
        ("scored_comments",),
    ),
    "class_scores": (
        f"SELECT vec_id AS id, CAST(embedding[1:{N_CLASSES}] AS DOUBLE[]) AS scores, label AS target FROM embeddings",
        (),
    ),
    "metrics": (
        "SELECT event_type AS series, day(ts) - 1 AS epoch, ts, event_id, value / 100 AS value, "
        "CAST(row_number() OVER (PARTITION BY event_type, day(ts) ORDER BY ts, event_id) - 1 AS BIGINT) AS step FROM events",
        (),
    ),
}


def with_views(final_sql: str, *names: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """Prefix ``final_sql`` with the CTEs it needs (dependencies first)."""
    views = dict(SQL_VIEWS)
    if extra:
        views.update(extra)
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in views[n][1]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return final_sql
    ctes = ",\n".join(f"{n} AS ({views[n][0]})" for n in ordered)
    if final_sql.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{final_sql.lstrip()[5:]}"
    return f"WITH {ctes}\n{final_sql}"
