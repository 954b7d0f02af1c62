"""Queries: scores, metrics and metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions import math as X
from commentlab.functions import text as T
from commentlab.operators import metrics as M
from commentlab.operators import monitor as W
from commentlab.operators import order as O
from commentlab.operators import quantiles as Q
from commentlab.operators.sequence import softmax_long
from commentlab.plans import fixtures as fx
from commentlab.plans.fixtures import with_views
from commentlab.plans.q_text import sql_ws_tokens
from commentlab.plans.registry import r6, register
from commentlab.sources.tables import table

BATCH = 64
CLAMP = 1.0
LR0, DECAY = 1.0, 0.5

_ARGMAX_SQL = "CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER)"
_LOSS_SQL = "greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit)))"
_ID_BATCH_SQL = f"CAST(floor((row_number() OVER (ORDER BY id) - 1) / {BATCH}) AS BIGINT)"
_EPOCHS_SQL = "SELECT series, epoch, avg(value) AS value FROM metrics GROUP BY series, epoch"


def fixed6(s: str, n: str) -> F.Column:
    """Mean of values with 4 decimals, to 6 decimals, through integers: the running sum is exact in
    units of 1e-4, so both engines divide the same integers and round the same quotient (a float mean
    rounded at the 6th decimal would hit exact halves and round either way)."""
    return F.round(F.round(F.col(s) * 10000) * 100 / F.col(n), 0) / 1000000


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return M.with_predictions(fx.scored(spark, sf), 0.5, scale="logit")


def _id_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation batches: scored comments in id order, 64 per batch."""
    return O.batches(fx.scored_comments(spark, sf).select("id"), ["id"], BATCH)


# ---- scalar functions on scores


@register("sigmoid_scores", with_views("SELECT id, label, round(1 / (1 + exp(-logit)), 6) AS prob FROM scored", "scored"))
def sigmoid_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M1."""
    return fx.scored(spark, sf).select("id", "label", r6(X.sigmoid("logit")).alias("prob"))


@register(
    "clamp_values",
    with_views(f"SELECT id, label, round(greatest(-{CLAMP}, least({CLAMP}, logit)), 6) AS clamped FROM scored", "scored"),
)
def clamp_values(spark: SparkSession, sf: str) -> DataFrame:
    """M2."""
    return fx.scored(spark, sf).select("id", "label", r6(X.clamp("logit", CLAMP)).alias("clamped"))


@register(
    "softmax_scores",
    with_views(
        "WITH l AS (SELECT id, unnest(scores) AS s, CAST(generate_subscripts(scores, 1) - 1 AS INTEGER) AS k FROM class_scores), "
        "e AS (SELECT id, k, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM l) "
        "SELECT id, k, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM e",
        "class_scores",
    ),
)
def softmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M4, array form (each row's scores sum to 1), shown long."""
    cs = fx.class_scores(spark, sf).select("id", X.softmax("scores").alias("p"))
    return cs.select("id", F.posexplode("p").alias("k", "p")).select("id", "k", r6("p").alias("p"))


@register("argmax_class", with_views(f"SELECT id, {_ARGMAX_SQL} AS pred FROM class_scores", "class_scores"))
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    """M5."""
    return fx.class_scores(spark, sf).select("id", X.argmax("scores").alias("pred"))


@register(
    "softmax_long",
    with_views(
        "SELECT id, label, round(e / sum(e) OVER (PARTITION BY id), 6) AS p FROM "
        "(SELECT id, label, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM scored)",
        "scored",
    ),
)
def softmax_long_q(spark: SparkSession, sf: str) -> DataFrame:
    """M4, long form: softmax of the label logits within each comment."""
    out = softmax_long(fx.scored(spark, sf), "id", "logit")
    return out.select("id", "label", r6("p").alias("p"))


@register("threshold_labels", with_views("SELECT id, label, CAST(logit > 0.5 AS INTEGER) AS pred FROM scored", "scored"))
def threshold_labels(spark: SparkSession, sf: str) -> DataFrame:
    """B5 with the reference's rule: positive iff the raw logit > 0.5."""
    return _pred(spark, sf).select("id", "label", "pred")


# ---- label statistics


@register(
    "label_counts",
    with_views(
        "SELECT label, CAST(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives, CAST(count(*) AS BIGINT) AS total "
        "FROM scored GROUP BY label",
        "scored",
    ),
)
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """E1 (counting from 0, not from the reference's 1)."""
    return M.label_counts(fx.scored(spark, sf))


@register(
    "label_balance",
    with_views(
        "SELECT 'toxic' AS label, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS share FROM scored_comments "
        "UNION ALL SELECT 'quality', round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) FROM scored_comments "
        "UNION ALL SELECT 'clean', round(avg(CASE WHEN toxic = 0 AND quality = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) FROM scored_comments",
        "scored_comments",
    ),
)
def label_balance(spark: SparkSession, sf: str) -> DataFrame:
    """E2."""
    out = M.label_balance(fx.scored_comments(spark, sf), fx.LABELS)
    return out.select("label", r6("share").alias("share"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    sc = fx.scored_comments(spark, sf)
    return sc.select("id", T.token_count(T.rstrip_space("comment_text")).alias("n"))


_LEN_SQL = f"SELECT id, len({sql_ws_tokens('comment_text')}) AS n FROM scored_comments"


@register(
    "length_describe",
    with_views(
        f"WITH lens AS ({_LEN_SQL}) SELECT CAST(count(n) AS BIGINT) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, "
        "round(min(n)::DOUBLE, 6) AS min, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, "
        "round(quantile_cont(n, 0.75), 6) AS q75, round(max(n)::DOUBLE, 6) AS max FROM lens",
        "scored_comments",
    ),
)
def length_describe(spark: SparkSession, sf: str) -> DataFrame:
    """E3 on ``len(text.rstrip().split())``."""
    d = M.describe(_lengths(spark, sf), "n")
    return d.select(F.col("count").cast("bigint").alias("count"), *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@register(
    "length_quantile",
    with_views(f"WITH lens AS ({_LEN_SQL}) SELECT round(quantile_cont(n, 0.8), 6) AS quantile FROM lens", "scored_comments"),
)
def length_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """E4."""
    return M.quantile(_lengths(spark, sf), "n", 0.8).select(r6("quantile").alias("quantile"))


# ---- accuracy, AUC, losses


@register(
    "label_accuracy",
    with_views("SELECT label, round(avg(CASE WHEN CAST(logit > 0.5 AS INTEGER) = target THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM scored GROUP BY label", "scored"),
)
def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """E10 (with B6 match indicators)."""
    return M.label_accuracy(_pred(spark, sf)).select("label", r6("accuracy").alias("accuracy"))


_BATCHED_ACC_SQL = (
    f"WITH b AS (SELECT id, {_ID_BATCH_SQL} AS batch_id FROM scored_comments), "
    "pb AS (SELECT s.label, b.batch_id, avg(CASE WHEN CAST(s.logit > 0.5 AS INTEGER) = s.target THEN 1.0 ELSE 0.0 END)::DOUBLE AS acc "
    "FROM scored s JOIN b ON s.id = b.id GROUP BY s.label, b.batch_id) "
)


@register(
    "label_accuracy_batched",
    with_views(_BATCHED_ACC_SQL + "SELECT label, round(avg(acc), 6) AS accuracy FROM pb GROUP BY label", "scored"),
)
def label_accuracy_batched(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of per-batch accuracies (the reference's evaluate)."""
    pred = _pred(spark, sf).join(_id_batches(spark, sf), "id")
    return M.label_accuracy_batched(pred).select("label", r6("accuracy").alias("accuracy"))


@register(
    "macro_accuracy",
    with_views(_BATCHED_ACC_SQL + "SELECT round(avg(a), 6) AS macro_accuracy FROM (SELECT label, avg(acc) AS a FROM pb GROUP BY label)", "scored"),
)
def macro_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """E12 over E11."""
    pred = _pred(spark, sf).join(_id_batches(spark, sf), "id")
    return M.macro(M.label_accuracy_batched(pred)).select(r6("macro_accuracy").alias("macro_accuracy"))


@register(
    "label_auc",
    with_views(
        "WITH g AS (SELECT label, logit AS score, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END)::DOUBLE AS pos, "
        "sum(CASE WHEN target <> 1 THEN 1 ELSE 0 END)::DOUBLE AS neg FROM scored GROUP BY label, logit), "
        "c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) "
        "SELECT label, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c GROUP BY label",
        "scored",
    ),
)
def label_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Tie-averaged ROC AUC per label."""
    return M.label_auc(fx.scored(spark, sf)).select("label", r6("auc").alias("auc"))


_CM_SQL = (
    f"WITH p AS (SELECT target, {_ARGMAX_SQL} AS pred FROM class_scores), "
    f"grid AS (SELECT CAST(range // {fx.N_CLASSES} AS INTEGER) AS target, CAST(range % {fx.N_CLASSES} AS INTEGER) AS pred FROM range({fx.N_CLASSES * fx.N_CLASSES})), "
    "cm AS (SELECT g.target, g.pred, CAST(count(p.target) AS BIGINT) AS n FROM grid g LEFT JOIN p ON g.target = p.target AND g.pred = p.pred GROUP BY g.target, g.pred) "
)


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_matrix(M.class_predictions(fx.class_scores(spark, sf)), fx.N_CLASSES)


@register("confusion_matrix", with_views(_CM_SQL + "SELECT target, pred, n FROM cm", "class_scores"))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """E14."""
    return _confusion(spark, sf)


@register(
    "confusion_wide",
    with_views(
        _CM_SQL
        + "SELECT target, "
        + ", ".join(f"CAST(sum(CASE WHEN pred = {j} THEN n ELSE 0 END) AS BIGINT) AS p{j}" for j in range(fx.N_CLASSES))
        + " FROM cm GROUP BY target",
        "class_scores",
    ),
)
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    """E14, wide form by pivot: rows = target, columns = prediction."""
    return M.confusion_wide(_confusion(spark, sf), fx.N_CLASSES)


_CM_ACC_SQL = (
    "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN target = pred THEN n ELSE 0 END) AS BIGINT) AS correct, "
    "round(100.0 * sum(CASE WHEN target = pred THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS accuracy_pct FROM cm"
)


@register("confusion_accuracy", with_views(_CM_SQL + _CM_ACC_SQL, "class_scores"))
def confusion_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Trace / total in percent."""
    out = M.confusion_accuracy(_confusion(spark, sf))
    return out.select(F.col("total").cast("bigint"), F.col("correct").cast("bigint"), r6("accuracy_pct").alias("accuracy_pct"))


@register("soft_margin_loss", with_views(f"SELECT round(avg({_LOSS_SQL}), 6) AS loss FROM scored", "scored"))
def soft_margin_loss(spark: SparkSession, sf: str) -> DataFrame:
    """E16."""
    return M.soft_margin_loss(fx.scored(spark, sf)).select(r6("loss").alias("loss"))


@register(
    "cross_entropy",
    with_views(
        "WITH l AS (SELECT id, target, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS k FROM class_scores), "
        "z AS (SELECT id, max(s) AS m FROM l GROUP BY id), "
        "t AS (SELECT l.id, any_value(z.m) + ln(sum(exp(l.s - z.m))) - max(CASE WHEN l.k = l.target THEN l.s END) AS ce "
        "FROM l JOIN z ON l.id = z.id GROUP BY l.id) SELECT round(avg(ce), 6) AS loss FROM t",
        "class_scores",
    ),
)
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """E17."""
    return M.cross_entropy(fx.class_scores(spark, sf)).select(r6("loss").alias("loss"))


@register(
    "loss_batched",
    with_views(
        f"WITH b AS (SELECT id, {_ID_BATCH_SQL} AS batch_id FROM scored_comments), "
        f"pb AS (SELECT b.batch_id, avg({_LOSS_SQL}) AS l FROM scored s JOIN b ON s.id = b.id GROUP BY b.batch_id) "
        "SELECT round(avg(l), 6) AS loss FROM pb",
        "scored",
    ),
)
def loss_batched(spark: SparkSession, sf: str) -> DataFrame:
    """E18."""
    s = fx.scored(spark, sf).join(_id_batches(spark, sf), "id")
    return M.loss_batched(s).select(r6("loss").alias("loss"))


@register(
    "exact_match",
    with_views(
        "SELECT round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS exact_match FROM "
        "(SELECT id, bool_and(CAST(logit > 0.5 AS INTEGER) = target) AS ok FROM scored GROUP BY id)",
        "scored",
    ),
)
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    """E19."""
    return M.exact_match(_pred(spark, sf)).select(r6("exact_match").alias("exact_match"))


# ---- metric series


@register(
    "series_steps",
    "SELECT event_type AS series, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS step, "
    "round(value / 100, 6) AS value FROM events",
)
def series_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Step index per named series."""
    m = fx.metrics(spark, sf).select("series", "event_id", "ts", "value")
    return W.series_steps(m).select("series", "event_id", "step", r6("value").alias("value"))


@register(
    "running_mean",
    with_views(
        "SELECT series, epoch, step, round(round(s * 10000) * 100 / n) / 1000000 AS running_mean FROM ("
        "SELECT series, epoch, step, sum(value) OVER w AS s, count(value) OVER w AS n FROM metrics "
        "WINDOW w AS (PARTITION BY series, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        "metrics",
    ),
)
def running_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The average meter, reset at every epoch."""
    out = W.running_mean(fx.metrics(spark, sf))
    return out.select("series", "epoch", "step", fixed6("_s", "_n").alias("running_mean"))


@register(
    "running_best",
    with_views(
        f"WITH e AS ({_EPOCHS_SQL}) SELECT series, epoch, round(value, 6) AS value, "
        "CAST(value > coalesce(max(value) OVER (PARTITION BY series ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS improved, "
        "CAST(row_number() OVER (PARTITION BY series ORDER BY value DESC, epoch) = 1 AS INTEGER) AS is_best FROM e",
        "metrics",
    ),
)
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    """W3 over epoch means."""
    out = W.running_best(W.epoch_values(fx.metrics(spark, sf)))
    return out.select("series", "epoch", r6("value").alias("value"), "improved", "is_best")


@register(
    "lr_schedule",
    with_views(
        f"WITH e AS ({_EPOCHS_SQL}), r AS (SELECT *, CASE WHEN value > lag(value) OVER (PARTITION BY series ORDER BY epoch) THEN 1 ELSE 0 END AS rose FROM e) "
        f"SELECT series, epoch, round({LR0} * pow({DECAY}, sum(rose) OVER (PARTITION BY series ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS lr FROM r",
        "metrics",
    ),
)
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """W4 with the epoch mean as the loss."""
    out = W.lr_schedule(W.epoch_values(fx.metrics(spark, sf)), LR0, DECAY)
    return out.select("series", "epoch", r6("lr").alias("lr"))


# ---- E3 / E4 of a continuous column

_PROBS = (0.0, 0.01, 0.25, 0.5, 0.8, 0.999, 1.0)
_NET_SQL = "(SELECT CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) AS x FROM lineitem)"


def _net_price(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_extendedprice", "l_discount")
    return d.select((F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))).alias("x"))


@register(
    "quantiles_continuous",
    " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(x, {p}), 4) AS value FROM {_NET_SQL}" for p in _PROBS),
)
def quantiles_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """E4 by rank selection: exact quantiles of a column with as many values as rows."""
    return Q.exact_quantiles(_net_price(spark, sf), "x", _PROBS).select("prob", F.round("value", 4).alias("value"))


@register(
    "describe_continuous",
    "SELECT CAST(count(x) AS BIGINT) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q25, "
    f"round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75, round(max(x), 4) AS max FROM {_NET_SQL}",
)
def describe_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """E3 of a continuous column, quartiles by rank selection."""
    d = Q.describe_continuous(_net_price(spark, sf), "x")
    return d.select("count", *[F.round(c, 4).alias(c) for c in d.columns[1:]])
