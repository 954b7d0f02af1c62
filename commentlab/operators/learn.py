"""Learning on document features (F6, F7, F9, F11, F12) with Spark ML.

One binary model per label on a persisted feature table ``(id, features VectorUDT, <labels>)``. For a
linear model on fixed features the joint multi-label soft-margin loss is the mean of the per-label
logistic losses, so one logistic regression per label has the same optimum as joint training. A logistic
fit runs until its tolerance is met; one that does not get there is an error. ``score_equations`` certifies a logistic
optimum on the training rows. The SVM takes a fixed number of steps. Candidates of a grid are fitted in parallel.
Every fit is a distributed Spark ML job (gradient sums by tree aggregation); only coefficients — bounded
by the feature dimension — live on the driver.

The reference's second-stage classifier is an RBF-kernel SVM; Spark ML has a linear SVM only, so F7 is
``LinearSVC``, on the features themselves or on their random Fourier features (``operators.kernel``), which
approximate the RBF kernel within a stated error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.operators import kernel as K
from commentlab.operators import metrics as M
from commentlab.session import cut_lineage

MAX_ITERATIONS = 400  # a fit that needs more is an error, not a result
TOLERANCE = 1e-4  # of the objective, against its first value
SVM_ITERATIONS = 50  # the hinge loss is not smooth and creeps on; a fixed number of steps is the parameter here

MODELS: dict[str, Callable[[], object]] = {
    "logistic": lambda: LogisticRegression(regParam=0.0, maxIter=MAX_ITERATIONS, tol=TOLERANCE, standardization=True),
    "logistic_l2": lambda: LogisticRegression(regParam=0.01, maxIter=MAX_ITERATIONS, tol=TOLERANCE, standardization=True),
    "linear_svm": lambda: LinearSVC(regParam=0.01, maxIter=SVM_ITERATIONS),
}


def make_model(name: str):
    """candidate models by name; an unknown name is an error."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name]()


def feature_frame(doc_vectors: DataFrame, labels: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """F8: (id, features, labels...) with features as an ML vector, written once for repeated fits."""
    df = doc_vectors.join(labels.select("id", *label_cols), "id").select(
        "id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), *[F.col(c).cast("double").alias(c) for c in label_cols]
    )
    return cut_lineage(df, "features")


def fit_per_label(train: DataFrame, label_cols: Sequence[str], model: str = "logistic") -> dict[str, object]:
    """One fitted model per label."""
    fitted = {}
    for label in label_cols:
        est = make_model(model).setFeaturesCol("features").setLabelCol(label)
        fitted[label] = est.fit(train)
        summary = fitted[label].summary  # a property of one model kind, a method of the other
        summary = summary() if callable(summary) else summary
        if model != "linear_svm" and summary.totalIterations >= MAX_ITERATIONS:
            raise RuntimeError(f"{model} for {label} has not converged in {MAX_ITERATIONS} iterations")
    return fitted


def score_per_label(models: dict[str, object], df: DataFrame) -> DataFrame:
    """Long scores (id, label, logit, target) of every label model on ``df``."""
    parts = []
    for label, m in models.items():
        out = m.setPredictionCol("_pred").setRawPredictionCol("_raw").transform(df)
        # raw prediction = (-margin, margin) for both model kinds: the margin is the logit
        parts.append(
            out.select(
                "id",
                F.lit(label).alias("label"),
                F.element_at(vector_to_array(F.col("_raw")), 2).alias("logit"),
                F.col(label).cast("int").alias("target"),
                F.col("_pred").cast("int").alias("pred"),
            )
        )
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.withColumn("match", (F.col("pred") == F.col("target")).cast("int"))


def evaluate(long: DataFrame) -> DataFrame:
    """Per-label accuracy (E10) and AUC (E13) of long scores."""
    acc = M.label_accuracy(long)
    auc = M.label_auc(long.select("id", "label", "logit", "target"))
    return acc.join(auc, "label")


def score_equations(models: dict[str, object], train: DataFrame) -> DataFrame:
    """is a logistic fit at its optimum? Per label, on the training rows: ``n``, ``base_rate``, the mean predicted
    probability ``mean_p`` and ``gap``, the largest of the score equations sum((p - y) x_j) = 0 in units of n standard
    deviations of x_j. At the optimum of an unregularised fit with intercept mean_p is base_rate and gap is 0."""
    parts = []
    for label, m in models.items():
        out = m.setPredictionCol("_pred").setRawPredictionCol("_raw").setProbabilityCol("_prob").transform(train)
        x = vector_to_array("features")
        p = F.element_at(vector_to_array(F.col("_prob")), 2)
        rows = out.select(F.col(label).alias("y"), p.alias("p"), x.alias("x"))
        dims = range(m.numFeatures)
        sums = [F.sum((F.col("p") - F.col("y")) * F.col("x")[j]) for j in dims]
        spread = [F.stddev_pop(F.col("x")[j]) for j in dims]
        gaps = [F.when(d > 0, F.abs(s) / (F.count(F.lit(1)) * d)).otherwise(0.0) for s, d in zip(sums, spread, strict=True)]
        gap = F.greatest(F.lit(0.0), *gaps)
        parts.append(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"), F.avg("p").alias("mean_p"), gap.alias("gap")).select(F.lit(label).alias("label"), "*"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def with_fourier_features(df: DataFrame, dim: int, n_features: int, gamma: float, seed: int = 0) -> DataFrame:
    """``df`` with its feature vectors replaced by their random Fourier features, written once for repeated fits."""
    z = K.fourier_features(vector_to_array("features"), dim, n_features, gamma, seed)
    return cut_lineage(df.withColumn("features", array_to_vector(z)), "fourier-features")


def grids() -> dict[str, tuple[object, list[dict]]]:
    """the candidate families with their parameter grids."""
    logistic, svm = make_model("logistic"), make_model("linear_svm")
    return {
        "logistic": (logistic, ParamGridBuilder().addGrid(logistic.regParam, [0.0, 0.01]).build()),
        "linear_svm": (svm, ParamGridBuilder().addGrid(svm.regParam, [0.01, 0.1]).build()),
    }


def fit_candidates(train: DataFrame, label_cols: Sequence[str], families: dict[str, tuple[object, list[dict]]], threads: int = 4) -> list[tuple[str, dict]]:
    """``(name, models per label)`` of every parameter setting of every family, in the order given; the fits are
    Spark jobs that ``threads`` driver threads submit side by side."""
    names, jobs = [], []
    for family, (estimator, settings) in families.items():
        for setting in settings:
            text = ", ".join(f"{p.name}={v}" for p, v in sorted(setting.items(), key=lambda x: x[0].name))
            name = len(names)
            names.append(f"{family}({text})")
            for label in label_cols:
                jobs.append((name, label, estimator.copy(setting).setFeaturesCol("features").setLabelCol(label)))
    fit = inheritable_thread_target(train.sparkSession)(lambda job: (job[0], job[1], job[2].fit(train)))
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        fitted = pool.map(fit, jobs, chunksize=1)
    return [(n, {label: m for i, label, m in fitted if i == k}) for k, n in enumerate(names)]


def loss_history(spark: SparkSession, models: dict[str, object]) -> DataFrame:
    """objective value per training iteration, long form (series, step, value). The history is
    a short list per model (bounded by maxIter), so it is built on the driver."""
    rows = []
    for label, m in models.items():
        hist = m.summary.objectiveHistory
        rows.extend((label, i, float(v)) for i, v in enumerate(hist))
    return spark.createDataFrame(rows, "series string, step int, value double")
