"""Kernel features, certified optima, model choice and rank selection."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from commentlab.operators import kernel as K
from commentlab.operators import learn as Ln
from commentlab.operators import quantiles as Q


def test_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    gamma, n = 0.1, 2000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id int, vec array<double>")
    z = {r["id"]: r["z"] for r in df.select("id", K.fourier_features("vec", 8, n, gamma, seed=3).alias("z")).collect()}
    assert z.pop(-1) is None
    z = np.array([z[i] for i in range(len(x))])
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    off = np.abs(z @ z.T - exact)
    assert off.mean() < 0.03 and (off > 0.12).mean() <= 2 * math.exp(-n * 0.12**2 / 8)
    pair = spark.createDataFrame([(x[0].tolist(), x[1].tolist())], "a array<double>, b array<double>")
    assert math.isclose(pair.select(K.rbf("a", "b", gamma)).first()[0], exact[0, 1])
    assert math.isclose(K.scale_gamma(df.where("id >= 0")), 1 / (8 * x.var()))
    with pytest.raises(ValueError):
        K.fourier_weights(1 << 13, 1 << 13, gamma, 0)


def ring(spark, n=600):
    """Points inside and outside a ring, which no line parts."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = ((x**2).sum(axis=1) < 1.2).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, vec array<double>, toxic double")
    df = df.select("id", array_to_vector("vec").alias("features"), "toxic")
    return df.where("id < 400"), df.where("id >= 400")


def test_kernel_model_beats_the_linear_one(spark):
    train, test = ring(spark)

    def auc(a, b):
        return Ln.evaluate(Ln.score_per_label(Ln.fit_per_label(a, ["toxic"], "linear_svm"), b)).first()["auc"]

    z = [Ln.with_fourier_features(d, 2, 200, 0.7) for d in (train, test)]
    assert auc(*z) > 0.95 > 0.75 > auc(train, test)


def test_score_equations_tell_an_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, vec array<double>, toxic double")
    df = df.select("id", array_to_vector("vec").alias("features"), "toxic").cache()
    at = Ln.score_equations(Ln.fit_per_label(df, ["toxic"], "logistic"), df).first()
    assert at["n"] == 800 and math.isclose(at["base_rate"], y.mean()) and abs(at["mean_p"] - y.mean()) < 0.01 and at["gap"] < 0.01
    penalised = Ln.make_model("logistic_l2").setRegParam(0.5).setFeaturesCol("features").setLabelCol("toxic").fit(df)
    assert Ln.score_equations({"toxic": penalised}, df).first()["gap"] > 0.05


def test_candidates_in_order_with_their_own_parameters(spark):
    train, _ = ring(spark, 450)
    fitted = Ln.fit_candidates(train.withColumn("quality", 1 - F.col("toxic")), ["toxic", "quality"], Ln.grids(), threads=3)
    assert [n for n, _ in fitted] == ["logistic(regParam=0.0)", "logistic(regParam=0.01)", "linear_svm(regParam=0.01)", "linear_svm(regParam=0.1)"]
    assert all(set(m) == {"toxic", "quality"} for _, m in fitted)
    assert [m["toxic"].getRegParam() for _, m in fitted] == [0.0, 0.01, 0.01, 0.1]


PROBS = (0.0, 0.003, 0.25, 0.5, 0.8, 0.999, 1.0)


@pytest.mark.parametrize("kind", ["distinct", "ties", "one value", "few", "two values"])
def test_quantiles_by_rank_selection(spark, kind):
    values = {
        "distinct": "randn(7) * 1000", "ties": "CASE WHEN id % 3 = 0 THEN 5.0 ELSE floor(rand(3) * 40) END", "one value": "2.5D", "few": "CAST(id AS DOUBLE)",
        "two values": "CASE WHEN id % 4 = 0 THEN -1.0D ELSE 1.0D END",
    }[kind]
    df = spark.range(5 if kind == "few" else 20_000).selectExpr(f"CAST({values} AS DOUBLE) AS v").cache()
    got = {r["prob"]: r["value"] for r in Q.exact_quantiles(df, "v", PROBS, held=500, ranges=16).collect()}
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS]))).first()[0]
    assert np.allclose([got[p] for p in PROBS], want, rtol=0, atol=1e-9)


def test_no_sort_holds_more_than_its_share(spark, monkeypatch):
    df = spark.range(1_000_000).select(F.randn(11).alias("v"))
    sizes = []
    select = Q._select

    def watch(values, ranks, n, held, ranges):
        sizes.append((n, n <= held))
        return select(values, ranks, n, held, ranges)

    monkeypatch.setattr(Q, "_select", watch)
    got = Q.exact_quantiles(df, "v", (0.1, 0.5, 0.9)).collect()
    want = df.agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).first()[0]
    assert np.allclose([r["value"] for r in got], want, rtol=0, atol=1e-12)
    assert max(n for n, sorted_ in sizes if sorted_) <= Q.HELD and len(sizes) > 1


def test_quantiles_of_awkward_columns(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (1.0,)], "v double")
    assert [r["value"] for r in Q.exact_quantiles(df, "v", (0.5,)).collect()] == [2.0]
    assert [r["value"] for r in Q.exact_quantiles(df.limit(0), "v", (0.5,)).collect()] == [None]
    d = Q.describe_continuous(df.limit(0), "v").first()
    assert d["count"] == 0 and d["q50"] is None
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, "v", (1.5,))
