"""Distributed rank/scan helpers, batches, splits, monitors and metrics: golden values and properties."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from commentlab.operators import metrics as M
from commentlab.operators import monitor as W
from commentlab.operators import order as O


def test_global_rank_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    got = O.global_rank(df.repartition(7), ["k", "id"], total_col="n")
    ref = df.withColumn("rank_ref", F.row_number().over(Window.orderBy("k", "id")))
    bad = got.join(ref, ["k", "id"]).where((F.col("rank") != F.col("rank_ref")) | (F.col("n") != 5000)).count()
    assert bad == 0 and got.count() == 5000


def test_segmented_scan_with_hot_group(spark):
    # one group holds most rows: the distributed scan must still equal the plain window
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(F.lit("hot")).alias("g"), "id", (F.col("id") % 13).alias("v"))
    scans = {"s": ("sum", "v", True), "m": ("max", "v", False)}
    got = O.segmented_scan(df, ["g"], ["id"], scans, row_number_col="rn")
    w = Window.partitionBy("g").orderBy("id")
    ref = df.select(
        "g", "id",
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s_ref"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m_ref"),
        F.row_number().over(w).alias("rn_ref"),
    )
    j = got.join(ref, ["g", "id"])
    bad = j.where((F.col("s") != F.col("s_ref")) | (F.col("rn") != F.col("rn_ref")) | ~F.col("m").eqNullSafe(F.col("m_ref"))).count()
    assert bad == 0 and j.count() == 3000


def test_segmented_scan_keeps_null_groups(spark):
    rows = [(None, i, 1) for i in range(5)] + [("a", i, 1) for i in range(3)]
    got = O.segmented_scan(spark.createDataFrame(rows, "g string, id int, v int"), ["g"], ["id"], {"s": ("sum", "v", True)})
    assert sorted((r["g"] or "", r["id"], r["s"]) for r in got.collect()) == sorted([("", i, i + 1) for i in range(5)] + [("a", i, i + 1) for i in range(3)])


def test_head_and_tail_do_not_depend_on_partitioning(spark):
    df = spark.range(0, 2500)
    for part in (1, 9):
        d = df.repartition(part)
        assert sorted(r["id"] for r in O.head_rows(d, ["id"], 7).collect()) == list(range(7))
        assert sorted(r["id"] for r in O.tail_rows(d, ["id"], 1200).collect()) == list(range(1300, 2500))


def test_overlap_tail_batches_golden(spark):
    def batches(n):
        df = spark.range(1, n + 1)
        rows = O.batches_overlap_tail(df, ["id"], 2).collect()
        out = {}
        for r in rows:
            out.setdefault(r["batch_id"], set()).add(r["id"])
        return [out[k] for k in sorted(out)]

    assert batches(5) == [{1, 2}, {3, 4}, {4, 5}]
    assert batches(4) == [{1, 2}, {3, 4}, {3, 4}]


def test_batches_keep_short_last(spark):
    rows = O.batches(spark.range(0, 130), ["id"], 64).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in rows] == [64, 64, 2]


def test_splits_disjoint_complete_exact(spark):
    df = spark.range(0, 1001)
    s = O.shuffled_split(df, "id", seed=666, val_fraction=0.2)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"val": 200, "train": 801}
    assert s.select("id").distinct().count() == 1001
    # deterministic and independent of the input partitioning
    again = O.shuffled_split(df.repartition(5), "id", seed=666, val_fraction=0.2)
    assert s.exceptAll(again).count() == 0


def test_running_best_and_lr_golden(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "series string, epoch int, value double")
    rb = W.running_best(df).orderBy("epoch").collect()
    assert [r["improved"] for r in rb] == [1, 1, 0, 0, 1]
    assert [r["epoch"] for r in rb if r["is_best"] == 1] == [4]
    losses = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 0.9, 0.95, 0.96, 0.5])], "series string, epoch int, value double")
    lr = W.lr_schedule(losses, 1.0, 0.5).orderBy("epoch").collect()
    assert [r["lr"] for r in lr] == [1.0, 1.0, 0.5, 0.25, 0.25]


def test_auc_properties(spark):
    rows = [(i, "a", float((i * 37) % 11), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string, logit double, target int")
    auc = M.label_auc(df).first()["auc"]
    rev = M.label_auc(df.withColumn("logit", -F.col("logit"))).first()["auc"]
    assert abs(auc + rev - 1.0) < 1e-12
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ev = BinaryClassificationEvaluator(rawPredictionCol="logit", labelCol="t", numBins=0)
    ml = ev.evaluate(df.withColumn("t", F.col("target").cast("double")))
    assert abs(auc - ml) < 1e-12


def test_batch_accuracy_equals_row_accuracy_for_full_batches(spark):
    rows = [(i, "a", float(i % 5) - 2.0, i % 2) for i in range(128)]
    pred = M.with_predictions(spark.createDataFrame(rows, "id int, label string, logit double, target int"))
    batched = M.label_accuracy_batched(pred.join(O.batches(pred.select("id").distinct(), ["id"], 64), "id")).first()["accuracy"]
    plain = M.label_accuracy(pred).first()["accuracy"]
    assert abs(batched - plain) < 1e-12


def test_trace_accuracy_equals_argmax_accuracy(spark):
    rows = [(i, [float((i * k) % 7) for k in range(4)], i % 4) for i in range(200)]
    cs = spark.createDataFrame(rows, "id int, scores array<double>, target int")
    preds = M.class_predictions(cs)
    cm = M.confusion_matrix(preds, 4)
    assert cm.count() == 16
    acc = M.confusion_accuracy(cm).first()["accuracy_pct"]
    direct = preds.agg(F.avg((F.col("pred") == F.col("target")).cast("double"))).first()[0] * 100
    assert abs(acc - direct) < 1e-9


def test_per_label_losses_average_to_soft_margin_loss(spark):
    rows = [(i, lab, ((i * (7 + k)) % 19 - 9) / 3.0, (i + k) % 2) for i in range(100) for k, lab in enumerate(["a", "b", "c"])]
    df = spark.createDataFrame(rows, "id int, label string, logit double, target int")
    from commentlab.functions.math import soft_margin_term

    per_label = df.groupBy("label").agg(F.avg(soft_margin_term("logit", "target")).alias("l")).agg(F.avg("l")).first()[0]
    joint = M.soft_margin_loss(df).first()["loss"]
    assert abs(per_label - joint) < 1e-12


def test_encode_decode_restores_vocabulary_tokens(spark):
    from commentlab.operators import vocab as V

    toks = spark.createDataFrame([(d, p, t) for d in range(20) for p, t in enumerate(["x", "y", "x", "z", f"rare{d}"])], "id int, pos int, token string")
    vocab = V.build_vocab(toks, min_freq=2)
    enc = V.encode_tokens(toks, vocab, unk_id=0)
    back = enc.join(vocab.select(F.col("id").alias("token_id"), F.col("token").alias("decoded")), "token_id")
    known = back.where(F.col("token_id") != 0)
    assert known.where(F.col("token") != F.col("decoded")).count() == 0
    assert known.count() == 80 and enc.where(F.col("token_id") == 0).count() == 20


def test_results_unchanged_under_repartitioning(spark):
    rows = [(i, "a", float((i * 37) % 11), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string, logit double, target int")
    a = M.label_auc(df).first()["auc"]
    b = M.label_auc(df.repartition(13)).first()["auc"]
    assert a == b


def test_lookups_keep_one_schema_and_can_be_written(spark, tmp_path):
    from commentlab.operators import sequence as S
    from commentlab.operators import vocab as V

    vocab = spark.createDataFrame([("<unk>", 0, 0, None), ("a", 1, 5, 1)], "token string, id bigint, freq bigint, rank bigint")
    matrix = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id bigint, vec array<double>")
    tokens = spark.createDataFrame([(7, 0, "a"), (7, 1, "zz")], "id bigint, pos int, token string")
    encoded = V.encode_tokens(tokens, vocab)
    assert sorted(encoded.columns) == ["id", "pos", "token", "token_id"]
    S.sequence_vectors(encoded, matrix).write.parquet(str(tmp_path / "v"))
    assert sorted((r["pos"], r["vec"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [(0, [1.0]), (1, [0.0])]


def test_confusion_refuses_cells_outside_the_grid(spark):
    for bad in (5, -1, None):
        cells = spark.createDataFrame([(0, 0), (1, 1), (bad, 0)], "target int, pred int")
        with pytest.raises(Exception, match="confusion cell outside"):
            M.confusion_accuracy(M.confusion_matrix(cells, 2)).collect()
