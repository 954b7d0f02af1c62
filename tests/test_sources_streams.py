"""File-order positions, published versions, prepare-once, and streams that are resumed or lost half-way."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlab.sources import files as io
from commentlab.sources import positions as P
from commentlab.sources import published as Pub
from commentlab.streaming import meters as St

ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def write_files(spark, folder, parts, fmt="csv"):
    """One file a part, in the order given."""
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(parts):
        one = spark.createDataFrame(rows, ROWS).coalesce(1)
        one.write.mode("overwrite").parquet(f"{folder}/tmp{k}") if fmt == "parquet" else io.write_csv(one, f"{folder}/tmp{k}", header=False)
        name = next(n for n in sorted(os.listdir(f"{folder}/tmp{k}")) if n.startswith("part-"))
        os.replace(f"{folder}/tmp{k}/{name}", f"{folder}/{k:03d}.{fmt}")
        for n in os.listdir(f"{folder}/tmp{k}"):
            os.remove(f"{folder}/tmp{k}/{n}")
        os.rmdir(f"{folder}/tmp{k}")


PARTS = [
    [(7, "a"), (3, "b"), (7, "c")],
    [(i * 37 % 101, f"row {i} " + "x" * (i % 50)) for i in range(400)],
    [(None, None)],
    [(1, 'quoted "text", with comma')],
]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "split csv"])
def test_positions_follow_the_files(spark, tmp_path, fmt):
    folder = str(tmp_path / "in")
    write_files(spark, folder, PARTS, "parquet" if fmt == "parquet" else "csv")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if fmt != "csv":  # several blocks a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        if fmt == "parquet":
            rows = P.parquet_positions(spark, folder)
        else:
            rows = P.text_positions(spark, folder, ROWS, escape='"', multiLine=fmt == "csv")
        got = sorted((r["position"], r["id"], r["text"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    flat = [r for part in PARTS for r in part]
    assert got == [(i, *r) for i, r in enumerate(flat)]


def test_equal_ids_in_another_order(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_files(spark, a, [[(1, "x"), (2, "y")], [(3, "z"), (None, "n"), (5, "w")]], "parquet")
    write_files(spark, b, [[(3, "p")], [(2, "q"), (1, "r"), (None, "s")]], "parquet")
    left = P.parquet_positions(spark, a)
    right = P.parquet_positions(spark, b).select("position", F.col("id").alias("other"), F.col("text").alias("label"))
    assert tuple(P.alignment(left, right, "id", "other").first()) == (5, 2, 2, 1, 0)
    joined = P.attach_by_position(left, right, how="left").orderBy("position").collect()
    assert [(r["id"], r["other"], r["label"]) for r in joined] == [(1, 3, "p"), (2, 2, "q"), (3, 1, "r"), (None, None, "s"), (5, None, None)]
    with pytest.raises(ValueError):
        P.attach_by_position(left, P.parquet_positions(spark, b))
    assert tuple(P.alignment(left, left, "id", "id").first()) == (5, 5, 0, 0, 0)


def test_a_lost_writer_leaves_the_last_version(spark, tmp_path):
    root = str(tmp_path / "out")
    assert Pub.read_version(spark, root, "k") is None
    for place in (0, 1):
        df = spark.range(place + 1)
        Pub.publish(df, root, Pub.write_version(df, root), "k", place)
    Pub.write_version(spark.range(99), root)  # written, never published
    assert Pub.read_version(spark, root, "k").count() == 2 and Pub.read_version(spark, root, "other") is None


def test_prepared_once_for_each_state_of_the_input(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "ready"), []

    def build():
        calls.append(1)
        return spark.read.schema(ROWS).csv(source).select(F.sum("id").alias("s"))

    def prepared():
        return io.materialise(spark, root, [source], build).first()["s"]

    write_files(spark, source, [[(1, "a")], [(2, "b")]])
    assert prepared() == prepared() == 3 and len(calls) == 1
    write_files(spark, source, [[(1, "a")], [(20, "b")]])
    assert prepared() == prepared() == 21 and len(calls) == 2
    time.sleep(0.01)
    write_files(spark, source, [[(1, "a")], [(20, "b")], [(4, "c")]])
    assert prepared() == 25 and len(calls) == 3


EVENTS = "event_id bigint, event_type string, ts timestamp, value double"


def arrive(spark, inbox, first, n):
    rows = spark.range(first, first + n).selectExpr(
        "id AS event_id", "concat('e', id % 3) AS event_type", "timestamp_seconds(86400 * (id % 5)) AS ts", "CAST(id AS DOUBLE) AS value"
    )
    rows.coalesce(1).write.mode("append").parquet(inbox)


def totals(table):
    return {(r["series"], r["epoch"]): (r["n"], round(r["total"], 6)) for r in table.collect()}


def expected(n):
    out = {}
    for i in range(n):
        key = (f"e{i % 3}", i % 5)
        count, total = out.get(key, (0, 0.0))
        out[key] = (count + 1, round(total + i / 100, 6))
    return out


def test_meter_goes_on_where_it_stopped(spark, tmp_path):
    inbox, sink, ckpt = (str(tmp_path / n) for n in ("in", "sink", "ckpt"))
    schema = spark.createDataFrame([], EVENTS).schema
    os.makedirs(inbox)

    def run():
        return St.run_complete(St.mean_meter(St.folder_stream(spark, inbox, schema)), sink, ckpt)

    for first, n in ((0, 40), (40, 25)):
        arrive(spark, inbox, first, n)
        assert totals(run()) == expected(first + n)
    assert totals(run()) == expected(65)  # nothing new


def test_meter_lost_between_write_and_publish(spark, tmp_path, monkeypatch):
    inbox, sink, ckpt = (str(tmp_path / n) for n in ("in", "sink", "ckpt"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        return St.run_complete(St.mean_meter(St.folder_stream(spark, inbox, schema)), sink, ckpt)

    arrive(spark, inbox, 0, 30)
    run()
    arrive(spark, inbox, 30, 10)
    publish = St.publish

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(St, "publish", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    assert totals(Pub.read_version(spark, sink, St.METER)) == expected(30)  # readable, as it was
    monkeypatch.setattr(St, "publish", publish)
    assert totals(run()) == expected(40)


def test_cleaned_rows_once(spark, tmp_path):
    inbox, sink, ckpt = (str(tmp_path / n) for n in ("in", "sink", "ckpt"))
    schema = spark.createDataFrame([], "doc_id bigint, text string").schema
    os.makedirs(inbox)

    def run():
        return St.run_append(St.clean_stream(St.folder_stream(spark, inbox, schema)), sink, ckpt)

    assert run().count() == 0
    for k in range(3):
        spark.createDataFrame([(10 * k + i, f"Text {i}\n") for i in range(4)], schema).write.mode("append").parquet(inbox)
        got = run()
        assert sorted(r["id"] for r in got.collect()) == [10 * j + i for j in range(k + 1) for i in range(4)]
