"""Golden rows (FIXTURES.md §3) and Python-parity properties of the text functions."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from commentlab.functions import math as X
from commentlab.functions import text as T

EXOTIC_WS = "\x1c\x1d\x1e\x1f\x85\xa0        　\t\n\x0b\x0c\r"


def _one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(expr(F.col("s")).alias("o")).first()["o"]


def test_normalise_golden(spark):
    assert _one(spark, "a\r\r\nb!!c", T.normalise_comment) == "a! b c"
    assert _one(spark, "a\r\r\nb!!c", lambda c: T.normalise_comment(c, cr_to_bang=False)) == "a\r\r b c"
    assert _one(spark, "x,,,y???z  w", T.normalise_comment) == "x,y?z w"
    s = "Second reading\nDoes it hold? Nobody minded, it's late."
    assert _one(spark, s, T.normalise_comment) == "Second reading Does it hold? Nobody minded, it's late."
    assert _one(spark, None, T.normalise_comment) is None and _one(spark, None, lambda c: T.normalise_comment(c, null_as="nan")) == "nan"


def test_clean_tokens_golden(spark):
    assert _one(spark, "a<br />b", T.clean_tokens) == ["a", "b"]
    assert _one(spark, "A<BR>b c　d", T.clean_tokens) == ["a", "br", "b", "c", "d"]
    assert _one(spark, "it's {ok} `q` ！好，", T.clean_tokens) == ["it", "s", "ok", "q", "好"]
    assert _one(spark, "", T.clean_tokens) == []


def test_whitespace_split_equals_python(spark):
    samples = ["", "  a  b ", f"x{EXOTIC_WS}y", "​z​", "a᠎b", "tab\tsep"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r["t"] for r in df.select(T.whitespace_tokens("s").alias("t")).collect()]
    assert got == [s.split() for s in samples]


def test_rstrip_equals_python(spark):
    samples = ["a \n\n", "b　 ", "c\n \n", "d\nx\n", "", "   "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = df.select(T.rstrip_space("s").alias("ws"), T.rstrip_newlines("s").alias("nl")).collect()
    assert [r["ws"] for r in rows] == [s.rstrip() for s in samples]
    assert [r["nl"] for r in rows] == [s.rstrip("\n") for s in samples]


def test_word_punct_tokens(spark):
    assert _one(spark, "It's 3 o'clock!", T.word_punct_tokens) == ["it", "'", "s", "3", "o", "'", "clock", "!"]


@pytest.mark.parametrize(
    "given,wanted",
    [
        ("tea “for” two", "tea for two"),
        ("rock‘n’roll • encore…", "rock n roll encore "),
        ("path\\to|file[7]{8}", "path to file 7 {8}"),
        ("2*(3+4)=14/1-0", "2 3 4 14 1 0"),
        ("no: yes; maybe", "no yes maybe"),
        ("one,,,two,three", "one,two,three"),
        ("why???  really?", "why? really?"),
        ("stop!!! now", "stop now"),
        ("line\nbreak", "line break"),
        ("old\r\r\rmac", "old!mac"),
        ("a     b", "a b"),
        ("", ""),
    ],
)
def test_normalise_characters_and_runs(spark, given, wanted):
    assert _one(spark, given, T.normalise_comment) == wanted


def test_padding_and_positions_golden(spark):
    df = spark.createDataFrame([([5, 7], [5, 0, 7])], "a array<int>, b array<int>")
    r = df.select(
        X.pad_right("a", 5, 0).alias("r"), X.pad_left("a", 5, 0).alias("l"), X.position_ids("b", 0).alias("p")
    ).first()
    assert r["r"] == [5, 7, 0, 0, 0]
    assert r["l"] == [0, 0, 0, 5, 7]
    assert r["p"] == [1, 0, 3]


def test_argmax_lowest_index_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>")
    assert df.select(X.argmax("a").alias("m")).first()["m"] == 1


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([800.0, 0.0, -5.0],)], "a array<double>")
    for r in df.select(X.softmax("a").alias("p")).collect():
        assert abs(sum(r["p"]) - 1.0) < 1e-12


def test_soft_margin_term_stable(spark):
    df = spark.createDataFrame([(800.0, 0), (-800.0, 1), (0.0, 1)], "x double, y int")
    vals = [r["l"] for r in df.select(X.soft_margin_term("x", "y").alias("l")).collect()]
    assert abs(vals[0] - 800.0) < 1e-9 and abs(vals[1] - 800.0) < 1e-9 and abs(vals[2] - 0.6931471805599453) < 1e-12
