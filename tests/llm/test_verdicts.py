"""Whole-table checks of two verdicts: divergence rules against a plain version, redirects against the oracle on pages with tags."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import pytest

from commentlab.llm import quality, queries
from tests.conftest import SF_SMALL
from tests.llm import brute
from tools.oracle_check import _digest, frame_rows


def distance(p: Counter, q: Counter) -> float:
    """Jensen-Shannon distance of two histograms."""
    a, b = sum(p.values()), sum(q.values())
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p[k] / a, q[k] / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, total / 2))


def key(word: str) -> str:
    return re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())


def plain_verdicts(rows: list[tuple]) -> dict:
    """``rows``: (doc_id, text, lang)."""
    refs = {}
    for lang in {r[2] for r in rows if r[2] is not None}:
        texts = {t for _, t, own in rows if own == lang and t}
        words = Counter(key(w) for t in texts for w in brute.WORD.findall(t))
        n = sum(c for w, c in words.items() if w)
        if n >= 2000:
            common = {w for w, c in words.items() if w and 1000 * c >= n}
            refs[lang] = (Counter(quality._class_of(c) for t in texts for c in t), common, binned(words, common))
    out = {}
    for doc_id, text, lang in rows:
        text = text or ""
        base = brute.base_quality(text)
        held = list(refs.values()) if lang is None else [refs[lang]] if lang in refs else []
        n = base[0]
        by_class = by_word = None
        if held and len(text) >= 200:
            by_class = min(distance(Counter(map(quality._class_of, text)), classes) for classes, _, _ in held)
        if held and n >= 30:
            words = Counter(key(w) for w in brute.WORD.findall(text))
            by_word = min(distance(binned(words, common), reference) for _, common, reference in held)
        limit = 0.53 + 0.5 * max(0.0, 1 / math.sqrt(n) - 0.1) if n else 0
        out[doc_id] = (by_class, by_word, not base[5] and not (by_class or 0) > 0.32 and not (by_word or 0) > limit)
    return out


def binned(words: Counter, common: set) -> Counter:
    out = Counter()
    for w, n in words.items():
        out[w if w in common else "other word" if w else "no word"] += n
    return out


def test_divergence_verdicts_over_the_whole_table(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = plain_verdicts(docs)
    got = queries.QUERIES["op5_divergence_rules"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        by_class, by_word, kept = want[r["doc_id"]]
        assert r["kept"] == kept
        for mine, plain in ((r["char_distance"], by_class), (r["word_distance"], by_word)):
            assert (mine is None) == (plain is None) and (mine is None or mine == pytest.approx(plain, abs=1e-9))
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got)  # some go by distance alone


def test_redirects_equal_the_oracle_on_pages_with_tags(spark, tmp_path):
    link, refresh = '<html><link rel="canonical" href="{}"><p>'.format, "<META http-equiv=refresh content='5; url={}'>".format
    long = "q=" + "x" * 1500
    rows = [
        (1, "http://a.net/1", link("http://b.com/de/1")), (2, "http://a.net/2?utm_source=x", link("http://a.net/1")), (3, "http://c.net/y", refresh("/z")),
        (4, "http://c.net/z", link("//b.com/de/2")), (5, "http://d.net/", link("http://b.com/fr/1")), (6, "http://b.com/fr/1", link("http://b.com/de/9")),
        (7, "http://e.net/dir/a", link("other")), (8, "http://e.net/dir/other", refresh(f"http://b.com/de/3?{long}")), (9, f"http://b.com/de/3?{long}", None),
        (10, "https://x.example.org/es/1", link("http://f.net/")), (11, "http://f.net/", ""), (12, "http://g.org/", link("http://f.net/")),
        (13, None, link("http://b.com/de/1")), (14, "no scheme", None), (15, "http://a.net/1", None), (16, f"http://h.net/?{long}", f'<link data-x="{long}" rel=canonical href=http://f.net/>'),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op1_redirect_equivalence"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["op1_redirect_equivalence"]).df()
    (gc, gr), (wc, wr) = frame_rows(got), frame_rows(want)
    assert gc == wc and _digest(gr) == _digest(wr) and sum(r[-1] == "block" or "block" in r for r in gr) >= 6
