"""Each operator against a plain version, with the awkward rows: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commentlab.llm import common, fixity, line_dedup, mixing, packing, pii, quality, queries, sharding, topk, url_filter
from tests.conftest import SF_SMALL
from tests.llm import brute
from tools.oracle_check import _digest, frame_rows

DOCS = "doc_id bigint, text string, lang string, source string, size int, _part string, shard string, ids string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60000))


def docs_frame(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with extra columns named like helpers."""
    return spark.createDataFrame([(*r, 9, "p", "s", "i") for r in rows], DOCS).repartition(3)


EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\r\n", None, None), (4, "one", "xx", None), (5, LONG, "zz", "b"),
    (6, "tie tie tie", "en", "b"), (7, "tie tie tie", "en", "b"), (8, "same row", "de", "b"), (8, "same row", "de", "b"), (None, "no id here", "fr", "c"),
    (10, "Ünïcode “quotes” ét ﬁ <|endoftext|> \x01 x", "fr", ""),
]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF_SMALL).toPandas(), duck.execute(queries.ORACLE[name]).df()
    (gc, gr), (wc, wr) = frame_rows(got), frame_rows(want)
    assert gc == wc and len(gr) == len(wr) and _digest(gr) == _digest(wr)


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]) if n != "pipeline" else 99)] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r a\u0000é", max_size=12), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_word_count(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    for r in df.select("t", common.word_count(F.col("t")).alias("n")).collect():
        assert r["n"] == len(brute.WORD.findall(r["t"] or ""))


# ---- 1


def test_url_rules_and_aliases(spark):
    link = '<html><link href="{}" rel=canonical>'.format
    rows = [
        (1, "HTTP://Www.Example.ORG/en/17?x#f", None),
        (2, "http://a.net/x", link("http://b.com/de/1")),
        (3, "https://a.net/x?utm_source=q#top", ""),
        (4, "http://c.net/y", '<META content="0; URL=/z" http-equiv="refresh">'),
        (5, "http://c.net/z", link("//b.com/de/1?ref=9")),
        (6, "http://d.net/q", link("http://b.com/de/2")),
        (7, "http://b.com/fr/2", link("http://d.net/q")),
        (8, "no scheme", link("http://b.com/de/1")), (9, None, None), (10, "http://e.net", None), (10, "http://e.net", None),
        (11, "http://f.net/dir/page", link("other")), (12, "http://f.net/dir/other", link("http://b.com/de/1")),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id int, url string, html string, host string")
    got = {}
    for r in url_filter.judge_urls(pages, url_filter.rules_table(spark)).collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[1:])
    assert got[1] == [("www.example.org", "/en/17", "example.org/en/1", "block")]
    block, allow = (None, "block"), (None, "allow")
    assert {k: v[0][2:] for k, v in got.items() if k not in (1, 7)} == {
        2: block, 3: block, 4: block, 5: block, 6: allow, 8: allow, 9: allow, 10: allow, 11: block, 12: block,
    }
    assert got[7] == [("b.com", "/fr/2", "com/fr/", "allow")] and len(got[10]) == 2
    assert got[8] == [("", "", None, "allow")] == got[9]
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_long_tags_are_read_whole(spark):
    long = "q=" + "x" * 2000
    pages = spark.createDataFrame(
        [
            (1, "http://a.net/1", f'<html><link href="http://b.com/de/1?{long}" rel=canonical>'),
            (2, "http://a.net/2", f'<meta data-x="{long}" http-equiv=refresh content="0; url=http://b.com/de/2"><p>'),
            (3, "http://a.net/3", "<link " * 200_000 + "rel=canonical href=http://b.com/de/3"),
        ],
        "page_id int, url string, html string",
    )
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, url_filter.rules_table(spark)).collect()} == {1: "block", 2: "block", 3: "allow"}


# ---- 2


def test_packing_round_trip(spark):
    rng = random.Random(2)
    rows = EDGE + [(100 + i, " ".join(rng.choice(["alpha", "Beta,", "gammadelta", "42"]) for _ in range(rng.randrange(900))), "en", rng.choice("aabcd")) for i in range(120)]
    out = packing.pack(docs_frame(spark, rows)).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted([(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows], key=repr)
    assert [sum(p["length"] for p in out)] == [sum(len(ids) for _, ids in want)]
    at = 0
    for p in sorted(out, key=lambda p: (p["sequence_id"], p["offset"])):  # gapless, full, in order
        assert p["sequence_id"] * 2048 + p["offset"] == at and 0 < p["length"] <= 2048 - p["offset"]
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        at += p["length"]
    by_doc = {}
    for p in sorted(out, key=lambda p: p["start"]):
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc, ids in want:
        pieces = by_doc[doc]
        text = b"".join(p["ids"] for p in pieces[:: 2 if doc == 8 else 1])
        assert np.frombuffer(text, "<u4").tolist() == ids
    assert packing.pack(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("weights", [None, [5, 1, 1, 2, 1]])
def test_round_robin_proportions(weights):
    totals = np.array([70_000, 21_000, 400, 13_333, 5] if weights is None else [70_000, 21_000, 14_000, 33_333, 15_000])
    share = totals if weights is None else np.array(weights)
    plan = packing.RoundRobin(totals, share)
    pieces = []
    for s, n in enumerate(totals):
        docs = np.arange(0, n, 97)
        row, start, length, place = plan.pieces(np.full(len(docs), s), docs, np.minimum(97, n - docs))
        pieces += [(int(p), int(k), s) for p, k in zip(place, length, strict=True)]
    pieces.sort()
    at, window = 0, np.zeros((int(totals.sum()) // 2048 + 1, len(totals)))
    for place, length, s in pieces:
        assert place == at and place // 2048 == (place + length - 1) // 2048
        window[place // 2048, s] += length
        at += length
    assert at == totals.sum()
    full = window[:-1] if weights is None else window[:5]
    assert np.abs(full - 2048 * share / share.sum()).max() <= 16 * len(totals)


def test_word_tokenizer_is_exact():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["it's DON'T 'll x's''s a_b <|endoftext|> <| x\x01y \x01 ²½ a\x1cb", "É é À «Ñ» “q”—’s ×÷ İ Ÿ ẞ ß \x7f\x85 z ﬁ 12,345.6", LONG, ""]
    for t, ids in zip(texts, tok.encode(texts), strict=True):
        assert np.frombuffer(ids, tok.dtype).tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_are_exact_for_every_character():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    chars = [chr(i) for i in range(0x3000) if chr(i) not in packing._CHUNKS.sub("", chr(i))]
    texts = [t for c in chars for t in (c, f"{c}li", f"a{c}b", f"x{c}", f"{c}{c}'s 1{c}2 {c}.")]
    for t, ids in zip(texts, tok.encode(texts), strict=True):
        assert np.frombuffer(ids, tok.dtype).tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


# ---- 3


def plain_top_k(vectors, is_query, k=5):
    """``vectors``: (id, integer list); every query row against every other row."""
    out = []
    for i, (q, w) in enumerate(vectors):
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(w, v)), c) for j, (c, v) in enumerate(vectors) if j != i)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.25] * 6) for i in range(120)] + [(50, rows[50][1]), (51, [9.0] * 6)]
    rows += [(1000, None), (1050, [0.1, None]), (1100, [float("nan")]), (1150, [float("inf")]), (None, [0.5] * 6), (1200, []), (1250, [0.3, 0.3])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<float>, id string, row int, slot int")
    got = [tuple(r) for r in topk.top_k(topk.integer_vectors(df), F.col("id") % 50 == 0, block=32, queries_at_once=3).collect()]
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    vectors = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in usable]
    assert sorted(got) == plain_top_k(vectors, lambda i: i % 50 == 0)  # 50 is there twice and asks twice
    few = df.where("vec_id in (0, 1)")
    assert len(topk.top_k(topk.integer_vectors(few), F.col("id") % 50 == 0).collect()) == 1
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(i, [70000.0 + i % 7, float(-3 * i), 1.0]) for i in range(150)] + [(200 + i, [2.0**22 + i, -1.0, 0.5]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(topk.integer_vectors(df), F.col("id") % 50 == 0).collect()]
    assert sorted(got) == plain_top_k([(i, [int(256 * x) for x in v]) for i, v in rows], lambda i: i % 50 == 0)


@pytest.mark.parametrize("scale", [40, 2.0**40])
def test_lists_are_read_step_by_step_and_reading_stops(scale):
    rng = np.random.default_rng(1)
    m, dims = 2000, 16
    x = np.floor(rng.normal(size=(m, dims)) * rng.exponential(size=(m, 1)) ** 3 * scale)  # few long vectors, as lists with a clear top have
    lists = topk.SortedLists.from_row(topk.SortedLists.sort(np.arange(m), np.arange(m) * 3, x).to_row())
    assert set(vars(lists)) == {"rows", "ids", "values", "entries", "biggest"} and (np.diff(lists.values, axis=1) >= 0).all()  # no rows to look up
    whole = [[int(v) for v in r] for r in x.tolist()]
    read, looked_at, later = 0, 0, 0
    for own in range(0, m, 100):
        query = topk.Query(x[own], own, 5)
        lists.search(query)
        best = sorted((-sum(a * b for a, b in zip(whole[own], r)), 3 * i) for i, r in enumerate(whole) if i != own)[:5]
        assert query.found == best and query.line == -best[-1][0]
        read, looked_at = read + query.entries_read, looked_at + query.entries_looked_at
        query = topk.Query(x[own], own, 5)
        query.line = -best[0][0] + 1  # a block before held better ones
        lists.search(query)
        assert query.found == []
        later += query.entries_read
    entries = 20 * m * dims
    if scale == 40:
        assert looked_at < 0.95 * read < 0.95 * entries and later <= read


# ---- 4


def manifest(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "archive bigint, offset bigint, length bigint, record_id bigint, digest string, replica string")


def test_audit_finds_exactly_the_damage(spark):
    rows = [
        (a, 500 * i, 500, (a or 0) * 1000 + i, hashlib.sha256(f"{a}.{i}".encode()).hexdigest()) for a in (0, 1, 20, None) for i in range(200)
    ]
    bad = list(rows)
    bad[3] = (*rows[3][:4], "changed")
    bad[400] = (*rows[400][:2], 499, *rows[400][3:])
    gone = bad.pop(700)
    extra = (20, 500 * 900, 10, 5, "new")
    got = fixity.audit(manifest(spark, rows + rows[:5]), manifest(spark, [*bad, extra]), range_bytes=4000, fanout=8).collect()
    kinds = {(r["archive"], r["offset"]): r["kind"] for r in got}
    assert kinds == {rows[3][:2]: "changed", rows[400][:2]: "changed", gone[:2]: "missing", extra[:2]: "extra"}
    assert fixity.audit(manifest(spark, rows), manifest(spark, [])).count() == len(rows)
    assert fixity.audit(manifest(spark, []), manifest(spark, [])).count() == 0


# ---- 5


def test_quality_base_and_verdict(spark):
    rng = random.Random(6)
    common_words = ["the", "of", "and", "to", "in"]
    good = [(1000 + i, " ".join(rng.choice(common_words) if rng.random() < 0.5 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(150)), "en", "a") for i in range(60)]
    odd = [(2000, " ".join(f"{w}!!" for w in good[0][1].upper().split()), "en", "a"), (2001, " | ".join(f"rare{i}" for i in range(120)), "en", "a"), (2002, "say it again now please " * 40, "en", "a")]
    rows = EDGE + good + odd
    got = quality.quality(docs_frame(spark, rows)).collect()
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r["doc_id"], *[r[f] for f in fields]) for r in got), key=repr) == sorted(((r[0], *brute.base_quality(r[1])) for r in rows), key=repr)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r[0] for r in good} <= kept and not kept & {2000, 2001, 2002} and not any(r["kept"] and r["base_failed"] for r in got)
    docs = docs_frame(spark, rows)
    assert sorted(map(repr, quality.keep_good(docs).collect())) == sorted(repr(r) for r in docs.collect() if r["doc_id"] in kept)
    assert quality.quality(docs_frame(spark, [])).count() == 0


def sentences(seed, n_docs, n_words, rare="w"):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.5 else f"{rare}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    return [" ".join(word() for _ in range(n_words)) for _ in range(n_docs)]


def test_copies_do_not_move_the_references(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(sentences(7, 60, 150))] + [(60, " ".join(f"copy{i % 390}" for i in range(400)), "en", "a"), (61, None, "en", "a"), (62, "", None, "a")]
    copies = [(100 + i, rows[60][1], lang, "a") for i in range(300) for lang in ("en", None)]
    plain, more = (quality.build_references(docs_frame(spark, r)) for r in (rows, rows + rows[:20] + copies))
    assert list(plain) == list(more) == ["en"]
    assert plain["en"].words == more["en"].words and (plain["en"].classes == more["en"].classes).all() and plain["en"].n_words == more["en"].n_words
    kept = [{r["doc_id"] for r in quality.quality(docs_frame(spark, x)).collect() if r["kept"] and r["doc_id"] < 60} for x in (rows, rows + copies)]
    assert kept[0] == kept[1] == set(range(60))


def test_short_junk_is_rejected(spark):
    assert quality.word_limit(30) > quality.word_limit(50) > quality.word_limit(100) == quality.word_limit(5000) == quality.MAX_WORD_DISTANCE
    rows = [(i, t, "en", "a") for i, t in enumerate(sentences(8, 60, 150) + sentences(9, 40, 60))]
    menus = [(1000 + n, " | ".join(f"entry{chr(97 + i % 26)}{i}" for i in range(n // 2 + 1)), "en", "a") for n in (30, 40, 60, 98)]
    got = {r["doc_id"]: r for r in quality.quality(docs_frame(spark, rows + menus)).collect()}
    assert all(got[i]["kept"] for i in range(100)) and not any(got[m[0]]["kept"] or got[m[0]]["base_failed"] for m in menus)


def test_texts_reach_python_in_bounded_batches(spark):
    own = spark.conf.get(common.BATCH_SETTING)
    docs = spark.range(0, 2400, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' some words', 900)) AS text", "'en' AS lang", "'a' AS source")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    try:
        for stage in (quality.keep_good, quality.quality, packing.pack):
            spark.conf.unset(common.BATCH_SETTING)
            stage(docs.limit(20))
            met = docs.select("text").mapInArrow(sizes, "rows bigint, bytes bigint").collect()
            assert sum(m["rows"] for m in met) == 2400 and max(m["bytes"] for m in met) < 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_SETTING, "1m")  # a size that the session names stays
        quality.keep_good(docs.limit(20))
        assert spark.conf.get(common.BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(common.BATCH_SETTING, own)


def test_counts_held_are_bounded_over_all_languages(monkeypatch):
    monkeypatch.setattr(quality, "HELD_WORDS", 100)
    rows = [(f"l{i % 7}", " ".join(f"word{chr(97 + (i + k) % 26)}{chr(97 + k)}" for k in range(20))) for i in range(350)]
    sent, most = 0, 0

    def feed():
        nonlocal sent, most
        for row in rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "text"), row, strict=True))])
            most, sent = max(most, sent), 0

    got = {}
    for batch in quality._count_references(feed()):
        for r in batch.to_pylist():
            sent += r["word"] is not None
            got[r["lang"], r["word"], r["cls"]] = got.get((r["lang"], r["word"], r["cls"]), 0) + r["n"]
    want = {}
    for lang, text in rows:
        for w in text.split():
            want[lang, w, -1] = want.get((lang, w, -1), 0) + 1
        for i, n in enumerate(quality.class_counts(text).tolist()):
            if n:
                want[lang, None, i] = want.get((lang, None, i), 0) + n
    assert got == want and most <= 120


def test_language_without_a_reference_has_no_distance(spark):
    rare = " ".join("\u0441\u043b\u043e\u0432\u043e" + chr(0x430 + i % 32) + chr(0x430 + i // 32) for i in range(120))
    rows = [(i, t, "en", "a") for i, t in enumerate(sentences(10, 60, 150))] + [(100, rare, "ru", "a"), (101, rare, None, "a")]
    docs = docs_frame(spark, rows)
    got = {r["doc_id"]: (r["char_distance"], r["word_distance"], r["kept"]) for r in quality.quality(docs).collect()}
    assert got[100] == (None, None, True) and got[101][0] > quality.MAX_CHAR_DISTANCE and not got[101][2]
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == set(range(60)) | {100}


def test_quality_query_equals_brute_force(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()))
    for r in queries.QUERIES["op5_divergence_rules"](spark, SF_SMALL).collect():
        assert tuple(r)[1:7] == brute.base_quality(texts[r["doc_id"]])


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute.repeated_windows(words)


def test_jensen_shannon_bounds():
    assert quality.jensen_shannon(np.array([1.0, 0]), np.array([0, 2.0])) == pytest.approx(1)
    assert quality.jensen_shannon(np.array([1.0, 3]), np.array([2.0, 6])) == pytest.approx(0)


# ---- 7


def test_shards(spark):
    rows = EDGE + [(500 + i, "t" * i, "en", "a") for i in range(400)]
    got = sharding.shard_documents(docs_frame(spark, rows)).collect()
    assert sorted(((r["key"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and len({r["shard"] for r in got if r["key"] == 8}) == 1
    moved = sum(r["grown_shard"] == 8 for r in got) / len(got)
    assert 0.05 < moved < 0.2
    assert sharding.shard_documents(docs_frame(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 300))
def test_jump_hash(keys, n):
    assert sharding.jump_hash(np.array(keys, dtype=np.uint64), n).tolist() == [brute.jump(k, n) for k in keys]


# ---- 8


def test_personal_data_base_spans(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += [None, "", "x@y a@b.c%d@e.f 1.2.3.4.5 300.1.1.1 4539 1488 0343 6467 +49 (30) 123-4567. " + "9" * 5000 + "@", "a" * 50000 + "@", "٣٤ ²@é.com ok@é.com"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, spans int")
    for r in pii.find_personal_data(df).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute.base_personal(texts[r["doc_id"]] or "")
        taken = sorted((s["start"], s["end"]) for s in r["spans"] if not s["base"])
        assert all(b <= s["start"] or s["end"] <= a for a, b in taken for s in r["spans"] if s["base"])
    assert pii.find_personal_data(df.limit(0)).count() == 0


@given(st.text(alphabet="a1@.+- 2(9%\n4", max_size=40))
@settings(max_examples=300)
def test_base_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute.base_personal(text)


def test_skip_edges_carry_labels():
    n = len(pii.LABELS)
    score = np.zeros((4, n))
    score[0, 3], score[2, 0], score[3, 0] = 4.0, 0.3, 4.0  # sure card, unsure, unsure outside, sure outside
    tie = np.eye(n) * 2.5
    alone = pii.beliefs(score, np.zeros((0, 2), dtype=np.int64), np.zeros((0, n, n)))
    linked = pii.beliefs(score, np.array([[0, 1], [1, 2]]), np.stack([tie, tie]))
    assert alone[1].argmax() != 3 or alone[1].max() < 0.3
    assert linked[1].argmax() == 3 and linked[2].argmax() == 3 and linked[3].argmax() == 0


def test_skip_edges_do_not_hang_on_candidates_between():
    plain = " ".join(["plain"] * 500)
    graph = pii.build_graph(f"4539148803436467 {plain} (4539148803436467), {plain} 1234567 7654321 1234567 1234567")
    assert graph.places == [0, 501, 1002, 1003, 1004, 1005]
    assert graph.skip == [(0, 1), (2, 4)] and graph.chain == [(2, 3), (3, 4), (4, 5)]


def test_address_parts_with_many_zeros():
    assert pii.base_spans("0" * 5000 + "1.2.3.000") == [(1, 0, 5009)]


def test_beliefs_are_exact_on_a_chain():
    rng = np.random.default_rng(3)
    score, pot = rng.normal(size=(3, 2)), rng.normal(size=(2, 2, 2))
    joint = np.exp(score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :] + pot[0][:, :, None] + pot[1][None, :, :])
    want = np.stack([joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))])
    got = pii.beliefs(score, np.array([[0, 1], [1, 2]]), pot, rounds=60)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)


@pytest.fixture(scope="module")
def fitted_field():
    """The field fitted on half of a table, and the other half of its texts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    half = len(texts) // 2
    batch = pa.RecordBatch.from_pydict({"key": list(range(half)), "text": texts[:half]})
    return pii.fit(np.array([x for r in pii._training_rows([batch]) for x in r.column("x").to_pylist()])), texts[half:]


def test_held_out_accuracy(fitted_field):
    w, texts = fitted_field
    held = [(t, g) for t in texts if (g := pii.build_graph(t))]
    right = total = 0
    for (t, g), p in zip(held, pii.label_graphs([g for _, g in held], w), strict=True):
        labels = np.array(pii.train_labels(t, g))
        right, total = right + int((p.argmax(axis=1) == labels).sum()), total + len(labels)
    assert total > 300 and right / total > 0.97


def test_skip_edges_find_mentions_whose_pattern_is_hidden(fitted_field):
    w, texts = fitted_field

    def added(texts, skip):
        graphs = [pii.build_graph(t) for t in texts]
        if not skip:
            graphs = [pii.Graph(g.spans, g.places, g.features, g.chain, []) for g in graphs]
        return [pii.added_spans(t, g, p, pii.base_spans(t)) for t, g, p in zip(texts, graphs, pii.label_graphs(graphs, w), strict=True)]

    told, hidden = [], []
    for t in texts:
        if m := pii._SECRET.search(t or ""):
            told.append(t + " and so we went on to use " + pii.value_of(m[0].split()[-1]) + " for the rest of the day")
            hidden.append((4, len(t) + 26, len(told[-1]) - 24))
    found = {skip: sum(h in spans for h, spans in zip(hidden, added(told, skip), strict=True)) for skip in (True, False)}
    assert len(told) > 50 and found[True] > 0.95 * len(told) and found[False] < 0.75 * len(told)
    # precision: what is added lies in a credential or is a mention of one
    wrong = 0
    for t, h, spans in zip(told, hidden, added(told, True), strict=True):
        known = [m.span() for m in pii._SECRET.finditer(t)] + [h[1:]]
        wrong += sum(not any(a < e and s < b for s, e in known) for _, a, b in spans)
    assert wrong <= 0.02 * len(told)
    # numbers that are only numbers stay so, however often they come
    plain = [t for t in texts if t and not pii.build_graph(t)][:100]
    assert not any(added([f"{t} see item {i * 37 + 1000}-B and again item {i * 37 + 1000}-B, {i * 37 + 1000}-B" for i, t in enumerate(plain)], True))


def test_a_document_does_not_depend_on_its_batch(fitted_field):
    w, texts = fitted_field
    graphs = [g for t in texts if (g := pii.build_graph(t))][:60]
    for g, p in zip(graphs, pii.label_graphs(graphs, w), strict=True):
        assert np.allclose(pii.label_graphs([g], w)[0], p, rtol=0, atol=1e-12)


def test_values_behind_a_name_are_the_same_thing():
    assert pii.value_of("password='ab12cd34ef',") == "ab12cd34ef" and pii.value_of("(x9)") == "x9" and pii.value_of("a=") == "a="
    graph = pii.build_graph("token=ab12cd34ef and then some words (AB12cd34ef) k=1 1")
    assert graph.skip == [(0, 1)]


# ---- 9


def test_mixing_targets_and_repeats(spark):
    rng = random.Random(8)
    rows = EDGE + [(100 + i, "w " * rng.randrange(200), "en", rng.choice(["a", "b", "c", "c", "c", "c", None])) for i in range(300)]
    docs = docs_frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    sizes = {}
    for r in got:
        sizes.setdefault(r["source"], [0, 0, 0.0, 0])
        sizes[r["source"]][0] += r["size"]
        sizes[r["source"]][1] += r["taken"]
        sizes[r["source"]][2] = r["target"]
        sizes[r["source"]][3] = max(sizes[r["source"]][3], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] in (0, 1, 2, 3)
    assert sum(t for _, _, t, _ in sizes.values()) == pytest.approx(sum(s for s, *_ in sizes.values()))
    for own, taken, target, largest in sizes.values():
        assert target <= 3 * own and abs(taken - target) <= largest / 2 + 1
    free = [(t / w, s) for (s, w), (own, _, t, _) in zip([(s, i % 3 + 1) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))], [sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))], strict=True) if t < 3 * own]
    assert max(free)[0] == pytest.approx(min(free)[0])
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs_frame(spark, [])).count() == 0


# ---- 10


def test_line_windows(spark):
    rng = random.Random(10)
    lines = [f"line number {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice([*lines, "", "  "]) for _ in range(rng.randrange(0, 25))), "en", "a") for i in range(80)]
    rows += [(200, "A\nA\nA\nA", "en", "a"), (201, "p\n\n q\t\nr\ns", "en", "a"), (202, "z\np\nq\n\n\nr\nend", "en", "a"), (203, None, "en", "a"), (204, "\n" * 5000 + "x\ny\nz", "en", "a"), (205, "\n".join(f"u{i}" for i in range(30000)), "en", "a")]
    docs = docs_frame(spark, rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    for (doc, text, *_), want in zip(rows, brute.dedup([r[:2] for r in rows]), strict=True):
        assert got[doc]["text"] == want
        assert got[doc]["n_lines"] == (0 if text is None else text.count("\n") + 1)
    twice = docs_frame(spark, [(1, "a\nb\nc", "en", "a"), (1, "a\nb\nc", "en", "a"), (None, "b\nc\nd", "en", "a"), (2, "b\nc\nd\ne", "en", "a")])
    assert sorted((repr(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(twice).collect()) == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", "e"), ("None", "b\nc\nd")]
    assert line_dedup.dedup_lines(docs_frame(spark, [])).count() == 0
