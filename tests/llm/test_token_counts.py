"""Token counts by merging against the vocabulary's own library."""

from __future__ import annotations

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from commentlab.llm import queries, token_counts
from tests.conftest import SF_SMALL

PARTS = st.one_of(
    st.sampled_from(["the", " of", "<s>", "<unk>", "<0x0A>", "▁", "▁▁", "\n", "\r\n", "  ", ");\r", "é", "é", "日本", "😀", "\x00", " ", "\x1c", "ing"]),
    st.text(alphabet=st.characters(codec="utf-8"), max_size=6),
)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=token_counts.default_model())


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(token_counts.MergeRanks.from_model(token_counts.default_model()))


@given(st.lists(PARTS, max_size=20).map("".join))
@example(" ")
@example("\n")
@example("a ▁ b")
@settings(max_examples=400, deadline=None)
def test_counts_equal_the_library(library, counter, text):
    assert counter.counts([text]) == [len(library.encode(text))]


def test_memory_turns_over(library, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD_UNITS", 3)
    small = token_counts.TokenCounter(token_counts.MergeRanks.from_model(token_counts.default_model()))
    texts = ["one two three four", "two five six", "x" * 5000 + " one", "one two seven eight nine"] * 3
    assert [small.counts([t])[0] for t in texts] == [len(library.encode(t)) for t in texts]
    assert all(len(u) <= token_counts.LONG_UNIT for u in small.young)


def test_merges_by_rank_not_by_place():
    ranks = token_counts.MergeRanks({"a": 9, "b": 9, "ab": 2, "ba": 1, "aa": 2})
    assert ranks.count("aba") == 2 and ranks.count("abab") == 3  # b-a comes first and leaves a, b
    assert ranks.count("aaa") == 2 and ranks.count("aaaa") == 2  # leftmost of equal ranks
    assert ranks.count("a€b") == 1 + 3 + 1  # a character without a piece: its bytes


def test_a_piece_across_white_space_is_refused():
    for piece in ("a▁b", "x\n"):
        with pytest.raises(ValueError):
            token_counts.MergeRanks({piece: 1.0})


def test_awkward_rows(spark, library):
    long = " ".join(f"w{i % 9973}ø" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "tie"), (4, "tie"), (5, long), (6, "a" * 20_000), (7, "<s> </s>")]
    docs = spark.createDataFrame([(i, t, "x", -1, True) for i, t in rows], "doc_id bigint, text string, n_tokens string, n_bytes int, over_limit boolean")
    got = sorted(map(tuple, token_counts.token_counts(docs.repartition(3), limit=4).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4) for i, t in rows]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {r["doc_id"]: len(library.encode(r["text"] or "")) for r in docs}
    got = queries.QUERIES["op13_heap_token_counts"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["n_tokens"] == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 4096)
