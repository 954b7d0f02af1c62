"""Pieces merged by ranks against the tokenizer itself."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from commentlab.llm import packing
from commentlab.llm.common import byte_alphabet

CHARS = "etaoinshrdlu" * 4 + "'.,;-!<>/w" + "éèßøčŽșñ" + "qxz0189«»–’"


def test_plain_pieces_are_merged_by_ranks_and_give_the_tokenizers_ids(monkeypatch):
    tok = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices(CHARS, k=rng.randrange(1, 14))) for _ in range(300)) for _ in range(40)]
    texts += ["the" * 700 + " a" * 50, "DON'T it's ÉTÉ x" + "-" * 3000]
    want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    asked, ids = [], packing.WordTokenizer._ids
    monkeypatch.setattr(packing.WordTokenizer, "_ids", lambda self, text: asked.append(text) or ids(self, text))
    assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(texts)] == want
    assert {len(w) for text in asked for w in text.split() if w != packing._SEPARATOR} == {2100, 3000}  # only these took the slower way


def test_a_piece_with_the_separator_or_a_special_token_is_left_to_the_tokenizer():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["a\x01b", "\x01", "x<|endoftext|>y <|", "日本 é the", " ", "ab " * 9]
    assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(texts)] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def model(*merges, **other):
    tokens = [*byte_alphabet(), *[c + "</w>" for c in byte_alphabet()], *["".join(m) for m in merges]]
    return {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(dict.fromkeys(tokens))}, "merges": [" ".join(m) for m in merges]} | other


@pytest.mark.parametrize(
    ("case", "allowed"),
    [
        (model(("a", "b"), ("ab", "c</w>"), ("b", "c")), True),
        (model(("b", "c"), ("a", "b"), ("ab", "c")), False),  # "abc" is merged to "a" and "bc", which ranks would join
        (model(("ab", "c"), ("a", "b")), False),  # joins what a later merge makes
        (model(("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")), False),  # makes a token twice
        (model(("a", "b</w>"), ("ā", "b")), False),  # joins the byte that stands for the suffix
        (model(("<", "/"), ("</", "w"), ("</w", ">")), False),  # spells the suffix
        (model(("a", "b"), byte_fallback=True), False),
        (model(("a", "b"), end_of_word_suffix=None), False),
        (model(("a", "b"), type="WordPiece"), False),
    ],
)
def test_ranks_are_taken_only_where_they_are_the_merges(case, allowed):
    assert (packing.RankedPieces.of(case, "<u2") is not None) == allowed


def test_without_ranks_pieces_go_to_the_tokenizer(tmp_path):
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        data = json.load(f)
    data["model"]["merges"] = data["model"]["merges"][:200][::-1]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(data), encoding="utf-8")
    tok = packing.WordTokenizer(str(other))
    assert tok.ranked is None
    texts = ["it's the other way, round 42", "thethe and", ""]
    assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(texts)] == [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
